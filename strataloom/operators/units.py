"""Quantities recorded in different units: values of texts in the common unit of their dimension.

Units that stand with their value are read and converted exactly (decimal arithmetic). Where the unit is missing, the
values of the same phrase decide: the logarithms of its unit-bearing values, in the common unit, are fitted by a
Gaussian mixture with a flat part for outliers; a value without unit under unit u is that mixture shifted by the factor
of u. The weights of the units are estimated by EM from the values without unit; a unit that another sentence of the
text names counts as strong prior evidence for its values. The unit of highest posterior is assigned, and the value is
flagged where the posterior stays below a threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.functions.quantities import COMMA_MARK, POINT_MARK, STYLE_SIZE, read_quantities, rounded, to_common, units
from strataloom.operators.skew import salted_join
from strataloom.session import durable

_READ = "id string, phrase string, place int, dimension string, unit string, amount bigint, common double, raw string, named string"
#: Width of the bins of log10 values that the mixtures are fitted on, and the posterior under which a unit is uncertain.
BIN, SURE = 0.05, 0.9
#: Weight and density (per unit of log10) of the flat part of a mixture, and the odds of a unit named by another sentence.
OUTLIERS, FLAT, NAMED_ODDS = 0.01, 0.05, 1e5
_BIGINT = 2**63 - 1


def style_weights(df: DataFrame) -> np.ndarray:
    """The model of ``decimal_style`` from all texts of ``df`` (``text``): log odds of hashed words beside a decimal comma.

    Texts in Latin letters whose separators tell the mark themselves are its examples. Counts are made over all of
    them in the engine; what reaches the driver is one row per hashed word, at most ``STYLE_SIZE``.
    """
    told = df.select("text").where("text is not null").select("text", F.col("text").rlike(COMMA_MARK).alias("comma"), F.col("text").rlike(POINT_MARK).alias("point"))
    told = told.where("comma <> point").where(~F.col("text").rlike("[\\x{0400}-\\x{04ff}\\x{0600}-\\x{06ff}\\x{0900}-\\x{097f}\\x{0e00}-\\x{0e7f}\\x{3040}-\\x{9fff}]"))
    words = told.select("comma", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("word"))
    counts = words.groupBy(F.pmod(F.crc32("word"), F.lit(STYLE_SIZE)).cast("int").alias("k")).agg(F.count_if("comma").alias("comma"), F.count_if(~F.col("comma")).alias("point")).toPandas()
    out = np.zeros(STYLE_SIZE, dtype=np.float32)
    if len(counts):
        comma, point = counts["comma"].to_numpy(float) + 0.5, counts["point"].to_numpy(float) + 0.5
        out[counts["k"].to_numpy()] = np.log(comma / comma.sum()) - np.log(point / point.sum())
    return out


def _read(weights: np.ndarray | None):
    names = [part.split()[0] for part in _READ.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                for q in read_quantities(text, weights):
                    dimension = amount = common = None
                    if q.unit is not None and not q.named:
                        dimension, exact = to_common(q.value, q.unit)
                        amount, common = _whole(exact), float(exact)
                    rows.append((key, q.phrase, q.start, dimension, None if q.named else q.unit, amount, common, str(q.value), q.unit if q.named else None))
            out = pd.DataFrame(rows, columns=names)
            out["amount"] = out["amount"].astype("Int64")
            yield out

    return run


def _whole(exact: Decimal) -> int | None:
    amount = rounded(exact) if abs(exact) <= _BIGINT else None
    return amount if amount is not None and abs(amount) <= _BIGINT else None


def read_texts(df: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``id, phrase, place, dimension, unit, amount, common, raw, named`` of every quantity of ``df`` (``id, text``).

    ``unit`` is null where none stands with the value; ``named`` is then the unit that another sentence names, if any.
    The phrase holds the letters between the value and the last tag or the start of the sentence. Repeated rows count
    once; null and empty texts give nothing.
    """
    texts = df.select("id", "text").where("text is not null and text rlike '[\\\\p{N}零〇一二两三四五六七八九十百千半]'").distinct()
    return texts.mapInPandas(_read(weights), _READ)


def gaussians(x: np.ndarray, w: np.ndarray, k: int = 2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of a mixture of ``k`` Gaussians on weighted points, by EM from spread quantiles."""
    order = np.argsort(x)
    at = np.searchsorted(np.cumsum(w[order]) / w.sum(), (np.arange(k) + 0.5) / k)
    mean = x[order][np.minimum(at, len(x) - 1)].astype(float)
    share, dev = np.full(k, 1 / k), np.full(k, max(0.3, float(np.sqrt(np.cov(x, aweights=w))) if len(x) > 1 else 0.3))
    for _ in range(rounds):
        dens = share * np.exp(-0.5 * ((x[:, None] - mean) / dev) ** 2) / dev + 1e-300
        resp = dens / dens.sum(1, keepdims=True) * w[:, None]
        mass = resp.sum(0) + 1e-9
        mean = (resp * x[:, None]).sum(0) / mass
        dev = np.maximum(0.15, np.sqrt((resp * (x[:, None] - mean) ** 2).sum(0) / mass))
        share = mass / mass.sum()
    return share, mean, dev


def unit_posteriors(known: pd.DataFrame, bare: pd.DataFrame, rounds: int = 30) -> pd.DataFrame:
    """``bin, named, unit, posterior`` for the bins of values without unit of one phrase.

    ``known`` has ``bin`` (of log10 common values), ``unit, n``, all of one dimension; ``bare`` has ``bin`` (of log10 raw
    values), ``n`` and perhaps ``named``. A named unit of another dimension stays with the posterior of its odds.
    """
    share, mean, dev = gaussians(known["bin"].to_numpy() * BIN, known["n"].to_numpy(dtype=float))
    by_unit = known.groupby("unit")["n"].sum()
    named = bare["named"].to_numpy(dtype=object) if "named" in bare else np.full(len(bare), None, dtype=object)
    dimension = units()[by_unit.index[0]][0]
    fits = [u if u is not None and u == u and units()[u][0] == dimension else None for u in named]
    names = list(dict.fromkeys([*by_unit.index, *(u for u in fits if u)]))
    weight = np.array([float(by_unit.get(u, 0.0)) for u in names]) + 0.5
    weight /= weight.sum()
    x, n = bare["bin"].to_numpy() * BIN, bare["n"].to_numpy(dtype=float)
    raw = [Decimal(repr(float(10**v))) for v in x]
    at = np.array([[math.log10(max(1e-9, abs(float(to_common(v, u)[1])))) for u in names] for v in raw]).reshape(len(x), len(names))
    like = (1 - OUTLIERS) * (share * np.exp(-0.5 * ((at[:, :, None] - mean) / dev) ** 2) / (dev * math.sqrt(2 * math.pi))).sum(2) + OUTLIERS * FLAT
    odds = np.array([[NAMED_ODDS if u == f else 1.0 for u in names] if f else [1.0] * len(names) for f in fits]).reshape(len(x), len(names))
    prior = weight.copy()
    for _ in range(rounds):
        post = like * odds * weight
        post /= post.sum(1, keepdims=True)
        weight = ((post * n[:, None]).sum(0) + prior) / (n.sum() + 1)
    best = post.argmax(1)
    out = pd.DataFrame({"bin": bare["bin"].to_numpy(), "named": named, "unit": [names[i] for i in best], "posterior": post.max(1)})
    other = np.array([u is not None and u == u and f is None for u, f in zip(named, fits, strict=True)], dtype=bool)
    out.loc[other, "unit"], out.loc[other, "posterior"] = named[other], NAMED_ODDS / (1 + NAMED_ODDS)
    return out


_FITTED = "phrase string, bin bigint, named string, unit string, posterior double"


def _fit(group: pd.DataFrame) -> pd.DataFrame:
    known, bare = group[group["unit"].notna()], group[group["unit"].isna()]
    if known.empty:
        sure = bare[bare["named"].notna()]
        out = pd.DataFrame({"bin": sure["bin"], "named": sure["named"], "unit": sure["named"], "posterior": NAMED_ODDS / (1 + NAMED_ODDS)})
    else:
        main = known.groupby("dimension")["n"].sum().idxmax()
        out = unit_posteriors(known[known["dimension"] == main], bare)
    out.insert(0, "phrase", group["phrase"].iloc[0])
    return out


@F.pandas_udf(T.LongType())
def _amount(raw: pd.Series, unit: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else _whole(to_common(Decimal(v), u)[1]) for v, u in zip(raw, unit, strict=True)], dtype="Int64")


#: Bin of values without logarithm (zero).
_ZERO = -(10**6)


def _bin(column: str):
    value = F.abs(F.col(column).cast("double"))
    return F.when(value > 0, F.floor(F.log10(value) / BIN)).otherwise(F.lit(_ZERO)).cast("bigint")


def common_quantities(df: DataFrame) -> DataFrame:
    """``id, dimension, amount, unit, inferred, posterior, uncertain`` for the quantities of ``df`` (``id, text``).

    Units that stand with their value have posterior 1. Of the other values, those whose phrase never carries a unit and
    that no sentence names one for come out with null dimension and amount and ``uncertain`` true. Zero has no
    logarithm: it takes a named unit, else it is uncertain. Repeated rows count once; empty tables give nothing.
    """
    found = durable(read_texts(df, style_weights(df)))
    stated = found.where("unit is not null").select(
        "id", "dimension", "amount", "unit", F.lit(False).alias("inferred"), F.lit(1.0).alias("posterior"), F.lit(False).alias("uncertain")
    )
    bare = found.where("unit is null").select("id", "phrase", "raw", "named", _bin("raw").alias("bin"))
    phrases = bare.select("phrase").distinct()
    known = found.where("unit is not null and common <> 0").groupBy("phrase", "dimension", "unit", _bin("common").alias("bin")).agg(F.count("*").alias("n"))
    known = known.join(phrases, "phrase", "left_semi")
    bins = known.unionByName(bare.groupBy("phrase", "named", "bin").agg(F.count("*").alias("n")).where(f"bin > {_ZERO}"), allowMissingColumns=True)
    fitted = durable(bins.groupBy("phrase").applyInPandas(_fit, _FITTED))
    none = F.coalesce("named", F.lit("")).alias("named")
    placed = salted_join(
        bare.select("id", "phrase", "raw", "bin", none), fitted.select("phrase", "bin", none, F.col("unit").alias("likely"), "posterior"), ["phrase", "bin", "named"], F.col("id"), "left"
    )
    unit = F.coalesce("likely", F.when(F.col("named") != "", F.col("named")))
    posterior = F.coalesce("posterior", F.when(F.col("named") != "", F.lit(NAMED_ODDS / (1 + NAMED_ODDS))), F.lit(0.0))
    dims = F.create_map(*(F.lit(v) for u, (d, _) in units().items() for v in (u, d)))
    inferred = placed.select("id", dims[unit].alias("dimension"), _amount("raw", unit).alias("amount"), unit.alias("unit"), F.lit(True).alias("inferred"), posterior.alias("posterior"), (posterior < SURE).alias("uncertain"))
    return stated.unionByName(inferred)
