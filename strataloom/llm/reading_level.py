"""Reading level of each document: smoothed unigram language models per level, assigned by posterior.

Tokens are words of alphabetic scripts and neighbouring pairs of ideographs; they are hashed into a fixed number of
buckets, so the model has one size whatever the corpus is. The models are trained on the labelled documents, whose
number is bounded by a parameter (the documents of least hash beyond it are kept); without any label the documents are
seeded by a readability formula. Cross-fitted likelihoods of the labelled documents calibrate the posterior by a bias
per token and level and a temperature.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import durable

BUCKETS = 1 << 18
FOLDS = 5
LEVELS = 5
#: At most so many labelled (or formula-seeded) documents are used for training; all documents are scored.
MAX_LABELLED = 20_000
SMOOTHING = 0.05
_WORD = re.compile(r"[^\W\d_㐀-鿿぀-ヿ]+")
_DIGITS = re.compile(r"\d+")


@lru_cache(maxsize=200_000)
def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def features(text: str) -> np.ndarray:
    """Buckets of the tokens of a text, with repeats."""
    text = text.lower()
    words = [_bucket(w) for w in _WORD.findall(text)] if re.search(r"[^\W\d_㐀-鿿]", text) else []
    if _DIGITS.search(text):
        words += [_bucket("0")] * len(_DIGITS.findall(text))
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    han = (code >= 0x3400) & (code <= 0x9FFF)
    pair = han[:-1] & han[1:]
    two = ((code[:-1][pair] * 40503 + code[1:][pair]) * 2654435761 >> 7) % BUCKETS
    return np.concatenate([np.asarray(words, dtype=np.int64), two])


def formula(text: str) -> int:
    """A level from the lengths of sentences and words, by fixed thresholds, where nobody has rated any text."""
    sentences = max(1, len(re.findall(r"[.!?。！？](?:\s|$|(?=[㐀-鿿]))", text)))
    words = _WORD.findall(text)
    han = len(re.findall(r"[㐀-鿿]", text))
    load = (len(words) + han / 1.6) / sentences + 4 * (sum(map(len, words)) / len(words) - 4.5 if words else 0)
    return 1 + int(np.searchsorted([9, 13, 19, 28], load))


def _weights(labels: DataFrame, most: int) -> DataFrame:
    share = [F.avg(F.when(F.col("level") == k, 1.0).otherwise(0.0)).alias(f"w{k}") for k in range(1, LEVELS + 1)]
    rated = labels.where(f"doc_id is not null and level between 1 and {LEVELS}").distinct().groupBy("doc_id").agg(*share)
    return rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("fold", F.pmod(F.hash("doc_id"), F.lit(FOLDS)))


_W = [f"w{k}" for k in range(1, LEVELS + 1)]


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for fold, part in batch.groupby("fold"):
            total = np.zeros((BUCKETS, LEVELS))
            for text, *w in part[["text", *_W]].itertuples(index=False):
                bucket, n = np.unique(features(text), return_counts=True)
                total[bucket] += n[:, None] * np.asarray(w)
            used = np.flatnonzero(total.any(axis=1))
            out = pd.DataFrame(total[used], columns=_W)
            out.insert(0, "bucket", used)
            out.insert(0, "fold", fold)
            yield out


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    seen = max(1, int(counts.any(axis=1).sum()))
    smooth = counts + SMOOTHING
    return np.log(smooth / (counts.sum(axis=0) + SMOOTHING * seen)).astype(np.float32)


def _likelihoods(models: list[np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *w, len(f), *m[f].sum(axis=0)) for d, w, f, m in ((r[0], r[3:], features(r[1]), models[r[2]]) for r in batch[["doc_id", "text", "fold", *_W]].itertuples(index=False))]
            yield pd.DataFrame(rows, columns=["doc_id", *_W, "n", *(f"l{k}" for k in range(1, LEVELS + 1))])

    return run


def calibrate(mean: np.ndarray, wanted: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Bias per level and temperature for mean log likelihoods per token, by coordinate descent on the log loss."""
    at, step = np.zeros(LEVELS), np.full(LEVELS, 0.02)
    at[0], step[0] = 2.0, 0.5

    def loss(p: np.ndarray) -> float:
        s = (mean + np.append(0, p[1:])) * np.exp(p[0])
        s -= s.max(axis=1, keepdims=True)
        prob = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
        return float(-(wanted * np.log(0.95 * prob + 0.05 / LEVELS)).sum() / max(1, len(mean)))

    best = loss(at)
    for _ in range(rounds):
        for k in range(LEVELS):
            for sign in (1, -1):
                trial = at.copy()
                trial[k] += sign * step[k]
                if (value := loss(trial)) < best:
                    best, at = value, trial
                    break
            else:
                step[k] *= 0.6
    return np.append(0, at[1:]), float(np.exp(at[0]))


def _assign(model: np.ndarray, bias: np.ndarray, scale: float, usual: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            level, sure = [], []
            for text in batch["text"]:
                f = features(text) if text else ()
                if not len(f):
                    level.append(usual)
                    sure.append(0.0)
                    continue
                s = (model[f].mean(axis=0) + bias) * scale
                p = np.exp(s - s.max())
                level.append(1 + int(s.argmax()))
                sure.append(float(p.max() / p.sum()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "level": level, "posterior": sure})

    return run


def reading_levels(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, level, posterior`` for every row of ``documents`` (``doc_id, text``).

    ``labels`` has ``doc_id, level``; several raters share the weight of a document, labels outside 1 to 5 are ignored.
    Null, empty and wordless texts take the most frequent level with posterior 0.
    """
    documents = documents.select("doc_id", "text")
    weights = durable(_weights(labels.select(*(c for c in labels.columns if c in ("doc_id", "rater", "level"))), most))
    rated = documents.where("text is not null").join(weights, "doc_id")
    if weights.isEmpty():
        seed = F.pandas_udf(lambda text: text.map(formula), "int")
        sample = documents.where("text is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        rated = sample.withColumn("_seed", seed("text")).select("doc_id", "text", *(F.when(F.col("_seed") == k, 1.0).otherwise(0.0).alias(f"w{k}") for k in range(1, LEVELS + 1)), F.pmod(F.hash("doc_id"), F.lit(FOLDS)).alias("fold"))
    rated = durable(rated.select("doc_id", "text", "fold", *_W))
    sums = rated.select("text", "fold", *_W).mapInPandas(_counts, "fold int, bucket bigint, " + ", ".join(f"{w} double" for w in _W))
    table = sums.groupBy("fold", "bucket").agg(*(F.sum(w).alias(w) for w in _W)).toPandas()
    by_fold = np.zeros((FOLDS, BUCKETS, LEVELS), dtype=np.float32)
    by_fold[table["fold"].to_numpy(dtype=int), table["bucket"].to_numpy(dtype=int)] = table[_W].to_numpy(dtype=np.float32)
    total = by_fold.sum(axis=0)
    model = _log_probabilities(total)
    crossed = [_log_probabilities(total - by_fold[k]) for k in range(FOLDS)]
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{w} double" for w in _W) + ", n int, " + ", ".join(f"l{k} double" for k in range(1, LEVELS + 1))
    scored = rated.mapInPandas(_likelihoods(crossed), schema).where("n > 0").toPandas()
    wanted = scored[_W].to_numpy()
    mean = scored[[f"l{k}" for k in range(1, LEVELS + 1)]].to_numpy() / scored["n"].to_numpy()[:, None]
    bias, scale = calibrate(mean, wanted)
    usual = 1 + int(wanted.sum(axis=0).argmax()) if len(wanted) else (1 + LEVELS) // 2
    return documents.mapInPandas(_assign(model, bias, scale, usual), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, level int, posterior double")
