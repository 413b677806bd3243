"""Mixing sources to target weights by balanced sampling with the cube method.

Each source gets the same expected number of repeats for all its texts; the whole part is certain, the fraction is an
inclusion probability. The flight phase moves the probabilities of a few texts at a time along the null space of the
balancing constraints (number of texts, number of tokens) until all but two per block are 0 or 1. Blocks run in
parallel; what they leave open is gathered into ever fewer blocks, until one small landing problem per source remains.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import durable

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, LEAST_BLOCK = 4096, 8
#: Most partitions that blocks are spread over.
MAX_PARTITIONS = 4096
_TINY = 1e-9


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, keys: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """``keys, tokens``: number of tokens of ``text`` under a public byte-level vocabulary; null texts have 0.

    ``tokenizer`` is the path of the vocabulary. Every executor reads it from there, so it must lie at the same place
    on all machines (or on a shared one).
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(tokenizer)
        for batch in batches:
            out = batch[keys].copy()
            out["tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]]
            yield out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, "text").mapInPandas(count, f"{fields}, tokens bigint")


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight phase: sums of p and of p * size are kept, at most two values stay within (0, 1)."""
    p = p.astype(float).copy()
    hand: list[int] = []
    for k in itertools.chain(np.flatnonzero((p > _TINY) & (p < 1 - _TINY)), [-1]):
        if k >= 0:
            hand.append(int(k))
        while len(hand) >= 3:
            a, b, c = hand[:3]
            u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], dtype=float)
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
            now = p[[a, b, c]]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.min(np.where(u > 0, (1 - now) / u, np.where(u < 0, -now / u, np.inf)))
                down = np.min(np.where(u > 0, now / u, np.where(u < 0, (now - 1) / u, np.inf)))
            step = up if rng.random() < down / (up + down) else -down
            p[[a, b, c]] = np.clip(now + step * u, 0, 1)
            hand = [i for i in hand if _TINY < p[i] < 1 - _TINY]
    p[p <= _TINY], p[p >= 1 - _TINY] = 0.0, 1.0
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last open probabilities set to 0 or 1 with the least change of the token total, then of the number of texts."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) > 12:
        raise ValueError("landing takes what the flight phase leaves")
    aim, number = (p[open_] * size[open_]).sum(), p[open_].sum()
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda x: (abs(np.dot(x, size[open_]) - aim), abs(sum(x) - number)), default=())
    p[open_] = best
    return p


def _fly(last: bool, seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id").reset_index(drop=True)
        key = f"{seed}|{group['source'].iloc[0]}|{group['block'].iloc[0]}"
        rng = np.random.default_rng(int.from_bytes(key.encode()[-16:], "little"))
        group["p"] = flight(group["p"].to_numpy(), group["tokens"].to_numpy(), rng)
        if last:
            group["p"] = landing(group["p"].to_numpy(), group["tokens"].to_numpy())
        return group

    return run


def mix(sized: DataFrame, targets: DataFrame, total: float | None = None, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """``doc_id, source, tokens, repeats`` of the chosen texts (repeats of 1 or more).

    ``sized`` has ``doc_id, source, tokens``; ``targets`` has ``source, target_share, max_repeats``. ``total`` is the
    wanted number of tokens; by default, and at most, the largest number that all shares allow under the caps. Texts
    without source, without tokens, or of a source without target take no part; repeated rows count once. If a source
    with a positive share has no texts, no total is possible and a ValueError says which. ``block`` is 8 or more: four
    blocks or more must leave less than one block open, or the rounds would not end.
    """
    if block < LEAST_BLOCK:
        raise ValueError(f"block must be {LEAST_BLOCK} or more")
    sized = sized.where("source is not null and tokens > 0").select("doc_id", "source", "tokens").distinct()
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("n"))
    plan = targets.where("source is not null and target_share > 0").distinct().join(sums, "source", "left").toPandas()
    if plan.empty:
        return sized.limit(0).withColumn("repeats", F.lit(0))
    short = plan[plan["have"].isna()]["source"].tolist()
    if short:
        raise ValueError(f"no texts for sources with a target share: {sorted(short)}")
    plan["target_share"] = plan["target_share"].astype(float) / plan["target_share"].astype(float).sum()
    most = float((plan["have"] * plan["max_repeats"] / plan["target_share"]).min())
    aim = most if total is None else min(float(total), most)
    plan["rate"] = np.minimum(plan["target_share"] * aim / plan["have"], plan["max_repeats"])
    plan["sure"] = np.floor(plan["rate"] + _TINY)
    plan["p"] = np.clip(plan["rate"] - plan["sure"], 0, 1)
    plan["blocks"] = np.maximum(1, np.ceil(plan["n"] / block)).astype(int)
    spark = sized.sparkSession
    rates = spark.createDataFrame(plan[["source", "sure", "p", "blocks"]], "source string, sure double, p double, blocks bigint")
    state = durable(sized.join(F.broadcast(rates), "source").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks"))))
    certain = state.where("p = 0").select("doc_id", "source", "tokens", F.col("sure").cast("int").alias("repeats"))
    schema = "doc_id " + sized.schema["doc_id"].dataType.simpleString() + ", source string, tokens bigint, sure double, p double, blocks bigint, block bigint"
    state = state.where("p > 0").select("doc_id", "source", "tokens", "sure", "p", "blocks", "block")
    done, most_blocks, all_blocks = certain, int(plan["blocks"].max()), int(plan["blocks"].sum())
    while True:
        last = most_blocks <= 1
        # A block is little data but long work, so blocks are spread by their number and not by their size.
        spread = state.repartition(min(all_blocks, MAX_PARTITIONS), "source", "block")
        state = durable(spread.groupBy("source", "block").applyInPandas(_fly(last, seed), schema))
        done = done.union(state.where("p = 0 or p = 1").select("doc_id", "source", "tokens", (F.col("sure") + F.col("p")).cast("int")))
        if last:
            return done.where("repeats > 0")
        most_blocks, all_blocks = -(-most_blocks // (block // 4)), -(-all_blocks // (block // 4)) + len(plan)
        state = state.where("p > 0 and p < 1").withColumn("block", F.floor(F.col("block") / (block // 4)))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, tokens, texts, most_repeats`` of a mixture."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats"))
    total = used.agg(F.sum("tokens").alias("total"))
    out = targets.select("source", "target_share").distinct().join(used, "source", "left").crossJoin(F.broadcast(total))
    return out.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
