"""Lexical retrieval: an inverted index, phrase queries, BM25 ranking, and pages with checked cursors."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import folded, search_tokens

MAX_TERMS, MAX_TOKENS = 24, 96
K1, B = 1.2, 0.75


def _tokenised(df: DataFrame, key: str, text: str) -> DataFrame:
    whole = folded(F.coalesce(F.col(text), F.lit("")))
    tokens = df.select(key, whole.alias("_text"), search_tokens(F.col(text)).alias("_tokens")).where(F.size("_tokens") > 0)
    return tokens.withColumn("length", F.size("_tokens"))


def _postings(tokens: DataFrame, key: str) -> DataFrame:
    counted = tokens.select(key, "length", F.explode("_tokens").alias("token"), "_text")
    return counted.select("token", key, ((F.length("_text") - F.length(F.replace("_text", "token", F.lit("")))) / F.length("token")).cast("int").alias("tf"), "length")


def inverted_index(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``token, key, tf, length``: occurrences of every search token; null and empty texts have none."""
    return _postings(_tokenised(df, key, text), key)


def query_tokens(spark, query: str, terms: Sequence[str] | None = None) -> list[list[str]]:
    """Token groups of a query: one per distinct non-blank term (at most 24, of at most 96 tokens), else the query itself."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("a query needs text")
    wanted = list(dict.fromkeys(t.strip() for t in terms or [] if t.strip()))[:MAX_TERMS] or [query]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "i int, t string").select("i", search_tokens(F.col("t")).alias("tokens")).orderBy("i").collect()
    groups = [r["tokens"][:MAX_TOKENS] for r in rows if r["tokens"]]
    if not groups:
        raise ValueError("the query has no searchable text")
    return groups


def search(df: DataFrame, groups: Sequence[Sequence[str]], match: str = "all", key: str = "id", text: str = "text") -> DataFrame:
    """``key, hits, score`` of the rows in which all (any) groups occur with all their tokens.

    hits counts the groups found. score is BM25 over the distinct tokens of the query with k1 1.2 and b 0.75, lengths
    in distinct tokens; each row of ``df`` counts as a text. Only the postings of the query's tokens are formed.
    """
    if match not in ("all", "any"):
        raise ValueError("match is all or any")
    texts = _tokenised(df, key, text)
    tokens = F.array(*map(F.lit, sorted({t for g in groups for t in g})))
    sizes = texts.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    posting = _postings(texts.where(F.arrays_overlap("_tokens", tokens)).withColumn("_tokens", F.array_intersect("_tokens", tokens)), key)
    frequency = posting.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = posting.join(F.broadcast(frequency), "token").crossJoin(F.broadcast(sizes))
    found = scored.groupBy(key).agg(F.collect_set("token").alias("own"), F.sum(weight).alias("score"))
    hits = sum((F.size(F.array_except(F.array(*map(F.lit, g)), "own")) == 0).cast("int") for g in groups)
    return found.select(key, hits.alias("hits"), "score").where(F.col("hits") >= (len(groups) if match == "all" else 1))


def ladder(df: DataFrame, query: str, anchors: Sequence[str] = (), terms: Sequence[str] = (), key: str = "id", text: str = "text") -> tuple[str, DataFrame]:
    """The first step that finds anything: anchored (any anchor), original terms, all phrases, any phrase."""
    spark = df.sparkSession
    steps = [("object_anchored", anchors, "any")] if anchors else []
    steps += [("original_term_fallback", terms, "all")] if anchors and terms else []
    steps += [("all_phrases", terms, "all"), ("relaxed_phrases", terms, "any")]
    found = None
    for name, words, match in steps:
        found = search(df, query_tokens(spark, query, list(words)), match, key, text)
        if not found.isEmpty():
            return name, found
    return "relaxed_phrases", found


def page(df: DataFrame, order: Sequence, size: int, request: dict, cursor: str | None = None) -> tuple[DataFrame, str]:
    """One page of a total order and the cursor of the next; a cursor of another request is an error."""
    key = hashlib.sha256(json.dumps(request, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    offset = 0
    if cursor is not None:
        m = re.fullmatch(r"([0-9a-f]{64}):(\d+)", cursor)
        if not m or m[1] != key:
            raise ValueError("the cursor belongs to another request")
        offset = int(m[2])
    return df.orderBy(*order).offset(offset).limit(size), f"{key}:{offset + size}"
