"""Deliveries of records: last state, merged state and change reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str = "id") -> DataFrame:
    """The last delivery of every key by ``ingested_at`` (then ``created_at``); null keys are left out.

    One pass with map-side combining of structs; no window sorts a hot key.
    """
    rest = [c for c in df.columns if c not in (key, "ingested_at", "created_at")]
    order = [F.col("ingested_at"), *([F.col("created_at")] if "created_at" in df.columns else [])]
    last = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*(F.col(c) for c in df.columns if c != key)), F.struct(*order)).alias("_r"))
    return last.select(key, *(F.col(f"_r.{c}").alias(c) for c in df.columns if c != key)) if rest or order else last.select(key)


def merged(df: DataFrame, key: str = "id", at: str = "ingested_at") -> DataFrame:
    """Per key the last value of every column that is not null."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in df.columns if c not in (key, at)))


def change_report(rows: DataFrame, since: Column) -> DataFrame:
    """``id, change`` of records (``id, content, ingested_at, deleted_at``) between a cut-off and their last state."""
    early = F.col("ingested_at") < since
    df = rows.groupBy("id").agg(
        F.min_by(F.when(early, F.col("content")), F.when(early, F.col("ingested_at"))).alias("old"),
        F.max(early).alias("known"),
        F.max_by("content", "ingested_at").alias("new"),
        F.max(F.col("deleted_at").isNotNull()).alias("gone"),
    )
    change = F.when(~F.col("known"), "created").when(F.col("gone"), "deleted").when(F.col("old") != F.col("new"), "updated").otherwise("unchanged")
    return df.select("id", change.alias("change"))
