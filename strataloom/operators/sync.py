"""Synchronising a stored snapshot of records with an incoming one: identities are kept, nested references rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identities(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming_id, id``: the id each incoming record (``id, logical_key``) keeps: its own if stored, else that of the
    only stored record with its logical key, else its own as a new one.

    A logical key of several records on either side identifies none. Null ids take no part.
    """
    known = stored.where("id is not null").select(F.col("id").alias("incoming_id"), F.lit(True).alias("known")).distinct()
    news = incoming.where("id is not null").select(F.col("id").alias("incoming_id"), "logical_key").distinct().join(known, "incoming_id", "left")
    taken = news.where("known").select(F.col("incoming_id").alias("id"))
    one = lambda df, name: df.where("logical_key is not null").groupBy("logical_key").agg(F.count_distinct("id").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    free = one(stored.where("id is not null").select("id", "logical_key").join(taken, "id", "left_anti"), "kept")
    fresh = one(news.where("known is null").select(F.col("incoming_id").alias("id"), "logical_key"), "fresh")
    moved = fresh.join(free, "logical_key").select(F.col("fresh").alias("incoming_id"), "kept")
    return news.select("incoming_id").distinct().join(moved, "incoming_id", "left").select("incoming_id", F.coalesce("kept", "incoming_id").alias("id"))


def sync_actions(stored: DataFrame, incoming: DataFrame, content: Column) -> DataFrame:
    """``id, incoming_id, action`` of a synchronisation: created, updated, unchanged or deleted.

    ``content`` is what makes a record differ. Stored records that no incoming one keeps are deleted; running the
    result against itself changes nothing.
    """
    kept = identities(stored, incoming)
    new = incoming.where("id is not null").withColumn("_new", content).select(F.col("id").alias("incoming_id"), "_new").distinct().join(kept, "incoming_id")
    old = stored.where("id is not null").withColumn("_old", content).select("id", "_old", F.lit(True).alias("_there")).distinct()
    both = old.join(new, "id", "full")
    action = F.when(F.col("incoming_id").isNull(), "deleted").when(F.col("_there").isNull(), "created").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return both.select("id", "incoming_id", action.alias("action"))


def rewritten(refs: DataFrame, kept: DataFrame, column: str) -> DataFrame:
    """``refs`` with the ids of ``column`` replaced by the ids kept (``incoming_id, id``); others stay."""
    to = kept.where("incoming_id <> id").select(F.col("incoming_id").alias(column), F.col("id").alias("_kept"))
    return refs.join(to, column, "left").withColumn(column, F.coalesce("_kept", column)).drop("_kept")
