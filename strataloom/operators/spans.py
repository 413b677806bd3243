"""Ranges: gaps and islands, section ends, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.ordered import last_before, running_sum


def spans_of(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, first, last`` of the runs of successive whole numbers; null values and repeats are left out."""
    w = Window.partitionBy(group).orderBy(value)
    df = df.select(group, value).where(F.col(value).isNotNull()).distinct().withColumn("_island", F.col(value) - F.row_number().over(w))
    return df.groupBy(group, "_island").agg(F.min(value).alias("first"), F.max(value).alias("last")).drop("_island")


def sections(headings: DataFrame) -> DataFrame:
    """``last_page`` of headings (``id, document_id, page, ord, level``): page of the next heading of no deeper level.

    For each level of a document the next heading at or above it is carried backwards over the headings, in buckets, so
    the cost is headings times levels; the last section of a document has a null end.
    """
    placed = running_sum(headings, "document_id", "page", [F.col("page"), F.col("ord"), F.col("id")], F.lit(1).cast("bigint"), "_pos")
    levels = headings.groupBy("document_id").agg(F.collect_set("level").alias("levels"))
    marked = placed.join(levels, "document_id").select("*", F.explode("levels").alias("limit"))
    marked = marked.select("*", F.concat_ws("|", "document_id", "limit").alias("_key"), (-F.col("_pos")).alias("_back"))
    ahead = last_before(marked, "_key", "_back", [F.col("id")], F.when(F.col("level") <= F.col("limit"), F.col("page")), "last_page", width=512)
    return ahead.where("limit = level").withColumnRenamed("page", "first_page").drop("levels", "limit", "_pos", "_key", "_back")


def nearest(left: DataFrame, right: DataFrame, group: str, place: str, left_id: str, right_id: str) -> DataFrame:
    """``left_id, right_id, distance``: the only nearest row of ``right`` on the line of ``place`` within a group.

    Both sides are laid in one order per group; the nearest neighbours are the last one before and the first one behind,
    carried over buckets of the line, so no pairs are formed. Ties on a place, or the same distance on both sides, give
    no row. Null places take no part.
    """
    stops = right.where(F.col(place).isNotNull()).groupBy(group, place).agg(F.count("*").alias("_n"), F.min(right_id).alias("_r"))
    rows = left.where(F.col(place).isNotNull()).select(group, place, F.col(left_id).alias("_l"), F.lit(None).cast("bigint").alias("_n"), F.lit(None).cast("string").alias("_r"))
    both = rows.unionByName(stops.withColumn("_l", F.lit(None).cast("string")))
    both = both.select("*", F.when(F.col("_r").isNotNull(), 0).otherwise(1).alias("_f"), (-F.col(place)).alias("_back"), F.coalesce("_l", F.lit("")).alias("_t"))
    stop = F.when(F.col("_r").isNotNull(), F.struct(F.col(place).alias("p"), "_n", "_r"))
    near = last_before(both, group, place, [F.col("_f"), F.col("_t")], stop, "_a")
    near = last_before(near, group, "_back", [-F.col("_f"), F.col("_t")], stop, "_b").where("_l is not null")
    da, db = F.col(place) - F.col("_a.p"), F.col("_b.p") - F.col(place)
    pick = F.when(db.isNull() | (da < db), F.col("_a")).when(da.isNull() | (db < da), F.col("_b"))
    near = near.withColumn("_x", pick).where("_x is not null and _x._n = 1")
    return near.select(F.col("_l").alias(left_id), F.col("_x._r").alias(right_id), F.abs(F.col("_x.p") - F.col(place)).alias("distance"))
