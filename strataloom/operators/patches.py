"""Patches on keyed records: additions and replacements that are checked before they take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def patched(current: DataFrame, operations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records (``id, owner, text``) after ``operations`` (``op, target, owner, text, new_id``), and the refused operations with a reason.

    replace needs a present target of the same owner that no other operation replaces; add needs an id that is not
    taken. A refused operation leaves the old record intact; an addition whose owner holds the same text already (white
    space aside) changes nothing. Repeated operations count once.
    """
    ops = operations.select("op", "target", "owner", "text", "new_id").distinct()
    own = current.select("id", "owner", "text").distinct()
    several = ops.where("op = 'replace'").groupBy("target").agg(F.count("*").alias("n"))
    met = ops.join(own.select(F.col("id").alias("target"), F.col("owner").alias("had")), "target", "left").join(several, "target", "left")
    met = met.join(own.select(F.col("id").alias("new_id"), F.lit(True).alias("taken")), "new_id", "left")
    reason = (
        F.when(F.coalesce(~F.col("op").isin("add", "replace"), F.lit(True)), "unknown operation")
        .when((F.col("op") == "replace") & F.col("had").isNull(), "no such target")
        .when((F.col("op") == "replace") & ~F.col("had").eqNullSafe(F.col("owner")), "another owner")
        .when((F.col("op") == "replace") & (F.col("n") > 1), "replaced twice")
        .when((F.col("op") == "add") & (F.col("new_id").isNull() | F.col("taken").isNotNull()), "id taken")
    )
    judged = met.withColumn("reason", reason).select("op", "target", "owner", "text", "new_id", "reason")
    good = judged.where("reason is null")
    replaced = good.where("op = 'replace'").select(F.col("target").alias("id"), F.col("text").alias("_new"), F.lit(True).alias("_set"))
    solid = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    after = own.join(replaced, "id", "left").select("id", "owner", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("text")).alias("text"))
    added = good.where("op = 'add'").groupBy("new_id").agg(F.min(F.struct("owner", "text")).alias("b")).select(F.col("new_id").alias("id"), "b.owner", "b.text")
    fresh = added.withColumn("_k", solid(F.col("text"))).join(after.select("owner", solid(F.col("text")).alias("_k")).distinct(), ["owner", "_k"], "left_anti").select("id", "owner", "text")
    return after.union(fresh), judged.where("reason is not null")
