"""Evidence text from its members, alignment of editions, and measured values against limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HARD_END = r"[。！？!?；;：:]\s*$"
LIST_ITEM = r"^\s*(?:[（(]\s*[0-9]+\s*[)）]|[0-9]{1,3}\s*[)）、]|[0-9]{1,3}\s)"


def joined(parts: Column) -> Column:
    """Ordered texts as one: a new line before a list item and after a hard end, a space between Latin words, else nothing."""
    start = F.element_at(parts, 1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def add(left: Column, right: Column) -> Column:
        gap = F.when(right.rlike(LIST_ITEM) | left.rlike(HARD_END), "\n").when(left.rlike("[A-Za-z0-9]$") & right.rlike("^[A-Za-z0-9]"), " ").otherwise("")
        return F.concat(left, gap, right)

    return F.when(F.size(parts) > 0, F.aggregate(rest, start, add))


def assembled(evidence: DataFrame, units: DataFrame) -> DataFrame:
    """``id, text, members, absent`` of evidence read anew from its units in member order; sections and null texts are left out."""
    m = evidence.select("id", F.explode("members").alias("m")).select("id", "m.ord", "m.source_id", "m.role")
    u = units.select(F.col("id").alias("source_id"), "kind", "text")
    read = m.where("source_id is not null").join(u, "source_id", "left")
    usable = (F.col("role") != "section") & (F.col("kind") != "heading") & (F.length(F.trim("text")) > 0)
    part = F.when(usable, F.struct("ord", "source_id", F.trim("text").alias("text")))
    df = read.groupBy("id").agg(F.sort_array(F.collect_list(part)).alias("p"), F.count("*").alias("members"), F.count_if(F.col("kind").isNull()).alias("absent"))
    return df.select("id", joined(F.col("p.text")).alias("text"), "members", "absent")


def aligned(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """``old_id, new_id`` of records that match one to one on equal keys; keys of several records on a side align none.

    Both sides are counted per key before they meet, so repeated keys never multiply. Null keys align nothing.
    """
    one = lambda df, name: df.dropna(subset=on).groupBy(*on).agg(F.countDistinct("id").alias("n"), F.min("id").alias(name)).where("n = 1").drop("n")
    return one(old, "old_id").join(one(new, "new_id"), on).select("old_id", "new_id")


def compared(limits: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """Limits with ``status`` against facts on equal keys: satisfied, not_satisfied, or unknown with a reason.

    ``limits`` has ``op, value, dimension`` (value in the common unit), ``facts`` has ``value, dimension``. Only a single
    distinct fact is compared; values compare exactly.
    """
    per = facts.dropna(subset=on).groupBy(*on).agg(F.count_distinct("dimension", "value").alias("facts"), F.min("value").alias("actual"), F.min("dimension").alias("actual_dimension"))
    df = limits.join(per, on, "left")
    a, b = F.col("actual"), F.col("value")
    passed = F.when(F.col("op") == "le", a <= b).when(F.col("op") == "lt", a < b).when(F.col("op") == "ge", a >= b).when(F.col("op") == "gt", a > b).when(F.col("op") == "eq", a == b)
    reason = F.when(F.col("facts").isNull(), "no fact").when(F.col("facts") > 1, "several facts").when(F.col("dimension").isNull() | (F.col("dimension") != F.col("actual_dimension")), "dimension").when(passed.isNull(), "operator")
    return df.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNotNull(), "unknown").when(passed, "satisfied").otherwise("not_satisfied"))
