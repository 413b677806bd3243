"""Ordered scans over groups of any size: a group is cut into buckets of its order, and what a bucket needs from the
earlier ones (a count, a sum, the last value) is worked out on one row per bucket. No task sorts a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket in units of the leading order column (pages).
WIDTH = 16


def bucket(place: Column, width: int = WIDTH) -> Column:
    """Bucket of a leading order value; null places stand before all others."""
    return F.coalesce(F.floor(place / width), F.lit(-(2**40))).cast("bigint")


def _joined(df: DataFrame, per: DataFrame, group: str) -> DataFrame:
    right = per.withColumnsRenamed({group: "_g", "_bucket": "_b"})
    return df.join(right, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b"))).drop("_g", "_b")


def running_sum(df: DataFrame, group: str, place: str, order: list[Column], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of the group up to and with each row, in an order led by ``place``."""
    rows = df.withColumns({"_bucket": bucket(F.col(place), width), "_value": value})
    w = Window.partitionBy(group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(group, "_bucket").agg(F.sum("_value").alias("_all"))
    per = per.select(group, "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_carry"))
    out = _joined(rows.withColumn("_own", F.sum("_value").over(w)), per, group)
    return out.withColumn(name, F.col("_own") + F.col("_carry")).drop("_bucket", "_value", "_own", "_carry")


def last_before(df: DataFrame, group: str, place: str, order: list[Column], value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """``df`` with the last ``value`` that is not null among the rows of the group before each row.

    ``order`` are ascending columns without nulls, led by ``place`` (nulls before all others).
    """
    rows = df.withColumns({"_bucket": bucket(F.col(place), width), "_value": value})
    lead = F.coalesce(F.col(place), F.lit(-(2**40)))
    w = Window.partitionBy(group, "_bucket").orderBy(lead, *order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(group, "_bucket").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(lead.alias("lead"), *order))).alias("_last"))
    per = per.select(group, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    out = _joined(rows.withColumn("_own", F.last("_value", ignorenulls=True).over(w)), per, group)
    return out.withColumn(name, F.coalesce("_own", "_carry")).drop("_bucket", "_value", "_own", "_carry")


def ranked(df: DataFrame, group: str, order: list[Column], buckets: list[Column], name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row within its group in ``order``, which must be total.

    ``buckets`` are leading parts of the order (its first column, the first characters of a key): rows are numbered
    within a bucket, and the buckets of a group are summed on one row each.
    """
    cut = F.struct(*(b.alias(f"b{k}") for k, b in enumerate(buckets)))
    rows = df.withColumn("_bucket", cut)
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    per = per.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)))
    right = per.withColumnsRenamed({group: "_g", "_bucket": "_b"})
    out = own.join(right, F.col(group).eqNullSafe(F.col("_g")) & F.col("_bucket").eqNullSafe(F.col("_b")))
    return out.withColumn(name, (F.col("_own") + F.col("_carry")).cast("bigint")).drop("_bucket", "_own", "_carry", "_g", "_b")
