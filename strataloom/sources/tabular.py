"""Allowlists and catalogues: tab-separated tables with ``# key=value`` lines, checked against files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """The ``# key=value`` lines of a tab-separated file, and its rows with the columns that its header names.

    Blank lines are skipped. A file without header gives an empty table without columns; the metadata lines are few
    and read by the driver, the rows are not.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    notes = lines.where("value rlike '^#'").select(F.trim(F.regexp_replace("value", "^#\\s*", "")).alias("v")).collect()
    meta = dict(n["v"].split("=", 1) for n in notes if "=" in n["v"])
    rows = spark.read.csv(path, sep="\t", header=True, comment="#")
    return meta, rows


def path_fault(path):
    """Why a relative path is refused, null if it is fine: empty, absolute, or leaving its folder."""
    return F.when(path.isNull() | (F.trim(path) == ""), "empty").when(path.rlike(r"^(/|\\|[A-Za-z]:)"), "absolute").when(path.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "escapes")


def check_allowlist(rows: DataFrame, files: DataFrame, expected: int | None = None) -> DataFrame:
    """``path, fault`` of an allowlist (``path, sha256, size_bytes``) against ``files`` (``path, sha256, size_bytes``).

    Faults: a refused path, a path listed twice, a malformed hash, a missing file, another size, another hash, and (with
    null path) another number of entries than expected. No fault gives an empty table.
    """
    listed = rows.select(F.col("path"), F.lower("sha256").alias("want"), F.col("size_bytes").cast("bigint").alias("size"))
    twice = listed.where("path is not null").groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("listed twice").alias("fault"))
    have = files.select("path", F.lower("sha256").alias("have"), F.col("size_bytes").cast("bigint").alias("actual"), F.lit(True).alias("there"))
    joined = listed.distinct().join(have, "path", "left").withColumn("refused", path_fault(F.col("path")))
    fault = (
        F.when(F.col("refused").isNotNull(), F.concat(F.lit("path "), "refused"))
        .when(~F.coalesce(F.col("want").rlike("^[0-9a-f]{64}$"), F.lit(False)), "malformed hash")
        .when(F.col("there").isNull(), "missing file")
        .when(F.col("size") != F.col("actual"), "size differs")
        .when(F.col("want") != F.col("have"), "hash differs")
    )
    out = joined.select("path", fault.alias("fault")).where("fault is not null").union(twice)
    if expected is not None:
        number = listed.agg(F.count("*").alias("n")).where(F.col("n") != expected)
        out = out.union(number.select(F.lit(None).cast("string"), F.concat(F.lit("entries: "), "n")))
    return out


def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """``path, sha256, size_bytes`` of all files below a folder; contents are hashed in the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = re.sub(r"^file:/*", "/", folder.rstrip("/"))
    plain = F.regexp_replace("path", "^file:/*", "/")
    return files.select(F.substring(plain, len(root) + 2, 10_000).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def unique_match(keys: DataFrame, catalogue: DataFrame, on: str, value: str) -> DataFrame:
    """``on, value, status`` of lookups that must match one row: found, missing or ambiguous (value null)."""
    per = catalogue.where(F.col(on).isNotNull()).groupBy(on).agg(F.countDistinct(value).alias("n"), F.min(value).alias("v"))
    df = keys.select(on).distinct().join(per, on, "left")
    status = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return df.select(on, F.when(F.col("n") == 1, F.col("v")).alias(value), status.alias("status"))
