"""Queries on evaluation texts in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.leakage import leaked
from strataloom.session import table


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_item"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold an unbroken run of 40 or more letters or digits."""
    return _leaks(spark, sf_dir).where("kind = 'verbatim'").select("doc_id", "item_id")


def by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents and longest run per leaked item and kind of leak."""
    return _leaks(spark, sf_dir).groupBy("item_id", "kind").agg(F.count("*").alias("documents"), F.max("run").alias("longest"))


QUERIES = {"p7_found": found, "p7_by_item": by_item}
SQL: dict[str, str] = {}
