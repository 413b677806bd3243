"""Queries on text from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.scanned import defects, repaired
from strataloom.session import table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a scanned unit with its defects."""
    return defects(table(spark, sf_dir, "source_unit")).select("id", F.col("line_no").cast("int").alias("line_no"), "defect")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scanned unit as continuous readable paragraphs."""
    return repaired(table(spark, sf_dir, "source_unit"))


QUERIES = {"p6_found": found, "p6_paragraphs": paragraphs}
SQL: dict[str, str] = {}
