"""Queries on reading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.reading_level import reading_levels
from strataloom.session import table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its reading level from 1 to 5."""
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "level_label")).select("doc_id", "level")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents and mean posterior per source and level."""
    documents = table(spark, sf_dir, "documents")
    levels = reading_levels(documents, table(spark, sf_dir, "level_label"))
    return levels.join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "level").agg(F.count("*").alias("n"), F.avg("posterior").alias("mean_posterior"))


QUERIES = {"p9_found": found, "p9_profile": profile}
SQL: dict[str, str] = {}
