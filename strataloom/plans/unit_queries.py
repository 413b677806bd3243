"""Queries on quantities in common units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.units import common_quantities
from strataloom.session import table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every quantity of every statement in whole common units; values with a missing unit only where it is sure."""
    values = common_quantities(table(spark, sf_dir, "statements")).where("amount is not null and not uncertain")
    return values.select(F.col("id").alias("statement_id"), "dimension", "amount").distinct()


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of values, least and greatest amount and number of inferred and uncertain units per dimension and unit."""
    values = common_quantities(table(spark, sf_dir, "statements"))
    counts = [F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("greatest")]
    counts += [F.count_if(F.col(c)).alias(c) for c in ("inferred", "uncertain")]
    return values.groupBy("dimension", "unit").agg(*counts)


QUERIES = {"p2_found": found, "p2_profile": profile}
SQL: dict[str, str] = {}
