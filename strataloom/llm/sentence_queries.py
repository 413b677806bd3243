"""Queries on sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.sentences import sentences
from strataloom.session import durable, table


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact span of every sentence of evidence and statements."""
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), "id", "text") for t in ("evidence", "statements")]
    texts = durable(parts[0].union(parts[1]).where("text is not null").dropDuplicates(["tbl", "id"]))
    return sentences(texts, ["tbl", "id"])


QUERIES = {"p4_found": found}
SQL: dict[str, str] = {}
