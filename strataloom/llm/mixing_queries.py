"""Queries on mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm.mixing import mix, shares, token_counts
from strataloom.session import durable, table


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("source is not null")
    return mix(durable(token_counts(texts, ["doc_id", "source"])), table(spark, sf_dir, "mix_target"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mixture with their tokens and how often each is used."""
    return _mixed(spark, sf_dir)


def source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual share of all tokens, tokens, texts and most repeats per source."""
    return shares(_mixed(spark, sf_dir), table(spark, sf_dir, "mix_target"))


QUERIES = {"p8_mixed": mixed, "p8_shares": source_shares}
SQL: dict[str, str] = {}
