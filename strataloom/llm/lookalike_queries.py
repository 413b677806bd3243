"""Queries on visually identical text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.lookalike import alike_pairs, canonical
from strataloom.operators.skew import salted_join
from strataloom.session import durable, table


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    unit = table(spark, sf_dir, "source_unit").select(F.lit("source_unit").alias("tbl"), "id", "text")
    evidence = table(spark, sf_dir, "evidence").select(F.lit("evidence").alias("tbl"), "id", "text")
    entity = table(spark, sf_dir, "statements").select("id", F.explode("entities.label").alias("text"))
    return unit.union(evidence), entity, table(spark, sf_dir, "domain_classes").select("id", F.col("label").alias("text"))


def _looks(texts: DataFrame, labels: DataFrame, corpus: list[DataFrame]) -> DataFrame:
    """``tbl, id, raw, look`` of texts and labels (a label is its own id), folded and repaired together."""
    every = texts.union(labels.select(F.col("of").alias("tbl"), F.col("text").alias("id"), "text"))
    return durable(canonical(every, ["tbl", "id"], corpus).select("tbl", "id", "raw", F.md5("canonical").alias("look")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of units and evidence whose texts look the same, and statements whose label looks like a class label."""
    texts, entity, classes = _tables(spark, sf_dir)
    entity = durable(entity.where("text is not null").distinct())
    labels = entity.select("text").distinct().withColumn("of", F.lit("entity")).union(classes.select("text", F.lit("class")).where("text is not null").distinct())
    looks = _looks(texts, labels, [texts.select("text"), labels.select("text")])
    pairs = alike_pairs(looks.where("tbl in ('source_unit', 'evidence')"), "tbl")
    own = looks.where("tbl = 'class'").select(F.col("id").alias("class_label"), "look")
    alike = looks.where("tbl = 'entity'").select(F.col("id").alias("text"), "look").join(own, "look").where("text <> class_label")
    named = alike.join(classes.distinct().select(F.col("id").alias("id_a"), F.col("text").alias("class_label")), "class_label").select("id_a", "text")
    by_label = salted_join(entity, named, ["text"], F.col("id")).select(F.lit("statements").alias("tbl"), "id_a", F.col("id").alias("id_b"))
    return pairs.union(by_label.distinct())


def looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look (class of texts that look the same) of every unit and evidence, and the number of its spellings."""
    texts, _, _ = _tables(spark, sf_dir)
    rows = durable(canonical(texts, ["tbl", "id"]).select("tbl", "id", "raw", F.md5("canonical").alias("look")).distinct())
    spellings = rows.groupBy("tbl", "look").agg(F.count_distinct("raw").alias("spellings"))
    return salted_join(rows.select("tbl", "id", "look").distinct(), spellings, ["tbl", "look"], F.col("id"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of every unit, evidence and label, with the number of spellings that look like it."""
    texts, entity, classes = _tables(spark, sf_dir)
    labels = entity.select(F.lit("label").alias("tbl"), "text").union(classes.select(F.lit("label"), "text"))
    every = texts.select("tbl", "text").union(labels)
    looks = canonical(every, ["tbl"], [every.select("text")])
    return looks.groupBy("tbl", F.md5("canonical").alias("look")).agg(F.countDistinct("raw").alias("spellings"), F.count("*").alias("rows"), F.max("canonical").alias("form"))


QUERIES = {"p1_found": found, "p1_forms": forms, "p1_looks": looks}
SQL: dict[str, str] = {}
