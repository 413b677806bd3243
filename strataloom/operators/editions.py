"""Aligning two editions of documents: evidence and sources that say the same keep their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import compact

#: Roles of members that only lend context and are no part of what an evidence says.
CONTEXT_ROLES = ("section_context", "section")


def signatures(evidence: DataFrame, units: DataFrame) -> DataFrame:
    """``id, anchor, signature, sources`` of evidence (``id, kind, context, members``): where it stands, what its members say in
    order (white space aside), and their units.

    Context members are left out. An evidence with a member whose unit is missing or has no text gets no signature.
    """
    m = evidence.select("id", "kind", F.coalesce("context.section", F.lit("")).alias("section"), F.coalesce("context.table_id", F.lit("")).alias("table_id"), F.posexplode("members").alias("pos", "m"))
    m = m.where(~F.coalesce("m.role", F.lit("")).isin(*CONTEXT_ROLES)).select("id", "kind", "section", "table_id", F.coalesce("m.ord", "pos").alias("ord"), "pos", "m.source_id", "m.role")
    u = units.where("id is not null").select(F.col("id").alias("source_id"), F.md5(compact(F.col("text"))).alias("said")).dropDuplicates(["source_id"])
    read = m.join(u, "source_id", "left").groupBy("id").agg(
        F.min(F.struct("kind", "section", "table_id")).alias("a"), F.sort_array(F.collect_list(F.struct("ord", "pos", "source_id", "role", "said"))).alias("p"), F.max(F.col("said").isNull()).alias("lacks")
    )
    said = F.concat_ws(";", F.transform("p", lambda x: F.concat_ws("/", F.coalesce(x["role"], F.lit("")), x["said"])))
    return read.where("not lacks").select("id", F.concat_ws("|", F.coalesce("a.kind", F.lit("")), "a.section", "a.table_id").alias("anchor"), F.md5(said).alias("signature"), F.col("p.source_id").alias("sources"))


def _one_to_one(pairs: DataFrame) -> DataFrame:
    """The pairs (``old_id, new_id``) whose ids stand in no other pair; counted per side, so no window holds a hot id."""
    pairs = pairs.distinct()
    once = lambda c: pairs.groupBy(c).agg(F.count("*").alias("n")).where("n = 1").select(c)
    return pairs.join(once("old_id"), "old_id", "left_semi").join(once("new_id"), "new_id", "left_semi").select("old_id", "new_id")


def align_editions(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence pairs and source pairs (``old_id, new_id``) of two tables of ``signatures``.

    Evidence aligns if anchor and signature occur once on either side; sources align at equal places of aligned evidence
    if that pairs each of them with one other only. A reworded evidence, another division into members, or one that is
    repeated without a place of its own aligns with none. Keys are counted before they meet.
    """
    key = ["anchor", "signature"]
    one = lambda df, name: df.groupBy(*key).agg(F.count_distinct("id").alias("n"), F.min(F.struct("id", "sources")).alias(name)).where("n = 1").drop("n")
    met = one(old, "o").join(one(new, "n_"), key)
    sources = met.select(F.explode(F.arrays_zip(F.col("o.sources").alias("a"), F.col("n_.sources").alias("b"))).alias("s")).select(F.col("s.a").alias("old_id"), F.col("s.b").alias("new_id"))
    return met.select(F.col("o.id").alias("old_id"), F.col("n_.id").alias("new_id")), _one_to_one(sources.where("old_id is not null and new_id is not null"))
