"""Smaller queries: boxes, views, handles, reference folds and duplicates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.text import search_tokens
from strataloom.operators.layout import boxes
from strataloom.operators.records import latest
from strataloom.operators.references import numbered, references, resolve_references
from strataloom.plans.knowledge_queries import _LAST, _MEM, _members
from strataloom.plans.structure_queries import _BOX
from strataloom.plans.text_queries import _tokens
from strataloom.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


def _latest(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return latest(table(spark, sf_dir, name))


@_query("s21_rotated_boxes", f"select id, round(y0, 3) as x0, round(595.0 - x1, 3) as y0, round(y1, 3) as x1, round(595.0 - x0, 3) as y1 from {_BOX}")
def s21(spark, sf_dir):
    """Boxes of pages of 595 points width turned by a quarter."""
    b = boxes(_latest(spark, sf_dir, "source_unit"))
    return b.select("id", F.round("y0", 3).alias("x0"), F.round(F.lit(595.0) - F.col("x1"), 3).alias("y0"), F.round("y1", 3).alias("x1"), F.round(F.lit(595.0) - F.col("x0"), 3).alias("y1"))


@_query("h2_views", f"""select evidence_id, count(*) as members, count(distinct page) as pages, case when count(distinct page) = 1 then min(page) end as page from {_MEM} group by evidence_id""")
def h2(spark, sf_dir):
    """One row per evidence; the page is named only where it is the only one."""
    return _members(spark, sf_dir).groupBy("evidence_id").agg(F.count("*").alias("members"), F.countDistinct("page").alias("pages"), F.when(F.countDistinct("page") == 1, F.min("page")).alias("page"))


@_query("h26_member_orders", f"""select evidence_id, count(distinct ord) as present, max(ord) + 1 as expected, count(distinct ord) = max(ord) + 1 and min(ord) = 0 as complete from {_MEM} where ord is not null group by evidence_id""")
def h26(spark, sf_dir):
    """Whether the order numbers of an evidence's members are complete."""
    df = _members(spark, sf_dir).where("ord is not null").groupBy("evidence_id").agg(F.countDistinct("ord").alias("present"), (F.max("ord") + 1).alias("expected"), F.min("ord").alias("least"))
    return df.select("evidence_id", "present", "expected", ((F.col("present") == F.col("expected")) & (F.col("least") == 0)).alias("complete"))


@_query("v4_aliases", f"""select evidence_id, member_key, 'm' || cast(row_number() over (partition by evidence_id order by ord, member_key) - 1 as varchar) as alias from (select distinct evidence_id, member_key, ord from {_MEM})""")
def v4(spark, sf_dir):
    """Dense local names of the members of each evidence."""
    w = Window.partitionBy("evidence_id").orderBy("ord", "member_key")
    return _members(spark, sf_dir).select("evidence_id", "member_key", "ord").distinct().select("evidence_id", "member_key", F.concat(F.lit("m"), (F.row_number().over(w) - 1).cast("string")).alias("alias"))


def _resolved(spark, sf_dir) -> DataFrame:
    return resolve_references(references(_latest(spark, sf_dir, "evidence")), numbered(_latest(spark, sf_dir, "source_unit")))


@_query("v10_dependencies")
def v10(spark, sf_dir):
    """References of each evidence: blocked where missing or in part missing, deferred where not unique or in another document."""
    is_one = lambda *names: F.count_if(F.col("status").isin(*names))
    return _resolved(spark, sf_dir).groupBy("id").agg(F.count("*").alias("refs"), is_one("missing", "missing_range_endpoint").alias("blocked"), is_one("ambiguous", "ambiguous_range", "external_document").alias("deferred"))


@_query("a10_gaps")
def a10(spark, sf_dir):
    """Gaps of references, each number and state once."""
    return _resolved(spark, sf_dir).where("status <> 'resolved'").groupBy("kind", "number", "end_number", "status").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


_TERMS = ["焊缝", "检查", "间隙", "支座"]


@_query("a6_term_hits", f"select id, len(list_filter({_TERMS}, lambda t: contains(text, t))) as hits, len({_tokens('text')}) as tokens from {_LAST['evidence']} where text is not null and len(list_filter({_TERMS}, lambda t: contains(text, t))) > 0")
def a6(spark, sf_dir):
    """How many terms of a question each evidence holds."""
    hits = F.size(F.filter(F.array(*map(F.lit, _TERMS)), lambda t: F.contains(F.col("text"), t)))
    return _latest(spark, sf_dir, "evidence").where("text is not null").select("id", hits.cast("bigint").alias("hits"), F.size(search_tokens(F.col("text"))).cast("bigint").alias("tokens")).where("hits > 0")


@_query("h32_repeated_keys", """select 'evidence' as tbl, logical_key, count(distinct id) as ids from evidence where logical_key is not null group by logical_key having count(distinct id) > 1
union all select 'statements', logical_key, count(distinct id) from statements where logical_key is not null group by logical_key having count(distinct id) > 1""")
def h32(spark, sf_dir):
    """Logical keys of more than one record."""
    parts = [table(spark, sf_dir, t).where("logical_key is not null").groupBy(F.lit(t).alias("tbl"), "logical_key").agg(F.countDistinct("id").alias("ids")).where("ids > 1") for t in ("evidence", "statements")]
    return parts[0].union(parts[1])
