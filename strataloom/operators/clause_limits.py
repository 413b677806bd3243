"""Limits that single clauses of evidence state without condition, and text bound to its place among quotes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.limits import read_limits
from strataloom.functions.quantities import plain, read_quantities

# Words of conditions, of phases of work, and of places of a measurement.
_CONDITION = re.compile(r"如果|若|当|只有|除非|在[^，。；]{1,16}时|无[^，。；]{1,16}时")
_PHASE = re.compile(r"[一-鿿A-Za-z]{1,24}(?:前|后|时)|期间|阶段|工况")
_PLACE = re.compile(r"表面|侧面|端面|底部|顶部|内壁|外壁|轴端|入口|出口|中心|边缘")
_CUT = re.compile(r"[，,。；;]")
_ROW = "evidence_id string, run int, clause string, op string, value double, unit string, dimension string, common double, location string"


def clause_limits(text: str) -> list[tuple]:
    """(clause, op, value, unit, dimension, common, location) of the clauses of a text that state exactly one limit.

    A clause under a condition or within a phase, with several limits, another quantity, or several places states none.
    """
    out = []
    for clause in _CUT.split(plain(text)):
        if _CONDITION.search(clause) or _PHASE.search(clause):
            continue
        limits, _ = read_limits(clause)
        if len(limits) != 1 or sum(q.unit is not None for q in read_quantities(clause)) > 1:
            continue
        places = set(_PLACE.findall(clause))
        if len(places) < 2:
            x = limits[0]
            out.append((clause.strip(), x.op, x.value, x.unit, x.dimension, x.common, next(iter(places), None)))
    return out


def content_runs(members: DataFrame) -> DataFrame:
    """``evidence_id, run, text, member_keys`` of the readable content members (``evidence_id, member_key, ord, role, text,
    quality``) joined up to the end of a sentence or the next number; the members of one evidence are one window."""
    usable = F.coalesce((F.col("role") == "content") & ~F.coalesce("quality", F.lit("")).isin("uncertain", "needs_review", "unreadable") & F.col("text").isNotNull(), F.lit(False))
    w = Window.partitionBy("evidence_id").orderBy("ord", "member_key")
    before = F.lag(F.when(usable, F.col("text"))).over(w)
    fresh = before.isNull() | before.rlike(r"[。；;：:]\s*$") | F.col("text").rlike(r"^\s*[0-9]+([.][0-9]+)*\s+")
    rows = members.withColumns({"run": F.sum(F.when(fresh, 1).otherwise(0)).over(w), "usable": usable}).where("usable")
    per = rows.groupBy("evidence_id", "run").agg(F.sort_array(F.collect_list(F.struct("ord", "member_key", "text"))).alias("m"))
    return per.select("evidence_id", F.col("run").cast("int").alias("run"), F.array_join("m.text", "").alias("text"), F.col("m.member_key").alias("member_keys"))


def evidence_limits(runs: DataFrame) -> DataFrame:
    """The clause limits of ``runs`` (``evidence_id, run, text``) as a table."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, run, *x) for key, run, text in zip(batch["evidence_id"], batch["run"], batch["text"], strict=True) for x in clause_limits(text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ROW.split(", ")])

    return runs.select("evidence_id", "run", "text").where("text is not null").mapInPandas(read, _ROW)


def checked_facts(limits: DataFrame, facts: DataFrame) -> DataFrame:
    """``tag, parameter, candidates, status`` of measured values (``tag, parameter, dimension, common``) against clause limits.

    A clause is a candidate if it names tag and parameter before its limit; only a single candidate and a single value
    are compared, exactly, in the common unit. Clauses meet values by the tags they hold.
    """
    named = limits.select("clause", "op", "dimension", "common", F.explode(F.array_distinct(F.regexp_extract_all("clause", F.lit("([A-Z]+-[0-9]+)"), F.lit(1)))).alias("tag"))
    named = named.select("tag", "clause", "op", F.col("dimension").alias("limit_dimension"), F.col("common").alias("bound")).distinct()
    own = facts.where("tag is not null and parameter is not null").groupBy("tag", "parameter").agg(F.count_distinct("dimension", "common").alias("facts"), F.min("dimension").alias("dimension"), F.min("common").alias("actual"))
    met = own.join(named, "tag", "left").withColumn("fits", F.coalesce(F.col("clause").contains(F.col("parameter")), F.lit(False)))
    per = met.groupBy("tag", "parameter", "facts", "dimension", "actual").agg(F.count_if("fits").alias("candidates"), F.max(F.when(F.col("fits"), F.struct("op", "limit_dimension", "bound"))).alias("l"))
    a, b = F.col("actual"), F.col("l.bound")
    passed = F.when(F.col("l.op") == "le", a <= b).when(F.col("l.op") == "lt", a < b).when(F.col("l.op") == "ge", a >= b).when(F.col("l.op") == "gt", a > b).when(F.col("l.op") == "eq", a == b)
    sure = (F.col("candidates") == 1) & (F.col("facts") == 1) & (F.col("dimension") == F.col("l.limit_dimension")) & passed.isNotNull()
    return per.select("tag", "parameter", "candidates", F.when(~F.coalesce(sure, F.lit(False)), "unknown").when(passed, "satisfied").otherwise("not_satisfied").alias("status"))


def bound_text(text: str, quotes: Sequence[str]) -> list[tuple[int, int, int]] | None:
    """(quote, start, end) of the only place of a text among quotes, whatever their white space; None if there is none or several."""
    places = [(k, i) for k, quote in enumerate(quotes) for i, c in enumerate(quote) if not c.isspace()]
    solid, wanted = "".join(quotes[k][i] for k, i in places), "".join(text.split())
    at = solid.find(wanted) if wanted else -1
    if at < 0 or solid.find(wanted, at + 1) >= 0:
        return None
    out: dict[int, list[int]] = {}
    for k, i in places[at : at + len(wanted)]:
        out.setdefault(k, [i, i + 1])[1] = i + 1
    return [(k, a, b) for k, (a, b) in out.items()]


def bound_members(members: DataFrame) -> DataFrame:
    """``evidence_id, member_key, start, end``: the only place of every member's text (``evidence_id, member_key, text,
    whole``) in the text of its evidence, whatever the white space; members without or with several places give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for e, m, text, whole in zip(batch["evidence_id"], batch["member_key"], batch["text"], batch["whole"], strict=True):
                found = bound_text(text, [whole])
                rows += [(e, m, a, b) for _, a, b in found or []]
            yield pd.DataFrame(rows, columns=["evidence_id", "member_key", "start", "end"])

    return members.where("text is not null and whole is not null").select("evidence_id", "member_key", "text", "whole").mapInPandas(run, "evidence_id string, member_key string, start int, end int")
