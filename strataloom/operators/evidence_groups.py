"""Evidence from located text: clauses within a block, groups of units, list parents and complete selections of members."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.operators.ordered import last_before, running_sum
from strataloom.session import discard, durable

_CLAUSE_START = re.compile(r"^[ \t　]*(\d+(?:[.．]\d+){2,})(?=\s|[一-鿿]|$)", re.M)
_SLICE = "id string, slice int, number string, start int, end int, part string"

# List markers by depth (wrapped numbers, numbers with one bracket, plain and Chinese numbers), sentence ends and lead-ins.
WRAPPED = r"^\s*[（(]\s*[0-9]+\s*[)）]"
BRACKETED = r"^\s*[0-9]{1,3}\s*[)）]([^0-9]|$)"
PLAIN = r"^\s*([0-9]{1,3}\s*、\s*\S|[0-9]{1,3}\s*[.．](\s+\S|[^0-9\s])|[0-9]{1,3}\s+\S|[一二三四五六七八九十]+\s*[、.．]\s*\S)"
HARD_END = r"[。！？!?；;：:]\s*$"
LEAD_IN = r"(下列|如下|以下).{0,12}(规定|要求|项目)|[：:]\s*$"
_FRAGMENT = r"^[\s0-9.．。；;，,、：:（）()]*$"


def clause_slices(text: str) -> list[tuple[str | None, int, int]]:
    """(number, start, end) of the clauses of a block; together they are the block, text before the first has no number."""
    starts = [(m[1].replace("．", "."), m.start()) for m in _CLAUSE_START.finditer(text)]
    if not starts or starts[0][1] > 0:
        starts.insert(0, (None, 0))
    ends = [at for _, at in starts[1:]] + [len(text)]
    return [(number, at, end) for (number, at), end in zip(starts, ends, strict=True) if end > at]


def sliced(units: DataFrame) -> DataFrame:
    """``id, slice, number, start, end, part`` of the clauses of every unit (``id, text``); null and empty texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, k, n, a, b, text[a:b]) for key, text in zip(batch["id"], batch["text"], strict=True) for k, (n, a, b) in enumerate(clause_slices(text))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SLICE.split(", ")])

    return units.where("length(text) > 0").select("id", "text").mapInPandas(run, _SLICE)


def text_groups(units: DataFrame) -> DataFrame:
    """``document_id, grp, clause, source_ids, pages, parts`` of the groups that units (``id, document_id, kind, text,
    page, ord, section``) form in reading order.

    A printed clause number of three levels or more starts a group, within a block too. Text of the same section goes on
    with the group up to the next page; a heading closes it. Headings, lone numbers and lone marks are no members, but a
    lone clause number names its group; groups without members do not come out. Null pages stand first, null places
    before all others.
    """
    body = units.where("kind not in ('cell', 'table_note', 'picture', 'caption') or kind is null").select("id", "document_id", "kind", "page", F.coalesce("ord", F.lit(-1)).alias("ord"), F.coalesce("section", F.lit("")).alias("section"), "text")
    rows = body.join(sliced(body), "id").drop("text")
    rows = rows.select("*", (F.coalesce("kind", F.lit("")) == "heading").alias("heading"), F.col("part").rlike(_FRAGMENT).alias("fragment"))
    order = [F.col("page").asc_nulls_first(), F.col("ord"), F.col("id"), F.col("slice")]
    before = last_before(rows, "document_id", "page", [F.col("ord"), F.col("id"), F.col("slice")], F.struct("page", "section", "heading"), "prev")
    fresh = F.col("heading") | F.col("number").isNotNull() | F.col("prev").isNull() | F.col("prev.heading") | (F.col("page") - F.col("prev.page") > 1) | (F.col("section") != F.col("prev.section"))
    grouped = running_sum(before, "document_id", "page", order, F.coalesce(fresh, F.lit(False)).cast("bigint"), "grp")
    member = ~F.col("heading") & ~F.col("fragment")
    part = F.when(member, F.struct(F.coalesce("page", F.lit(-1)).alias("page"), "ord", "id", "slice", F.trim("part").alias("part")))
    out = grouped.groupBy("document_id", "grp").agg(F.max("number").alias("clause"), F.sort_array(F.collect_list(part)).alias("m"))
    out = out.where("size(m) > 0")
    pages = F.array_distinct(F.filter(F.col("m.page"), lambda p: p >= 0))
    return out.select("document_id", "grp", "clause", F.array_distinct("m.id").alias("source_ids"), pages.alias("pages"), F.col("m.part").alias("parts"))


def marker_depth(text: Column) -> Column:
    """Depth of the list marker a text begins with: 3 wrapped, 2 bracketed, 1 plain or Chinese; null without one."""
    return F.when(text.rlike(WRAPPED), 3).when(text.rlike(BRACKETED), 2).when(text.rlike(PLAIN), 1)


def text_marks(text: Column) -> Column:
    """What the order of members needs of a text: depth of its list marker, whether it is filled, ends hard and leads in."""
    return F.struct(marker_depth(text).alias("depth"), (F.length(F.trim(text)) > 0).alias("filled"), text.rlike(HARD_END).alias("hard"), text.rlike(LEAD_IN).alias("leads"))


def members_in_order(members: DataFrame) -> DataFrame:
    """``members`` (``evidence_id, member_key, ord, role, text``) with ``depth``, ``run`` and ``parent_key``.

    ``marks`` (``text_marks`` of the text) may stand in place of ``text``, so that no text need be moved. A run holds the
    pieces of one phrase: a piece goes on with the one before if both are body text (not of role section), that one has
    no hard end and this one no list marker. The parent of an item is the last member before it with a marker of less
    depth, or with a lead-in and no marker. The members of one evidence are one window; null places and keys stand last.
    """
    w = Window.partitionBy("evidence_id").orderBy(F.col("ord").asc_nulls_last(), F.col("member_key").asc_nulls_last())
    rows = members if "marks" in members.columns else members.withColumn("marks", text_marks(F.col("text")))
    rows = rows.withColumn("depth", F.col("marks.depth"))
    body = F.coalesce((F.col("role") != "section") & F.col("marks.filled"), F.lit(False))
    goes_on = F.coalesce(body & F.lag(body).over(w) & ~F.lag("marks.hard").over(w) & F.col("depth").isNull(), F.lit(False))
    rows = rows.withColumn("run", F.sum((~goes_on).cast("int")).over(w))
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    lead = F.col("depth").isNull() & F.coalesce(F.col("marks.leads"), F.lit(False))
    parent = lambda d: F.last(F.when(F.coalesce(F.col("depth") < d, F.lit(False)) | lead, F.col("member_key")), ignorenulls=True).over(ahead)
    return rows.withColumn("parent_key", F.when(F.col("depth") == 1, parent(1)).when(F.col("depth") == 2, parent(2)).when(F.col("depth") == 3, parent(3))).drop("marks")


def closed_selection(selected: DataFrame, members: DataFrame) -> DataFrame:
    """``sel_id, evidence_id, member_key`` of selections completed by the rest of their phrases and the lead-ins above them.

    ``selected`` has ``sel_id, evidence_id, member_key``, ``members`` is as for ``members_in_order``. A lead-in may end a
    run that begins with an item, so the runs above one have any number. Pairs of members are never listed: runs lead to
    the runs of their parents, and how far a run leads is found once for all selections, in steps of 1, 2, 4, ... links
    until nothing new comes.
    """
    rows = durable(members_in_order(members).select("evidence_id", "run", "member_key", "parent_key").distinct())
    keys = rows.where("member_key is not null").select("evidence_id", "member_key", "run").distinct()
    above = rows.where("parent_key is not null").select("evidence_id", F.col("parent_key").alias("member_key"), F.col("run").alias("a"))
    # A key that stands in several runs leads from each to all of them, by way of the first.
    first = keys.groupBy("evidence_id", "member_key").agg(F.min("run").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = keys.join(first, ["evidence_id", "member_key"]).select("evidence_id", F.col("run").alias("a"), "b").where("a <> b")
    up = above.join(keys, ["evidence_id", "member_key"]).select("evidence_id", "a", F.col("run").alias("b"))
    hop = durable(up.union(again).union(again.select("evidence_id", "b", "a")).distinct())
    chosen = durable(selected.join(keys, ["evidence_id", "member_key"]).select("sel_id", "evidence_id", "run").distinct())
    reach = durable(chosen.select("evidence_id", "run", F.col("run").alias("a")).distinct())
    seen, now = 0, reach.count()
    while seen < now:
        wider = durable(reach.union(reach.join(hop, ["evidence_id", "a"]).select("evidence_id", "run", "b")).distinct())
        further = durable(hop.join(hop.select("evidence_id", F.col("a").alias("b"), F.col("b").alias("c")), ["evidence_id", "b"]).select("evidence_id", "a", F.col("c").alias("b")).distinct())
        discard(reach, hop)
        reach, hop, seen, now = wider, further, now, wider.count()
    runs = chosen.join(reach, ["evidence_id", "run"]).select("sel_id", "evidence_id", F.col("a").alias("run")).distinct()
    done = runs.join(rows.select("evidence_id", "run", "member_key"), ["evidence_id", "run"]).select("sel_id", "evidence_id", "member_key")
    # A null key that is selected is one member where the evidence has such a member; it leads nowhere.
    bare = selected.where("member_key is null").join(rows.where("member_key is null").select("evidence_id"), "evidence_id", "left_semi").select("sel_id", "evidence_id", "member_key")
    return done.union(bare).distinct()


# Fixed value: a clause that says what its chapter, section, document or standard applies to.
SCOPE = r"^\s*([0-9]+(\s*[.]\s*[0-9]+)*\s*)?本(章|节|文件|标准|规范)仅?适用于"


def native_scopes(members: DataFrame) -> DataFrame:
    """``evidence_id, member_key, scope, heading_key`` of content members (``evidence_id, member_key, ord, role, kind, text``)
    that declare what something applies to.

    scope is section for a chapter or section, else document. A chapter needs a heading of level 1 in the same evidence,
    a section one of a deeper level; the deepest such heading is named, and without one there is no declaration.
    """
    solid = F.regexp_replace(F.translate("text", "　．", " ."), r"\s+", "")
    said = members.where("role = 'content'").select("evidence_id", "member_key", F.regexp_extract(solid, SCOPE, 3).alias("what")).where("what <> ''")
    number = F.regexp_extract(F.translate("text", "．", "."), r"^\s*([0-9]+([.][0-9]+)*)", 1)
    level = F.when(number != "", F.size(F.split(number, "[.]"))).when(F.col("text").rlike(r"^\s*第\s*[0-9一二三四五六七八九十百]+\s*章"), 1)
    heads = members.where("kind = 'heading'").select("evidence_id", F.col("member_key").alias("head"), level.alias("level")).where("level is not null")
    met = said.join(heads, "evidence_id", "left").withColumn("fits", F.when(F.col("what") == "章", F.col("level") == 1).when(F.col("what") == "节", F.col("level") > 1).otherwise(F.lit(False)))
    best = met.groupBy("evidence_id", "member_key", "what").agg(F.max(F.when(F.col("fits"), F.struct("level", "head"))).alias("h"))
    scope = F.when(F.col("what").isin("章", "节"), "section").otherwise("document")
    return best.select("evidence_id", "member_key", scope.alias("scope"), F.col("h.head").alias("heading_key")).where("scope = 'document' or heading_key is not null")
