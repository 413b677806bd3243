"""Queries of the evidence and statement model: lookups, joins, roll-ups, paging and graph steps, each with its SQL.

``SQL`` restates every query for another engine over the same tables; both sides name their columns alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.operators.components import components
from strataloom.operators.ordered import last_before, ranked, running_sum
from strataloom.operators.records import change_report, latest, merged
from strataloom.operators.skew import salted_join
from strataloom.operators.spans import nearest, sections, spans_of
from strataloom.session import durable, table

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


_LAST = {t: f"(select * exclude (rn) from (select *, row_number() over (partition by id order by ingested_at desc, created_at desc) as rn from {t} where id is not null) where rn = 1)" for t in ("source_unit", "evidence", "statements")}
_SUP = "(select id, document_id, type, s.evidence_id as evidence_id, s.member_keys as member_keys from (select id, document_id, type, unnest(supports) as s from {st}))".format(st=_LAST["statements"])
_MEM = "(select id as evidence_id, document_id, m.member_key as member_key, m.source_id as source_id, m.ord as ord, m.role as role, m.locator.physical_page as page from (select id, document_id, unnest(members) as m from {ev}))".format(ev=_LAST["evidence"])


def _supports(spark, sf_dir) -> DataFrame:
    df = _latest(spark, sf_dir, "statements").select("id", "document_id", "type", F.explode("supports").alias("s"))
    return df.select("id", "document_id", "type", "s.evidence_id", "s.member_keys")


def _members(spark, sf_dir) -> DataFrame:
    df = _latest(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), "document_id", F.explode("members").alias("m"))
    return df.select("evidence_id", "document_id", "m.member_key", "m.source_id", "m.ord", "m.role", F.col("m.locator.physical_page").alias("page"))


@_query("s1_anchor_lookup", f"""select a.id as statement_id, a.pos, a.source_id, u.kind, u.text is not null as has_text
from (select id, unnest(source_anchors).source_id as source_id, unnest(range(len(source_anchors))) as pos from {_LAST['statements']}) a
join {_LAST['source_unit']} u on u.id = a.source_id""")
def s1(spark, sf_dir):
    """Units named by the anchors of each statement, with their place in the list."""
    anchors = _latest(spark, sf_dir, "statements").select(F.col("id").alias("statement_id"), F.posexplode("source_anchors").alias("pos", "a"))
    units = _latest(spark, sf_dir, "source_unit").select(F.col("id").alias("source_id"), "kind", F.col("text").isNotNull().alias("has_text"))
    return anchors.select("statement_id", F.col("pos").cast("bigint").alias("pos"), "a.source_id").join(units, "source_id").select("statement_id", "pos", "source_id", "kind", "has_text")


@_query("s2_reading_order", f"""select document_id, id, row_number() over (partition by document_id order by locator.physical_page nulls last, ord nulls last, id) as place from {_LAST['source_unit']}""")
def s2(spark, sf_dir):
    """Every unit with its place in its document by page, order and id."""
    units = _latest(spark, sf_dir, "source_unit").select("document_id", "id", F.coalesce("locator.physical_page", F.lit(2**30)).alias("page"), F.coalesce("ord", F.lit(2**30)).alias("ord"))
    placed = running_sum(units, "document_id", "page", [F.col("page"), F.col("ord"), F.col("id")], F.lit(1).cast("bigint"), "place")
    return placed.select("document_id", "id", "place")


@_query("s5_snapshot", f"""select document_id, count(*) as units, count(distinct revision_id) as revisions, count(distinct revision_id) <= 1 as pinned from {_LAST['source_unit']} group by document_id""")
def s5(spark, sf_dir):
    """Documents with their number of units and revisions; a snapshot pins one revision."""
    df = _latest(spark, sf_dir, "source_unit").groupBy("document_id").agg(F.count("*").alias("units"), F.countDistinct("revision_id").alias("revisions"))
    return df.withColumn("pinned", F.col("revisions") <= 1)


@_query("s6_put_replace", f"select id, kind, quality, section, deleted_at is not null as gone from {_LAST['source_unit']}")
def s6(spark, sf_dir):
    """Upsert by id: the last delivery of a unit replaces the earlier ones."""
    return _latest(spark, sf_dir, "source_unit").select("id", "kind", "quality", "section", F.col("deleted_at").isNotNull().alias("gone"))


@_query("s6_put_merge", """select id, arg_max(quality, ingested_at) filter (where quality is not null) as quality, arg_max(section, ingested_at) filter (where section is not null) as section,
max(deleted_at) is not null as gone from source_unit where id is not null group by id""")
def s6_merge(spark, sf_dir):
    """Upsert by property: the last value that is not null wins."""
    df = merged(table(spark, sf_dir, "source_unit").select("id", "quality", "section", "deleted_at", "ingested_at"))
    return df.select("id", "quality", "section", F.col("deleted_at").isNotNull().alias("gone"))


@_query("s7_edges", f"""select distinct 'SUPPORTS' as kind, s.evidence_id as source, s.id as target, s.document_id from {_SUP} s where s.evidence_id in (select id from evidence)
union select distinct 'CONTAINS', m.evidence_id, m.source_id, m.document_id from {_MEM} m where m.source_id in (select id from source_unit)""")
def s7(spark, sf_dir):
    """Edges from evidence to statements and units; an edge without both ends is left out."""
    evidence, units = (table(spark, sf_dir, t).select("id").distinct() for t in ("evidence", "source_unit"))
    up = _supports(spark, sf_dir).select(F.lit("SUPPORTS").alias("kind"), F.col("evidence_id").alias("source"), F.col("id").alias("target"), "document_id").distinct()
    up = up.join(evidence.withColumnRenamed("id", "source"), "source", "left_semi").select("kind", "source", "target", "document_id")
    down = _members(spark, sf_dir).select(F.lit("CONTAINS").alias("kind"), F.col("evidence_id").alias("source"), F.col("source_id").alias("target"), "document_id").distinct()
    down = down.join(units.withColumnRenamed("id", "target"), "target", "left_semi").select("kind", "source", "target", "document_id")
    return up.union(down)


@_query("s26_page_spans", f"""select evidence_id, min(page) as first_page, max(page) as last_page from
(select evidence_id, page, page - row_number() over (partition by evidence_id order by page) as island from (select distinct evidence_id, page from {_MEM} where page is not null)) group by evidence_id, island""")
def s26(spark, sf_dir):
    """Pages of each evidence compressed to spans."""
    return spans_of(_members(spark, sf_dir).select("evidence_id", "page"), "evidence_id", "page").toDF("evidence_id", "first_page", "last_page")


@_query("s27_inventory", f"""select 'node' as what, 'evidence' as kind, count(*) as n from {_LAST['evidence']} union all select 'node', 'source_unit', count(*) from {_LAST['source_unit']}
union all select 'node', 'statements', count(*) from {_LAST['statements']} union all select 'edge', 'SUPPORTS', count(*) from {_SUP} where evidence_id is not null
union all select 'edge', 'CONTAINS', count(*) from {_MEM} where source_id is not null""")
def s27(spark, sf_dir):
    """Counts of nodes and edges."""
    parts = [_latest(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), F.lit(t).alias("kind"), "n") for t in ("evidence", "source_unit", "statements")]
    parts.append(_supports(spark, sf_dir).where("evidence_id is not null").agg(F.count("*").alias("n")).select(F.lit("edge"), F.lit("SUPPORTS"), "n"))
    parts.append(_members(spark, sf_dir).where("source_id is not null").agg(F.count("*").alias("n")).select(F.lit("edge"), F.lit("CONTAINS"), "n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


_ENT = f"(select id, document_id, type, e.label as label, e.class as kind, e.role as role, e.ontology_class_id as class_id from (select id, document_id, type, unnest(entities) as e from {_LAST['statements']}))"


def _entities(spark, sf_dir) -> DataFrame:
    df = _latest(spark, sf_dir, "statements").select("id", "document_id", "type", F.explode("entities").alias("e"))
    return df.select("id", "document_id", "type", "e.label", F.col("e.class").alias("kind"), "e.role", F.col("e.ontology_class_id").alias("class_id"))


@_query("a15_unmapped_mentions", f"select label, kind, count(*) as n from {_ENT} where class_id is null and label is not null group by label, kind")
def a15(spark, sf_dir):
    """How often each label is mentioned without a class."""
    return _entities(spark, sf_dir).where("class_id is null and label is not null").groupBy("label", "kind").agg(F.count("*").alias("n"))


@_query("f8_body_members", f"select evidence_id, count(*) as members, count(*) filter (where role not in ('section', 'section_context', 'heading', 'header', 'caption', 'note')) as body from {_MEM} group by evidence_id")
def f8(spark, sf_dir):
    """Members of each evidence and how many of them are body text by role; a null role is not body."""
    body = ~F.col("role").isin("section", "section_context", "heading", "header", "caption", "note")
    return _members(spark, sf_dir).groupBy("evidence_id").agg(F.count("*").alias("members"), F.count_if(body).alias("body"))


_WARN = "concat_ws(',', case when quality = 'pending_layout_review' then 'pending_review' end, case when text is null or text = '' then 'unreadable' end, case when section is null then 'context_incomplete' end)"


@_query("f9_warnings", f"select id, {_WARN} as warnings from {_LAST['source_unit']} where {_WARN} <> ''")
def f9(spark, sf_dir):
    """Warnings on units: layout under review, no readable text, no section."""
    flags = F.concat_ws(",", F.when(F.col("quality") == "pending_layout_review", "pending_review"), F.when(F.col("text").isNull() | (F.col("text") == ""), "unreadable"), F.when(F.col("section").isNull(), "context_incomplete"))
    return _latest(spark, sf_dir, "source_unit").select("id", flags.alias("warnings")).where("warnings <> ''")


@_query("f12_registry_faults", """select 'unknown_parent' as fault, id, parent as detail from (select distinct id, parent from domain_classes where parent is not null)
where parent not in (select id from domain_classes union select id from business_classes)
union all select 'double_label', label, cast(count(distinct id) as varchar) from domain_classes where label is not null group by label having count(distinct id) > 1
union all select 'own_parent', id, id from (select distinct id, parent from domain_classes where id = parent)""")
def f12(spark, sf_dir):
    """Faults of the class registry: parents that are not registered, labels of several classes, own parents."""
    own = table(spark, sf_dir, "domain_classes")
    known = own.select("id").union(table(spark, sf_dir, "business_classes").select("id")).distinct()
    links = own.select("id", "parent").where("parent is not null").distinct()
    lost = links.join(known.withColumnRenamed("id", "parent"), "parent", "left_anti").select(F.lit("unknown_parent").alias("fault"), "id", F.col("parent").alias("detail"))
    twice = own.where("label is not null").groupBy("label").agg(F.countDistinct("id").alias("n")).where("n > 1").select(F.lit("double_label"), "label", F.col("n").cast("string"))
    return lost.union(twice).union(links.where("id = parent").select(F.lit("own_parent"), "id", "parent"))


@_query("j1_evidence_statements", f"""select e.id as evidence_id, e.kind, coalesce(s.n, 0) as statements, s.first_id from {_LAST['evidence']} e
left join (select evidence_id, count(distinct id) as n, min(id) as first_id from {_SUP} group by evidence_id) s on s.evidence_id = e.id""")
def j1(spark, sf_dir):
    """Every evidence with the statements it supports, none included."""
    per = _supports(spark, sf_dir).where("evidence_id is not null").groupBy("evidence_id").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first_id"))
    e = _latest(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), "kind")
    return e.join(per, "evidence_id", "left").select("evidence_id", "kind", F.coalesce("n", F.lit(0)).alias("statements"), "first_id")


@_query("j2_context_evidence", f"select id, document_id from {_LAST['evidence']} where id in (select evidence_id from {_SUP} where evidence_id is not null and type = 'requirement')")
def j2(spark, sf_dir):
    """Evidence that supports a requirement."""
    wanted = _supports(spark, sf_dir).where("type = 'requirement'").select(F.col("evidence_id").alias("id")).distinct()
    return _latest(spark, sf_dir, "evidence").join(wanted, "id", "left_semi").select("id", "document_id")


@_query("j3_unused_classes", f"select distinct id from domain_classes where id not in (select class_id from {_ENT} where class_id is not null) and id not in (select parent from domain_classes where parent is not null)")
def j3(spark, sf_dir):
    """Classes that no statement names and that have no child."""
    own = table(spark, sf_dir, "domain_classes")
    used = _entities(spark, sf_dir).select(F.col("class_id").alias("id")).union(own.select("parent")).where("id is not null").distinct()
    return own.select("id").distinct().join(used, "id", "left_anti")


@_query("j4_class_statements", f"""select c.id as class_id, count(distinct e.id) as requirements from (select distinct id from domain_classes) c
left join {_ENT} e on e.class_id = c.id and e.type = 'requirement' and coalesce(e.role, '') <> 'related' group by c.id""")
def j4(spark, sf_dir):
    """Requirements per class in which it is not merely related; classes without any count 0."""
    named = _entities(spark, sf_dir).where("type = 'requirement' and coalesce(role, '') <> 'related'").groupBy("class_id").agg(F.countDistinct("id").alias("n"))
    own = table(spark, sf_dir, "domain_classes").select(F.col("id").alias("class_id")).distinct()
    return own.join(named, "class_id", "left").select("class_id", F.coalesce("n", F.lit(0)).alias("requirements"))


@_query("j12_nearest_heading", f"""with h as (select document_id, id as heading_id, locator.physical_page as page from {_LAST['source_unit']} where kind = 'heading' and locator.physical_page is not null),
e as (select id, document_id, context.primary_page as page from {_LAST['evidence']} where context.primary_page is not null),
d as (select e.id, h.heading_id, abs(h.page - e.page) as distance, rank() over (partition by e.id order by abs(h.page - e.page)) as r from e join h using (document_id))
select id, min(heading_id) as heading_id, min(distance) as distance from d where r = 1 group by id having count(*) = 1""")
def j12(spark, sf_dir):
    """The heading on the nearest page of each evidence, where there is only one."""
    h = _latest(spark, sf_dir, "source_unit").where("kind = 'heading'").select("document_id", F.col("id").alias("heading_id"), F.col("locator.physical_page").alias("page"))
    e = _latest(spark, sf_dir, "evidence").select("id", "document_id", F.col("context.primary_page").alias("page"))
    return nearest(e, h, "document_id", "page", "id", "heading_id")


@_query("g5_components", f"""with recursive l as (select distinct id as s, evidence_id as e from {_SUP} where evidence_id is not null),
pairs as (select distinct a.s as a, b.s as b from l a join l b using (e)),
reach(a, b) as (select a, b from pairs union select r.a, p.b from reach r join pairs p on p.a = r.b)
select component, count(*) as statements from (select a, min(b) as component from reach group by a) group by component""")
def g5(spark, sf_dir):
    """Groups of statements that share evidence, directly or through others, by their smallest id."""
    links = _supports(spark, sf_dir).where("evidence_id is not null").select(F.concat(F.lit("s|"), "id").alias("a"), F.concat(F.lit("e|"), "evidence_id").alias("b"))
    member = durable(components(links)).where("node like 's|%'")
    return member.groupBy("component").agg(F.min(F.substring("node", 3, 1000)).alias("first"), F.count("*").alias("statements")).select(F.col("first").alias("component"), "statements")


@_query("i3_sync_report", """with old as (select id, arg_min(md5(coalesce(text, '')), ingested_at) as t from evidence where id is not null and ingested_at < timestamptz '2024-07-01 00:00:00+00' group by id),
new as (select id, arg_max(md5(coalesce(text, '')), ingested_at) as t, max(deleted_at) as gone from evidence where id is not null group by id)
select change, count(*) as n from (select case when old.id is null then 'created' when new.gone is not null then 'deleted' when old.t <> new.t then 'updated' else 'unchanged' end as change from new left join old using (id)) group by change""")
def i3(spark, sf_dir):
    """Changes of evidence between a cut-off and the last state: created, updated, unchanged, deleted."""
    rows = table(spark, sf_dir, "evidence").where("id is not null").select("id", F.md5(F.coalesce("text", F.lit(""))).alias("content"), "ingested_at", "deleted_at")
    return change_report(rows, F.lit("2024-07-01T00:00:00Z").cast("timestamp")).groupBy("change").agg(F.count("*").alias("n"))


@_query("v7_bound_members", f"""with mk as (select distinct evidence_id, member_key from {_MEM}),
w as (select distinct id, evidence_id, unnest(member_keys) as member_key from {_SUP} where evidence_id is not null)
select w.id, count(*) as bindings, count(*) filter (where mk.member_key is null) as unbound from w left join mk using (evidence_id, member_key) group by w.id""")
def v7(spark, sf_dir):
    """Member bindings of each statement and how many of them name no member."""
    wanted = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id", F.explode("member_keys").alias("member_key")).distinct()
    known = _members(spark, sf_dir).select("evidence_id", "member_key").distinct().withColumn("ok", F.lit(True))
    return wanted.join(known, ["evidence_id", "member_key"], "left").groupBy("id").agg(F.count("*").alias("bindings"), F.count_if(F.col("ok").isNull()).alias("unbound"))


@_query("a3_merged_supports", f"""select id, evidence_id, list_sort(list_distinct(flatten(list(member_keys)))) as member_keys from {_SUP} where evidence_id is not null and member_keys is not null group by id, evidence_id""")
def a3(spark, sf_dir):
    """Supports of a statement merged per evidence, member keys distinct and sorted."""
    df = _supports(spark, sf_dir).where("evidence_id is not null and member_keys is not null").groupBy("id", "evidence_id")
    return df.agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("member_keys")))).alias("member_keys"))


@_query("a4_shared_sections", f"""select s.id, count(distinct e.id) as evidences, count(distinct e.context.section) as sections, case when count(distinct e.context.section) = 1 and count(*) = count(e.context.section) then min(e.context.section) end as shared
from (select distinct id, evidence_id from {_SUP} where evidence_id is not null) s join {_LAST['evidence']} e on e.id = s.evidence_id group by s.id""")
def a4(spark, sf_dir):
    """The section that all evidence of a statement shares, if there is one."""
    e = _latest(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), F.col("context.section").alias("section"))
    df = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id").distinct().join(e, "evidence_id")
    one = (F.countDistinct("section") == 1) & (F.count("*") == F.count("section"))
    return df.groupBy("id").agg(F.countDistinct("evidence_id").alias("evidences"), F.countDistinct("section").alias("sections"), F.when(one, F.min("section")).alias("shared"))


@_query("a5_mention_edges", f"select class_id, id as statement_id, list_sort(list_distinct(list(role))) as roles, count(*) as mentions from {_ENT} where class_id is not null and role is not null group by class_id, id")
def a5(spark, sf_dir):
    """One edge per class and statement with the roles of its mentions."""
    df = _entities(spark, sf_dir).where("class_id is not null and role is not null")
    return df.groupBy("class_id", F.col("id").alias("statement_id")).agg(F.sort_array(F.collect_set("role")).alias("roles"), F.count("*").alias("mentions"))


@_query("a7_page_status", f"""select document_id, locator.physical_page as page, count(*) as units, case when bool_or(quality is null or quality = 'unrecognized') then 'incomplete' when bool_or(quality in ('uncertain', 'pending_layout_review')) then 'pending' else 'complete' end as status
from {_LAST['source_unit']} where locator.physical_page is not null group by document_id, page""")
def a7(spark, sf_dir):
    """Status of every page by the quality of its units."""
    bad, open_ = F.col("quality").isNull() | (F.col("quality") == "unrecognized"), F.coalesce(F.col("quality").isin("uncertain", "pending_layout_review"), F.lit(False))
    df = _latest(spark, sf_dir, "source_unit").where("locator.physical_page is not null")
    status = F.when(F.max(bad), "incomplete").when(F.max(open_), "pending").otherwise("complete")
    return df.groupBy("document_id", F.col("locator.physical_page").alias("page")).agg(F.count("*").alias("units"), status.alias("status"))


@_query("a9_diagnostics", f"""select document_id, coalesce(text_origin, 'none') as origin, coalesce(quality, 'none') as state, count(*) as units, count(distinct locator.physical_page) as pages from {_LAST['source_unit']} group by all""")
def a9(spark, sf_dir):
    """Units and pages per document, origin and quality."""
    df = _latest(spark, sf_dir, "source_unit").select("document_id", F.coalesce("text_origin", F.lit("none")).alias("origin"), F.coalesce("quality", F.lit("none")).alias("state"), F.col("locator.physical_page").alias("page"))
    return df.groupBy("document_id", "origin", "state").agg(F.count("*").alias("units"), F.countDistinct("page").alias("pages"))


@_query("a13_ratios", f"""select type, count(*) as n, round(avg(len(entities)), 6) as mean_entities, round(avg(case when len(source_anchors) > 0 then 1.0 else 0.0 end), 6) as anchored from {_LAST['statements']} group by type""")
def a13(spark, sf_dir):
    """Mean number of entities and share of anchored statements per type; null lists are left out of the first mean."""
    anchored = F.when(F.coalesce(F.size("source_anchors"), F.lit(-1)) > 0, 1.0).otherwise(0.0)
    return _latest(spark, sf_dir, "statements").groupBy("type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("entities").isNotNull(), F.size("entities"))), 6).alias("mean_entities"), F.round(F.avg(anchored), 6).alias("anchored"))


@_query("a14_median_height", f"""select document_id, median(locator.bbox[4] - locator.bbox[2]) as height from {_LAST['source_unit']} where kind = 'paragraph' and locator.bbox is not null group by document_id""")
def a14(spark, sf_dir):
    """Median height of the paragraphs of each document."""
    df = _latest(spark, sf_dir, "source_unit").where("kind = 'paragraph' and locator.bbox is not null")
    return df.groupBy("document_id").agg(F.median(F.col("locator.bbox")[3] - F.col("locator.bbox")[1]).alias("height"))


@_query("w1_section_pages", f"""with h as (select id, document_id, locator.physical_page as page, ord, len(string_split(regexp_extract(text, '^([0-9]+(?:[.][0-9]+)+)[ ]', 1), '.')) as level from {_LAST['source_unit']} where kind = 'heading' and regexp_matches(text, '^[0-9]+([.][0-9]+)+[ ]') and locator.physical_page is not null),
n as (select a.id, min(b.page) as until from h a join h b on b.document_id = a.document_id and b.level <= a.level and (b.page, coalesce(b.ord, -1), b.id) > (a.page, coalesce(a.ord, -1), a.id) group by a.id)
select h.id, h.document_id, h.level, h.page as first_page, n.until as last_page from h left join n using (id)""")
def w1(spark, sf_dir):
    """Pages of every numbered section: from its heading to the next heading of the same or a higher level."""
    h = _latest(spark, sf_dir, "source_unit").where("kind = 'heading' and text rlike '^[0-9]+([.][0-9]+)+[ ]' and locator.physical_page is not null")
    h = h.select("id", "document_id", F.col("locator.physical_page").alias("page"), F.coalesce("ord", F.lit(-1)).alias("ord"), F.size(F.split(F.regexp_extract("text", "^([0-9]+(?:[.][0-9]+)+)[ ]", 1), "[.]")).cast("bigint").alias("level"))
    return sections(h).select("id", "document_id", "level", "first_page", "last_page")


@_query("w3_heading_above", f"""select id, document_id, last_value(case when kind = 'heading' then id end ignore nulls) over (partition by document_id order by locator.physical_page nulls first, coalesce(ord, -1), id rows between unbounded preceding and 1 preceding) as heading_id from {_LAST['source_unit']}""")
def w3(spark, sf_dir):
    """The heading above every unit in reading order."""
    units = _latest(spark, sf_dir, "source_unit").select("id", "document_id", "kind", F.col("locator.physical_page").alias("page"), F.coalesce("ord", F.lit(-1)).alias("ord"))
    heading = F.when(F.col("kind") == "heading", F.col("id"))
    return last_before(units, "document_id", "page", [F.col("ord"), F.col("id")], heading, "heading_id").select("id", "document_id", "heading_id")


@_query("w5_groups", f"""select document_id, grp, count(*) as units, min(place) as first_place from (select *, sum(case when kind in ('heading', 'clause') or page_gap > 1 then 1 else 0 end) over (partition by document_id order by place) as grp from
(select document_id, kind, place, page - lag(page) over (partition by document_id order by place) as page_gap from (select document_id, kind, locator.physical_page as page, row_number() over (partition by document_id order by locator.physical_page nulls first, coalesce(ord, -1), id) as place from {_LAST['source_unit']}))) group by document_id, grp""")
def w5(spark, sf_dir):
    """Runs of units that start at a heading, a clause or after a page gap."""
    units = _latest(spark, sf_dir, "source_unit").select("document_id", "id", "kind", F.col("locator.physical_page").alias("page"), F.coalesce("ord", F.lit(-1)).alias("ord"))
    order = [F.col("page").asc_nulls_first(), F.col("ord"), F.col("id")]
    units = running_sum(units, "document_id", "page", order, F.lit(1).cast("bigint"), "place")
    before = last_before(units, "document_id", "page", [F.col("ord"), F.col("id")], F.struct("page"), "previous")
    starts = F.when(F.col("kind").isin("heading", "clause") | (F.col("page") - F.col("previous.page") > 1), 1).otherwise(0).cast("bigint")
    grouped = running_sum(before, "document_id", "page", order, starts, "grp")
    return grouped.groupBy("document_id", "grp").agg(F.count("*").alias("units"), F.min("place").alias("first_place"))


@_query("w10_most_specific", f"""with n as (select distinct id, label from {_ENT} where label is not null and label <> '') select a.id, a.label from n a where not exists (select 1 from n b where b.id = a.id and b.label <> a.label and contains(b.label, a.label))""")
def w10(spark, sf_dir):
    """Labels of a statement that are not part of another of its labels."""
    names = _entities(spark, sf_dir).where("label is not null and label <> ''").groupBy("id").agg(F.collect_set("label").alias("labels"))
    kept = F.filter("labels", lambda a: ~F.exists("labels", lambda b: (b != a) & b.contains(a)))
    return names.select("id", F.explode(kept).alias("label"))


@_query("w11_fair_order", f"""select evidence_id, id, row_number() over (partition by evidence_id order by n_supports desc, id) as turn from (select id, evidence_id, count(*) over (partition by id) as n_supports from (select distinct id, evidence_id from {_SUP} where evidence_id is not null))""")
def w11(spark, sf_dir):
    """Turn of every statement within its evidence, those with most supports first."""
    df = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id").distinct().withColumn("n", -F.count("*").over(Window.partitionBy("id")))
    return ranked(df, "evidence_id", [F.col("n"), F.col("id")], [F.col("n"), F.substring("id", 1, 12)], "turn").select("evidence_id", "id", "turn")


@_query("g4_navigate", f"""select e.class_id, e.id as statement_id, m.source_id, count(*) as paths, max(case when e.role = 'subject' then 2 when e.role = 'object' then 1 else 0 end) as path_rank
from (select distinct id, class_id, role from {_ENT} where class_id is not null) e join (select distinct id, evidence_id from {_SUP}) s using (id) join (select distinct evidence_id, source_id from {_MEM} where source_id is not null) m using (evidence_id) group by e.class_id, e.id, m.source_id""")
def g4(spark, sf_dir):
    """Paths from a class over its statements and their evidence to units, with the best role on the way."""
    e = _entities(spark, sf_dir).where("class_id is not null").select("id", "class_id", "role").distinct()
    s = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id").distinct()
    m = _members(spark, sf_dir).where("source_id is not null").select("evidence_id", "source_id").distinct()
    rank = F.when(F.col("role") == "subject", 2).when(F.col("role") == "object", 1).otherwise(0)
    # Both ends are counted before they meet, so no path is formed one by one.
    ways = salted_join(s, m, ["evidence_id"], F.col("id")).groupBy("id", "source_id").agg(F.count("*").alias("ways"))
    own = e.groupBy("id", "class_id").agg(F.count("*").alias("roles"), F.max(rank).alias("path_rank"))
    return own.join(ways, "id").select("class_id", F.col("id").alias("statement_id"), "source_id", (F.col("roles") * F.col("ways")).alias("paths"), "path_rank")


@_query("l1_ranked_page", f"""select class_id, n_statements from (select class_id, count(distinct id) as n_statements from {_ENT} where class_id is not null group by class_id) order by n_statements desc, class_id limit 40 offset 40""")
def l1(spark, sf_dir):
    """The second page of 40 classes by number of statements."""
    df = _entities(spark, sf_dir).where("class_id is not null").groupBy("class_id").agg(F.countDistinct("id").alias("n_statements"))
    return df.orderBy(F.desc("n_statements"), "class_id").offset(40).limit(40)


@_query("u2_first_kind", f"""select class_id, arg_min(kind, prio) as kind from (select parent as class_id, 'parent' as kind, 0 as prio from domain_classes where parent is not null union all select unnest(additional_parents), 'additional', 1 from domain_classes
union all select class_id, 'mentioned', 2 from {_ENT} where class_id is not null) where class_id is not null group by class_id""")
def u2(spark, sf_dir):
    """How each class is referred to; the first kind of parent, additional parent, mention wins."""
    own = table(spark, sf_dir, "domain_classes")
    rows = own.select(F.col("parent").alias("class_id"), F.lit(0).alias("prio"), F.lit("parent").alias("kind"))
    rows = rows.union(own.select(F.explode("additional_parents"), F.lit(1), F.lit("additional"))).union(_entities(spark, sf_dir).select("class_id", F.lit(2), F.lit("mentioned")))
    return rows.where("class_id is not null").groupBy("class_id").agg(F.min(F.struct("prio", "kind"))["kind"].alias("kind"))


@_query("u3_stale_members", f"select distinct evidence_id, member_key from (select id as evidence_id, m.member_key as member_key from (select id, unnest(members) as m from evidence)) except select evidence_id, unnest(member_keys) from {_SUP} where evidence_id is not null")
def u3(spark, sf_dir):
    """Members that no statement uses."""
    all_ = table(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), F.explode("members.member_key").alias("member_key")).distinct()
    used = _supports(spark, sf_dir).where("evidence_id is not null").select("evidence_id", F.explode("member_keys").alias("member_key")).distinct()
    return all_.join(used, ["evidence_id", "member_key"], "left_anti")


@_query("v6_handles", f"""select id as statement_id, evidence_id, dense_rank() over (partition by document_id order by evidence_id) as handle from (select distinct document_id, id, evidence_id from {_SUP} where evidence_id is not null)""")
def v6(spark, sf_dir):
    """Short stable handles for the evidence used in a document."""
    df = durable(_supports(spark, sf_dir).where("evidence_id is not null").select("document_id", "id", "evidence_id").distinct())
    handles = ranked(df.select("document_id", "evidence_id").distinct(), "document_id", [F.col("evidence_id")], [F.substring("evidence_id", 1, 12)], "handle")
    return salted_join(df, handles, ["document_id", "evidence_id"], F.col("id")).select(F.col("id").alias("statement_id"), "evidence_id", "handle")


@_query("v2_coverage", f"""with u as (select distinct evidence_id, member_key from (select evidence_id, unnest(member_keys) as member_key from {_SUP} where evidence_id is not null))
select m.evidence_id, count(*) as required, count(u.member_key) as covered, case when count(u.member_key) = count(*) then 'complete' when count(u.member_key) = 0 then 'none' else 'partial' end as state
from (select distinct evidence_id, member_key from {_MEM} where role = 'content') m left join u using (evidence_id, member_key) group by m.evidence_id""")
def v2(spark, sf_dir):
    """How far the content members of each evidence are covered by statements."""
    used = _supports(spark, sf_dir).where("evidence_id is not null").select("evidence_id", F.explode("member_keys").alias("member_key")).distinct().withColumn("u", F.lit(1))
    df = _members(spark, sf_dir).where("role = 'content'").select("evidence_id", "member_key").distinct().join(used, ["evidence_id", "member_key"], "left")
    state = F.when(F.count("u") == F.count("*"), "complete").when(F.count("u") == 0, "none").otherwise("partial")
    return df.groupBy("evidence_id").agg(F.count("*").alias("required"), F.count("u").alias("covered"), state.alias("state"))
