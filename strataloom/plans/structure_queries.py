"""Queries on layout, assembly, alignment, comparisons and relations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.text import compact
from strataloom.operators.assembly import aligned, assembled, compared
from strataloom.operators.hierarchy import build_hierarchy, class_links, reachable_pairs
from strataloom.operators.layout import boxes, lines, overlaps
from strataloom.operators.limits import limits_and_facts
from strataloom.operators.records import latest
from strataloom.operators.spans import sections
from strataloom.plans.knowledge_queries import _ENT, _LAST, _MEM, _SUP, _entities, _members, _supports
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


_BOX = f"(select id, document_id, locator.physical_page as page, kind, locator.bbox[1] as x0, locator.bbox[2] as y0, locator.bbox[3] as x1, locator.bbox[4] as y1 from {_LAST['source_unit']} where locator.physical_page is not null and locator.bbox is not null and len(locator.bbox) = 4)"
_AREA = "greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0))"


@_query("j14_overlaps", f"select a.id as id_a, b.id as id_b, round({_AREA}, 6) as share from {_BOX} a join {_BOX} b on a.document_id = b.document_id and a.page = b.page and a.id < b.id where a.x1 > a.x0 and a.y1 > a.y0 and b.x1 > b.x0 and b.y1 > b.y0 and {_AREA} > 0.2")
def j14(spark, sf_dir):
    """Boxes of a page that overlap by more than a fifth of the smaller one."""
    return overlaps(boxes(_latest(spark, sf_dir, "source_unit")), 0.2).withColumn("share", F.round("share", 6))


_ABOVE = "max(y1) over (partition by document_id, page order by y0, y1, x0, id rows between unbounded preceding and 1 preceding)"
_LINES = f"(select *, sum(fresh) over (partition by document_id, page order by y0, y1, x0, id) as line from (select *, case when {_ABOVE} is null or y0 > {_ABOVE} then 1 else 0 end as fresh from {_BOX}))"


@_query("s14_lines", f"select document_id, page, line, count(*) as boxes, min(x0) as x0 from {_LINES} group by document_id, page, line")
def s14(spark, sf_dir):
    """Printed lines of every page: boxes that overlap in height, directly or through others."""
    return lines(boxes(_latest(spark, sf_dir, "source_unit"))).groupBy("document_id", "page", "line").agg(F.count("*").alias("boxes"), F.min("x0").alias("x0"))


@_query("t1_tables", f"""select document_id, page, count(*) as cells, count(distinct round(y0 / 20)) as bands, min(y0) as top, max(y1) as bottom from {_BOX} where kind = 'cell' group by document_id, page""")
def t1(spark, sf_dir):
    """Cells of every page with the number of bands they stand in."""
    return boxes(_latest(spark, sf_dir, "source_unit"), ["cell"]).groupBy("document_id", "page").agg(F.count("*").alias("cells"), F.countDistinct(F.round(F.col("y0") / 20)).alias("bands"), F.min("y0").alias("top"), F.max("y1").alias("bottom"))


_GAP = "case when regexp_matches(y, '^\\s*([（(]\\s*[0-9]+\\s*[)）]|[0-9]{1,3}\\s*[)）、]|[0-9]{1,3}\\s)') or regexp_matches(x, '[。！？!?；;：:]\\s*$') then chr(10) when regexp_matches(x, '[A-Za-z0-9]$') and regexp_matches(y, '^[A-Za-z0-9]') then ' ' else '' end"


@_query("r8_assembled", f"""select id, case when len(p) > 0 then list_reduce(p, lambda x, y: x || {_GAP} || y) end as text, members, absent from
(select m.evidence_id as id, coalesce(list(trim(u.text, ' ') order by m.ord, m.source_id, trim(u.text, ' ')) filter (where m.role <> 'section' and u.kind <> 'heading' and length(trim(u.text, ' ')) > 0), []) as p, count(*) as members, count(*) filter (where u.kind is null) as absent
from {_MEM} m left join {_LAST['source_unit']} u on u.id = m.source_id where m.source_id is not null group by m.evidence_id)""")
def r8(spark, sf_dir):
    """Evidence text assembled anew from the units of its members."""
    return assembled(_latest(spark, sf_dir, "evidence"), _latest(spark, sf_dir, "source_unit"))


@_query("j11_alignment", """with e as (select id, kind, md5(regexp_replace(text, '\\s+', '', 'g')) as sig, min(ingested_at) over (partition by id) as seen from evidence where text is not null and id is not null),
o as (select kind, sig, min(id) as old_id from e where seen < timestamptz '2024-07-01 00:00:00+00' group by kind, sig having count(distinct id) = 1),
n as (select kind, sig, min(id) as new_id from e where seen >= timestamptz '2024-07-01 00:00:00+00' group by kind, sig having count(distinct id) = 1)
select old_id, new_id from o join n using (kind, sig)""")
def j11(spark, sf_dir):
    """Evidence of before and after a date that says the same, one to one."""
    e = table(spark, sf_dir, "evidence").where("text is not null and id is not null")
    e = e.groupBy("id", "kind", F.md5(compact(F.col("text"))).alias("sig")).agg(F.min("ingested_at").alias("seen"))
    cut = F.lit("2024-07-01T00:00:00Z").cast("timestamp")
    return aligned(e.where(F.col("seen") < cut), e.where(F.col("seen") >= cut), ["kind", "sig"])


@_query("x11_comparisons")
def x11(spark, sf_dir):
    """Limits of statements against the single measured value of the same tag and parameter."""
    read = durable(limits_and_facts(_latest(spark, sf_dir, "statements")))
    rules = read.where("op is not null and tag is not null").select("id", "tag", "parameter", "op", "dimension", F.col("common").alias("value"))
    # A measured value whose unit is not known still is a fact: it stands beside the others and equals no dimension.
    other = F.concat(F.lit("unit "), F.coalesce("unit", F.lit("")))
    facts = read.where("op is null").select("tag", "parameter", F.coalesce("dimension", other).alias("dimension"), F.coalesce("common", "value").alias("value"))
    return compared(rules, facts, ["tag", "parameter"]).select("id", "tag", "parameter", "op", "status")


_CLOSURE = """recursive nodes as (select distinct id from domain_classes where id is not null union select id from business_classes),
raw as (select id as child, parent from domain_classes union select id, unnest(additional_parents) from domain_classes union select id, parent from business_classes),
links as (select distinct child, parent from raw where parent in (select id from nodes) and child is not null),
reach(node, anc) as (select child, parent from links union select r.node, l.parent from reach r join links l on l.child = r.anc)"""


def _closure(spark, sf_dir) -> DataFrame:
    return reachable_pairs(build_hierarchy(*class_links(table(spark, sf_dir, "domain_classes"), table(spark, sf_dir, "business_classes"))))


@_query("f13_kind_faults", f"""with {_CLOSURE} select distinct e.id, e.class_id, e.kind from {_ENT} e where e.class_id is not null and e.kind is not null and e.class_id in (select id from nodes) and e.class_id <> e.kind
and not exists (select 1 from reach r where r.node = e.class_id and r.anc = e.kind)""")
def f13(spark, sf_dir):
    """Entities whose class does not lead up to the kind they are given."""
    pairs = _closure(spark, sf_dir).select(F.col("node").alias("class_id"), F.col("anc").alias("kind"))
    known = table(spark, sf_dir, "domain_classes").select("id").union(table(spark, sf_dir, "business_classes").select("id")).distinct()
    e = _entities(spark, sf_dir).where("class_id is not null and kind is not null and class_id <> kind").select("id", "class_id", "kind").distinct()
    return e.join(known.withColumnRenamed("id", "class_id"), "class_id", "left_semi").join(pairs, ["class_id", "kind"], "left_anti").select("id", "class_id", "kind")


@_query("g2_most_specific", f"""with {_CLOSURE}, n as (select distinct id, class_id from {_ENT} where class_id is not null)
select a.id, a.class_id from n a where not exists (select 1 from n b join reach r on r.node = b.class_id and r.anc = a.class_id where b.id = a.id and b.class_id <> a.class_id)""")
def g2(spark, sf_dir):
    """Classes of a statement above which no other of its classes stands below."""
    n = durable(_entities(spark, sf_dir).where("class_id is not null").select("id", "class_id").distinct())
    lower = n.join(n.withColumnRenamed("class_id", "other"), "id").where("class_id <> other")
    beaten = lower.join(_closure(spark, sf_dir).select(F.col("node").alias("other"), F.col("anc").alias("class_id")), ["other", "class_id"], "left_semi").select("id", "class_id").distinct()
    return n.join(beaten, ["id", "class_id"], "left_anti")


@_query("g3_neighbours", """with raw as (select id as child, parent from domain_classes union select id, parent from business_classes), l as (select distinct child, parent from raw where parent is not null and child is not null),
w as (select child as node, parent as other, 1 as hops from l union all select a.child, b.parent, 2 from l a join l b on a.parent = b.child union all select a.child, c.parent, 3 from l a join l b on a.parent = b.child join l c on b.parent = c.child)
select node, other, min(hops) as hops from w where node <> other group by node, other""")
def g3(spark, sf_dir):
    """Ancestors within three steps with the shortest distance."""
    l = table(spark, sf_dir, "domain_classes").select("id", "parent").union(table(spark, sf_dir, "business_classes").select("id", "parent")).where("id is not null and parent is not null").distinct()
    reach = l.select(F.col("id").alias("node"), F.col("parent").alias("other"), F.lit(1).alias("hops"))
    step, up = reach, l.select(F.col("id").alias("other"), F.col("parent").alias("next"))
    for hops in (2, 3):
        step = step.join(up, "other").select("node", F.col("next").alias("other"), F.lit(hops).alias("hops"))
        reach = reach.union(step)
    return reach.where("node <> other").groupBy("node", "other").agg(F.min("hops").alias("hops"))


_HEAD = f"(select id, document_id, locator.physical_page as page, coalesce(ord, -1) as ord, len(string_split(regexp_extract(text, '^([0-9]+(?:[.][0-9]+)+)[ ]', 1), '.')) as level from {_LAST['source_unit']} where kind = 'heading' and regexp_matches(text, '^[0-9]+([.][0-9]+)+[ ]') and locator.physical_page is not null)"


@_query("j10_scopes", f"""with s as (select a.id, a.document_id, a.page as lo, min(b.page) as hi from {_HEAD} a join {_HEAD} b on b.document_id = a.document_id and b.level <= a.level and (b.page, b.ord, b.id) > (a.page, a.ord, a.id) group by a.id, a.document_id, a.page),
p as (select evidence_id, document_id, min(page) as lo, max(page) as hi from {_MEM} where page is not null group by evidence_id, document_id)
select p.evidence_id, count(*) as scopes, min(s.hi - s.lo) as narrowest from p join s on s.document_id = p.document_id and s.lo <= p.lo and p.hi <= s.hi group by p.evidence_id""")
def j10(spark, sf_dir):
    """Sections whose pages hold all pages of an evidence."""
    h = _latest(spark, sf_dir, "source_unit").where("kind = 'heading' and text rlike '^[0-9]+([.][0-9]+)+[ ]' and locator.physical_page is not null")
    h = h.select("id", "document_id", F.col("locator.physical_page").alias("page"), F.coalesce("ord", F.lit(-1)).alias("ord"), F.size(F.split(F.regexp_extract("text", "^([0-9]+(?:[.][0-9]+)+)[ ]", 1), "[.]")).alias("level"))
    s = sections(h).where("last_page is not null").select("document_id", F.col("first_page").alias("s_lo"), F.col("last_page").alias("s_hi"), F.explode(F.sequence("first_page", "last_page")).alias("lo"))
    p = _members(spark, sf_dir).where("page is not null").groupBy("evidence_id", "document_id").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    return p.join(s, ["document_id", "lo"]).where("hi <= s_hi").groupBy("evidence_id").agg(F.count("*").alias("scopes"), F.min(F.col("s_hi") - F.col("s_lo")).alias("narrowest"))


@_query("w7_content_runs", f"""select evidence_id, run, count(*) as members, min(ord) as first_ord from (select *, sum(fresh) over (partition by evidence_id order by ord, member_key) as run from (select m.evidence_id, m.member_key, m.ord, case when lag(u.text) over w is null or regexp_matches(lag(u.text) over w, '[。！？!?；;：:]\\s*$') then 1 else 0 end as fresh
from {_MEM} m left join {_LAST['source_unit']} u on u.id = m.source_id where m.role = 'content' window w as (partition by m.evidence_id order by m.ord, m.member_key))) group by evidence_id, run""")
def w7(spark, sf_dir):
    """Runs of content members up to a hard end of a sentence; unread members break a run."""
    u = _latest(spark, sf_dir, "source_unit").select(F.col("id").alias("source_id"), "text")
    m = _members(spark, sf_dir).where("role = 'content'").join(u, "source_id", "left")
    w = Window.partitionBy("evidence_id").orderBy("ord", "member_key")
    before = F.lag("text").over(w)
    df = m.withColumn("fresh", F.when(before.isNull() | before.rlike("[。！？!?；;：:]\\s*$"), 1).otherwise(0)).withColumn("run", F.sum("fresh").over(w))
    return df.groupBy("evidence_id", "run").agg(F.count("*").alias("members"), F.min("ord").alias("first_ord"))


@_query("a11_citations", f"""select document_id, list(evidence_id order by first_page nulls first, evidence_id) as citations, sum(uses) as uses from (select s.document_id, s.evidence_id, min(e.context.primary_page) as first_page, count(distinct s.id) as uses from {_SUP} s join {_LAST['evidence']} e on e.id = s.evidence_id group by s.document_id, s.evidence_id) group by document_id""")
def a11(spark, sf_dir):
    """Evidence cited in each document in the order of pages, and how often."""
    e = _latest(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), F.col("context.primary_page").alias("page"))
    s = _supports(spark, sf_dir).where("evidence_id is not null").select("document_id", "evidence_id", "id").join(e, "evidence_id")
    per = s.groupBy("document_id", "evidence_id").agg(F.min("page").alias("page"), F.countDistinct("id").alias("uses"))
    return per.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page", "evidence_id")))["evidence_id"].alias("citations"), F.sum("uses").alias("uses"))


@_query("v11_redundant", f"""with b as (select distinct id, evidence_id, unnest(member_keys) as member_key from {_SUP} where evidence_id is not null), n as (select evidence_id, member_key, count(distinct id) as users from b group by evidence_id, member_key)
select b.id, count(*) as bindings from b join n using (evidence_id, member_key) group by b.id having min(users) > 1""")
def v11(spark, sf_dir):
    """Statements all of whose bindings other statements use as well."""
    b = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id", F.explode("member_keys").alias("member_key")).distinct()
    n = b.groupBy("evidence_id", "member_key").agg(F.count("*").alias("users"))
    return b.join(n, ["evidence_id", "member_key"]).groupBy("id").agg(F.count("*").alias("bindings"), F.min("users").alias("least")).where("least > 1").drop("least")


@_query("l7_priority", f"""select class_id, max(p).hits as hits, max(p).id as id from (select e.class_id, {{'rank': case when role = 'subject' then 2 when role = 'object' then 1 else 0 end, 'hits': s.n, 'id': e.id}} as p from {_ENT} e join (select id, count(*) as n from {_SUP} group by id) s using (id) where e.class_id is not null) group by class_id""")
def l7(spark, sf_dir):
    """The statement of highest priority of each class: role, supports, id."""
    s = _supports(spark, sf_dir).groupBy("id").agg(F.count("*").alias("hits"))
    rank = F.when(F.col("role") == "subject", 2).when(F.col("role") == "object", 1).otherwise(0)
    best = _entities(spark, sf_dir).where("class_id is not null").join(s, "id").groupBy("class_id").agg(F.max(F.struct(rank.alias("rank"), "hits", "id")).alias("p"))
    return best.select("class_id", "p.hits", "p.id")


@_query("s20_best_match", """with q as (select vec_id as query_id, embedding as v from embeddings where vec_id % 100 = 0),
s as (select query_id, vec_id, round(list_cosine_similarity(v, embedding), 5) as score from q, embeddings where vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s)
select a.query_id, a.vec_id, a.score, round(a.score - b.score, 5) as margin from r a join r b using (query_id) where a.r = 1 and b.r = 2""")
def s20(spark, sf_dir):
    """Best match of every hundredth vector among all, with its margin over the second."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    e = e.withColumn("norm", F.sqrt(dot(F.col("e"), F.col("e"))))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), F.col("norm").alias("q_norm"))
    s = e.crossJoin(q).where("vec_id <> query_id").select("query_id", "vec_id", F.round(dot(F.col("q"), F.col("e")) / (F.col("norm") * F.col("q_norm")), 5).alias("score"))
    top = s.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("v"))).alias("a"))
    rest = s.join(top, "query_id").where("-vec_id <> a.v").groupBy("query_id", "a").agg(F.max("score").alias("second"))
    return rest.select("query_id", (-F.col("a.v")).alias("vec_id"), "a.score", F.round(F.col("a.score") - F.col("second"), 5).alias("margin"))
