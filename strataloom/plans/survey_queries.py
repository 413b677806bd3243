"""Queries on groups, selections, synchronisation, classes of labels, tables, checks and quantities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.text import compact, normalized
from strataloom.functions.truth import compile_condition, state
from strataloom.operators.assembly import joined
from strataloom.operators.binding import resolved_labels
from strataloom.operators.clause_limits import bound_members, checked_facts, content_runs, evidence_limits
from strataloom.operators.editions import align_editions, signatures
from strataloom.operators.evidence_groups import BRACKETED, HARD_END, LEAD_IN, PLAIN, WRAPPED, closed_selection, members_in_order, sliced, text_groups, text_marks
from strataloom.operators.hierarchy import class_links
from strataloom.operators.layout import boxes, header_rows, lines, row_groups
from strataloom.operators.limits import limits_and_facts
from strataloom.operators.names import contained_names
from strataloom.operators.patches import patched
from strataloom.operators.records import latest
from strataloom.operators.references import numbered, references, resolve_references
from strataloom.operators.retrieval import page, query_tokens, search
from strataloom.operators.skew import salted_join
from strataloom.operators.spans import spans_of
from strataloom.operators.sync import sync_actions
from strataloom.operators.units import read_texts, style_weights
from strataloom.plans.knowledge_queries import _ENT, _LAST, _MEM, _SUP, _entities, _members, _supports
from strataloom.plans.structure_queries import _BOX, _CLOSURE, _LINES, _closure
from strataloom.plans.text_queries import _plain
from strataloom.session import durable, table
from strataloom.sources.markdown import parse_documents
from strataloom.sources.tabular import path_fault, unique_match

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


def _units(spark, sf_dir) -> DataFrame:
    return _latest(spark, sf_dir, "source_unit").select("id", "document_id", "kind", "text", F.col("locator.physical_page").alias("page"), "ord", "section")


@_query("w5_text_groups")
def w5_text_groups(spark, sf_dir):
    """Groups of clauses and their text in reading order: first unit, clause number, units and pages."""
    g = text_groups(_units(spark, sf_dir))
    return g.select("document_id", F.element_at("source_ids", 1).alias("first_id"), "clause", F.size("source_ids").alias("units"), F.array_min("pages").alias("first_page"), F.array_max("pages").alias("last_page"))


@_query("w4_clause_slices")
def w4(spark, sf_dir):
    """Character ranges of the clauses of every unit that has one."""
    return sliced(_units(spark, sf_dir)).where("number is not null").select("id", "number", "start", "end")


def _member_texts(spark, sf_dir) -> DataFrame:
    u = _latest(spark, sf_dir, "source_unit").select(F.col("id").alias("source_id"), "text")
    return salted_join(_members(spark, sf_dir), u, ["source_id"], F.col("member_key"), "left").select("evidence_id", "member_key", "ord", "role", "text")


def _marked_members(spark, sf_dir) -> DataFrame:
    """Members with the marks of their texts: the texts stay where they are read.

    Members and units are both large, so they are sorted and merged: the estimate of the units' size, of compressed
    columns, would have the driver broadcast them. Hot keys are split by adaptive execution.
    """
    m = F.transform("members", lambda m: F.struct(m["member_key"].alias("member_key"), m["source_id"].alias("source_id"), m["ord"].alias("ord"), m["role"].alias("role")))
    e = latest(table(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), m.alias("m"), "ingested_at", "created_at"), "evidence_id")
    u = latest(table(spark, sf_dir, "source_unit").select(F.col("id").alias("source_id"), text_marks(F.col("text")).alias("marks"), "ingested_at", "created_at"), "source_id")
    members = e.select("evidence_id", F.explode("m").alias("m")).select("evidence_id", "m.*")
    return members.join(u.select("source_id", "marks").hint("merge"), "source_id", "left").select("evidence_id", "member_key", "ord", "role", "marks")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_DEPTH = f"case when regexp_matches(text, '{_sql(WRAPPED)}') then 3 when regexp_matches(text, '{_sql(BRACKETED)}') then 2 when regexp_matches(text, '{_sql(PLAIN)}') then 1 end"
_PARENT = "last_value(case when coalesce(depth < {d}, false) or lead then member_key end ignore nulls) over (partition by evidence_id order by ord, member_key rows between unbounded preceding and 1 preceding)"
_ORDERED = f"""m as (select m.evidence_id, m.member_key, m.ord, m.role, u.text from {_MEM} m left join {_LAST['source_unit']} u on u.id = m.source_id),
d as (select *, {_DEPTH} as depth, coalesce(role <> 'section' and length(trim(text)) > 0, false) as body from m),
e as (select *, depth is null and coalesce(regexp_matches(text, '{_sql(LEAD_IN)}'), false) as lead, case when body and coalesce(lag(body) over w, false) and not coalesce(lag(regexp_matches(text, '{_sql(HARD_END)}')) over w, true) and depth is null then 0 else 1 end as fresh from d window w as (partition by evidence_id order by ord, member_key)),
o as (select *, sum(fresh) over (partition by evidence_id order by ord, member_key) as run, case depth when 1 then {_PARENT.format(d=1)} when 2 then {_PARENT.format(d=2)} when 3 then {_PARENT.format(d=3)} end as parent_key from e)"""


@_query("w8_list_parents", f"with {_ORDERED} select evidence_id, member_key, depth, parent_key from o where depth is not null")
def w8(spark, sf_dir):
    """Depth and governing member of every list item of an evidence."""
    return members_in_order(_marked_members(spark, sf_dir)).where("depth is not null").select("evidence_id", "member_key", "depth", "parent_key")


@_query("w6_closed_supports", f"""with recursive {_ORDERED},
l as (select distinct a.evidence_id, a.member_key, b.member_key as other from o a join o b on a.evidence_id = b.evidence_id and a.run = b.run union select a.evidence_id, a.member_key, b.parent_key from o a join o b on a.evidence_id = b.evidence_id and a.run = b.run where b.parent_key is not null),
s as (select distinct id, evidence_id, member_key from (select id, evidence_id, unnest(member_keys) as member_key from {_SUP} where evidence_id is not null) where (evidence_id, member_key) in (select (evidence_id, member_key) from o)),
c as (select * from s union select c.id, c.evidence_id, l.other from c join l on l.evidence_id = c.evidence_id and l.member_key = c.member_key)
select c.id, c.evidence_id, count(*) as closed, count(s.member_key) as selected from c left join s on s.id = c.id and s.evidence_id = c.evidence_id and s.member_key = c.member_key group by c.id, c.evidence_id""")
def w6_closed(spark, sf_dir):
    """Supports completed by the rest of their phrases and the lead-ins above them: members before and after."""
    s = latest(table(spark, sf_dir, "statements").select("id", "supports", "ingested_at", "created_at")).select(F.col("id").alias("sel_id"), F.explode("supports").alias("s"))
    chosen = durable(s.where("s.evidence_id is not null").select("sel_id", "s.evidence_id", F.explode("s.member_keys").alias("member_key")).distinct())
    done = closed_selection(chosen, _marked_members(spark, sf_dir))
    both = done.join(chosen.withColumn("own", F.lit(1)), ["sel_id", "evidence_id", "member_key"], "left")
    return both.groupBy(F.col("sel_id").alias("id"), "evidence_id").agg(F.count("*").alias("closed"), F.count("own").alias("selected"))


_CUT = "timestamptz '2024-07-01 00:00:00+00'"


@_query("i3_identity_actions", f"""with st as (select id, logical_key, coalesce(text, '') as t from (select *, row_number() over (partition by id order by ingested_at desc, created_at desc) as rn from evidence where id is not null and ingested_at < {_CUT}) where rn = 1),
inc as (select id, logical_key, coalesce(text, '') as t from {_LAST['evidence']} where deleted_at is null),
f as (select logical_key, min(id) as kept from st where id not in (select id from inc) and logical_key is not null group by logical_key having count(*) = 1),
n as (select logical_key, min(id) as fresh from inc where id not in (select id from st) and logical_key is not null group by logical_key having count(*) = 1),
k as (select inc.id as incoming_id, coalesce(f.kept, inc.id) as id, inc.t from inc left join n on n.fresh = inc.id left join f on f.logical_key = n.logical_key)
select coalesce(st.id, k.id) as id, k.incoming_id, case when k.incoming_id is null then 'deleted' when st.id is null then 'created' when st.t = k.t then 'unchanged' else 'updated' end as action from st full join k on st.id = k.id""")
def i3_identity(spark, sf_dir):
    """What a synchronisation of the evidence of July 2024 with the present one does to every record, identities kept."""
    evidence = table(spark, sf_dir, "evidence")
    stored = latest(evidence.where(F.col("ingested_at") < F.lit("2024-07-01T00:00:00Z").cast("timestamp")))
    return sync_actions(stored, latest(evidence).where("deleted_at is null"), F.coalesce("text", F.lit("")))


_LINKS = """raw as (select id as child, parent from domain_classes union select id, unnest(additional_parents) from domain_classes union select id, parent from business_classes),
ns as (select distinct id from domain_classes where id is not null union select id from business_classes),
k as (select distinct child, parent from raw where child is not null and parent in (select id from ns)),
w as (select child as node, parent as other, 1 as hops from k union all select a.child, b.parent, 2 from k a join k b on a.parent = b.child union all select a.child, c.parent, 3 from k a join k b on a.parent = b.child join k c on b.parent = c.child),
r as (select node, other, 'ancestor' as kind, min(hops) as hops from w where node <> other group by node, other union all select other, node, 'descendant', min(hops) from w where node <> other group by node, other)"""


def _related(spark, sf_dir) -> DataFrame:
    _, links = class_links(table(spark, sf_dir, "domain_classes"), table(spark, sf_dir, "business_classes"))
    up = links.select(F.col("child").alias("other"), F.col("parent").alias("next"))
    step = reach = durable(links.select(F.col("child").alias("node"), F.col("parent").alias("other"), F.lit(1).alias("hops")))
    for hops in (2, 3):
        step = durable(step.join(up, "other").select("node", F.col("next").alias("other"), F.lit(hops).alias("hops")).distinct())
        reach = reach.union(step)
    near = reach.where("node <> other").groupBy("node", "other").agg(F.min("hops").alias("hops"))
    return near.select("node", "other", F.lit("ancestor").alias("kind"), "hops").union(near.select("other", "node", F.lit("descendant"), "hops"))


@_query("g3_related_classes", f"with {_LINKS} select node, other, kind, hops from r")
def g3_related(spark, sf_dir):
    """Classes above and below every class within three links of any kind, with the shortest distance."""
    return _related(spark, sf_dir)


def _first(df: DataFrame, group: str, order: list, most: int, by: str) -> DataFrame:
    """The first ``most`` rows of each group with ``place``; taken per part of a group first, so a hot group is no single task."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(16)))
    part = salted.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).where(F.col("_r") <= most)
    return part.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= most).drop("_salt", "_r")


@_query("l4_nearest_classes", f"with {_LINKS} select node, other, kind, hops, place from (select *, row_number() over (partition by node order by hops, other, kind) as place from r) where place <= 16")
def l4(spark, sf_dir):
    """The sixteen nearest classes of every class by distance and id."""
    return _first(_related(spark, sf_dir), "node", [F.col("hops"), F.col("other"), F.col("kind")], 16, "other").select("node", "other", "kind", "hops", "place")


@_query("h7_class_previews", f"select class_id, id, place from (select class_id, id, row_number() over (partition by class_id order by id) as place from (select distinct class_id, id from {_ENT} where class_id is not null)) where place <= 6")
def h7(spark, sf_dir):
    """The first six statements of every class."""
    own = _entities(spark, sf_dir).where("class_id is not null").select("class_id", "id").distinct()
    return _first(own, "class_id", [F.col("id")], 6, "id").select("class_id", "id", "place")


@_query("g4_owned_statements", f"with {_CLOSURE}, e as (select distinct id, class_id from {_ENT} where class_id is not null), a as (select class_id, id, true as own from e union all select r.anc, e.id, false from e join reach r on r.node = e.class_id) select class_id, count(distinct id) as statements, count(distinct case when own then id end) as own from a group by class_id")
def g4_owned(spark, sf_dir):
    """Statements that navigation from a class reaches: its own and those of all classes below it."""
    e = durable(_entities(spark, sf_dir).where("class_id is not null").select("id", "class_id").distinct())
    above = _closure(spark, sf_dir).select(F.col("node").alias("class_id"), "anc")
    reached = salted_join(e, above, ["class_id"], F.col("id")).select(F.col("anc").alias("class_id"), "id", F.lit(0).alias("own"))
    every = e.select("class_id", "id", F.lit(1).alias("own")).union(reached)
    per = every.groupBy("class_id", "id").agg(F.max("own").alias("own"))
    return per.groupBy("class_id").agg(F.count("*").alias("statements"), F.sum("own").alias("own"))


_FORM = "regexp_replace(lower({x}), '\\s+', '', 'g')"
_SPECIFIC = "select form, min(class_id) as class_id from (select distinct form, class_id from {h} h where not exists (select 1 from {h} o join reach r on r.node = o.class_id and r.anc = h.class_id where o.form = h.form and o.class_id <> h.class_id)) group by form having count(*) = 1"


@_query("g9_resolved_labels", f"""with {_CLOSURE},
n as (select distinct class_id, {_FORM.format(x=_plain('name'))} as form from (select id as class_id, label as name from domain_classes union all select id, unnest(aliases) from domain_classes union all select id, label from business_classes) where name is not null and class_id is not null),
l as (select distinct label, {_FORM.format(x=_plain('label'))} as form from {_ENT} where label is not null),
f as (select distinct form from l where form <> ''),
ex as (select form, case when count(distinct class_id) = 1 then min(class_id) end as class_id from f join n using (form) group by form),
hits as materialized (select f.form, n.class_id, substring(f.form, 1, length(f.form) - length(n.form)) as head, n.form as tail from f join n on f.form <> n.form and length(n.form) > 0 and ends_with(f.form, n.form) where f.form not in (select form from ex)),
q as materialized (select * from hits where head in (select form from n group by form having count(distinct class_id) = 1)),
z as materialized (select * from hits where length(tail) >= 2),
qs as ({_SPECIFIC.format(h='q')}), zs as ({_SPECIFIC.format(h='z')}),
found as (select form, class_id, 'exact' as method from ex union all select form, class_id, 'qualified' from qs union all select form, class_id, 'suffix' from zs where form not in (select form from qs))
select l.label, found.class_id, case when found.class_id is not null then method end as method from l left join found using (form) where l.form <> ''""")
def g9_resolved(spark, sf_dir):
    """Labels of statements resolved to a class: exactly, as object and kind, or by the most specific name they end with."""
    return _resolved(spark, sf_dir, durable(_closure(spark, sf_dir)))


def _resolved(spark, sf_dir, above: DataFrame) -> DataFrame:
    own, tops = table(spark, sf_dir, "domain_classes"), table(spark, sf_dir, "business_classes")
    names = own.select(F.col("id").alias("class_id"), F.col("label").alias("name")).union(own.select("id", F.explode("aliases"))).union(tops.select("id", "label"))
    return resolved_labels(_entities(spark, sf_dir).select("label"), names, above)


@_query("f14_shape_violations", f"""with {_CLOSURE}, tops as (select id from business_classes where parent is null),
d as (select distinct id, label, parent from domain_classes where id is not null), ids as (select distinct id from d),
roots as (select i.id, count(distinct r.anc) filter (where r.anc in (select id from tops)) as n from ids i left join reach r on r.node = i.id group by i.id)
select id, 'no upper class' as shape from roots where n = 0 union all select id, 'several upper classes' from roots where n > 1
union all select distinct id, 'unregistered parent' from d where parent is not null and parent not in (select id from nodes) union all select distinct id, 'empty label' from d where coalesce(trim(label), '') = '' union all select distinct node, 'circle' from reach where node = anc""")
def f14(spark, sf_dir):
    """Classes that break a shape: no or several upper classes, an unregistered parent, an empty label, a circle."""
    own, tops = table(spark, sf_dir, "domain_classes").where("id is not null").select("id", "label", "parent").distinct(), table(spark, sf_dir, "business_classes")
    up = durable(_closure(spark, sf_dir))
    reached = up.join(tops.where("parent is null").select(F.col("id").alias("anc")), "anc", "left_semi").groupBy(F.col("node").alias("id")).agg(F.countDistinct("anc").alias("n"))
    roots = own.select("id").distinct().join(reached, "id", "left")
    known = own.select(F.col("id").alias("parent")).union(tops.select("id")).distinct()
    say = lambda df, shape: df.select("id", F.lit(shape).alias("shape")).distinct()
    out = say(roots.where("n is null"), "no upper class").union(say(roots.where("n > 1"), "several upper classes"))
    out = out.union(say(own.where("parent is not null").join(known, "parent", "left_anti"), "unregistered parent"))
    return out.union(say(own.where("label is null or trim(label) = ''"), "empty label")).union(say(up.where("node = anc").select(F.col("node").alias("id")), "circle"))


@_query("x7_quantities")
def x7(spark, sf_dir):
    """Every quantity of every statement whose unit stands with it, with the unit as printed and in common units."""
    s = _latest(spark, sf_dir, "statements")
    return read_texts(s, style_weights(s)).where("unit is not null").select("id", "dimension", "unit", "amount").distinct()


@_query("x10_in_evidence")
def x10(spark, sf_dir):
    """Quantities of statements that the text of an evidence they cite holds too, in whatever unit, and those it does not."""
    s, e = _latest(spark, sf_dir, "statements"), _latest(spark, sf_dir, "evidence")
    said = durable(read_texts(s, style_weights(s)).where("amount is not null").select("id", "dimension", "amount").distinct())
    held = durable(read_texts(e, style_weights(e)).where("amount is not null").select(F.col("id").alias("evidence_id"), "dimension", "amount").distinct())
    cited = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id").distinct()
    meant = salted_join(cited, held, ["evidence_id"], F.col("id")).select("id", "dimension", "amount").distinct().withColumn("there", F.lit(True))
    return said.join(meant, ["id", "dimension", "amount"], "left").select("id", "dimension", "amount", F.coalesce("there", F.lit(False)).alias("in_evidence"))


@_query("f4_missing_parameters")
def f4(spark, sf_dir):
    """Parameters that limits ask for and no measured value gives, with the number of limits."""
    read = durable(limits_and_facts(_latest(spark, sf_dir, "statements")).where("tag is not null"))
    asked = read.where("op is not null").groupBy("tag", "parameter").agg(F.count("*").alias("limits"))
    return asked.join(read.where("op is null").select("tag", "parameter").distinct(), ["tag", "parameter"], "left_anti")


@_query("h1_missing_references")
def h1(spark, sf_dir):
    """References of statements that no evidence they cite names; clauses and sections share their numbers."""
    space = lambda df: df.select("id", F.when(F.col("kind").isin("clause", "section"), "clause").otherwise(F.col("kind")).alias("kind"), F.explode(F.array_compact(F.array("number", "end_number"))).alias("number")).distinct()
    s = _latest(spark, sf_dir, "statements").withColumn("context", F.struct(F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("primary_page")))
    named = durable(space(references(s)))
    held = durable(space(references(_latest(spark, sf_dir, "evidence")))).withColumnRenamed("id", "evidence_id")
    cited = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id").distinct().join(named.select("id").distinct(), "id", "left_semi")
    return named.join(salted_join(cited, held, ["evidence_id"], F.col("id")).select("id", "kind", "number").distinct(), ["id", "kind", "number"], "left_anti").select("id", "kind", "number")


_CELLS = f"""c as (select document_id || '/' || page as table_id, dense_rank() over (partition by document_id, page order by y0) - 1 as row_index, dense_rank() over (partition by document_id, page order by x0) - 1 as column_index, text from (select b.*, u.text from {_BOX} b join {_LAST['source_unit']} u using (id) where b.kind = 'cell'))"""


def _cells(spark, sf_dir) -> DataFrame:
    units = _latest(spark, sf_dir, "source_unit").where("kind = 'cell'")
    own = boxes(units).join(units.select("id", "text"), "id")
    page = Window.partitionBy("document_id", "page")
    return own.select(F.concat_ws("/", "document_id", "page").alias("table_id"), (F.dense_rank().over(page.orderBy("y0")) - 1).alias("row_index"), (F.dense_rank().over(page.orderBy("x0")) - 1).alias("column_index"), "text", F.lit(False).alias("column_header"))


@_query("f7_header_states", f"""with {_CELLS},
n as (select *, coalesce(regexp_matches(text, '^\\s*[±+\\-−]?\\s*[0-9]+(?:[.,][0-9]+)?\\s*$'), false) as num, coalesce(regexp_matches(text, '[(（][A-Za-z°℃%/µμ‰]+[)）]\\s*$'), false) as unit from c),
p as (select table_id, column_index, bool_or(num) filter (where row_index = 0) as head_num, bool_or(unit) filter (where row_index = 0) as head_unit, bool_and(num) filter (where row_index > 0) as all_num, count(distinct row_index) filter (where row_index > 0) as rows from n group by table_id, column_index),
t as (select table_id, bool_and(coalesce(not head_num, false)) as words, count(*) filter (where coalesce(head_unit and all_num and rows >= 2, false)) as units from p group by table_id)
select table_id, case when words and units > 0 then 'inferred' else 'unknown' end as state, units as unit_columns from t""")
def f7(spark, sf_dir):
    """Whether the first row of cells of every page is a header, and the number of its columns with a unit."""
    return header_rows(_cells(spark, sf_dir)).select("table_id", "state", F.size("unit_columns").cast("bigint").alias("unit_columns"))


@_query("s16_reading_order", f"select id, row_number() over (partition by document_id, page order by line, x0, id) as place from {_LINES}")
def s16(spark, sf_dir):
    """Boxes of every page in the order of lines and, within a line, from left to right."""
    order = Window.partitionBy("document_id", "page").orderBy("line", "x0", "id")
    return lines(boxes(_latest(spark, sf_dir, "source_unit"))).select("id", F.row_number().over(order).alias("place"))


@_query("s18_table_captions", f"""with t as (select document_id, page, min(x0) as x0, max(x1) as x1, min(y0) as top, max(y1) as bottom from {_BOX} where kind = 'cell' group by document_id, page),
n as (select t.document_id, t.page, c.id, t.top - c.y1 as gap, row_number() over (partition by t.document_id, t.page order by t.top - c.y1, c.id) as r from t join {_BOX} c on c.document_id = t.document_id and c.page = t.page where c.kind = 'caption' and c.y1 <= t.top and t.top - c.y1 <= 35 and c.x0 < t.x1 and c.x1 > t.x0)
select t.document_id, t.page, n.id as caption_id from t left join n on n.document_id = t.document_id and n.page = t.page and n.r = 1""")
def s18(spark, sf_dir):
    """The caption at most 35 points above the cells of a page and beside none of them, the nearest one."""
    b = boxes(_latest(spark, sf_dir, "source_unit"), ["cell", "caption"])
    t = b.where("kind = 'cell'").groupBy("document_id", "page").agg(F.min("x0").alias("left"), F.max("x1").alias("right"), F.min("y0").alias("top"))
    c = b.where("kind = 'caption'").select("document_id", "page", "id", "x0", "x1", "y1")
    near = t.join(c, ["document_id", "page"]).where("y1 <= top and top - y1 <= 35 and x0 < right and x1 > left")
    best = near.groupBy("document_id", "page").agg(F.min(F.struct(F.col("top") - F.col("y1"), F.col("id"))).alias("b")).select("document_id", "page", F.col("b.id").alias("caption_id"))
    return t.select("document_id", "page").join(best, ["document_id", "page"], "left")


@_query("h3_unread_supports", f"""select s.id, s.evidence_id, count(distinct s.member_key) filter (where m.member_key is null) as unread, count(distinct s.member_key) as members from (select id, evidence_id, unnest(member_keys) as member_key from {_SUP} where evidence_id is not null) s
left join (select distinct evidence_id, member_key from {_MEM}) m on m.evidence_id = s.evidence_id and m.member_key = s.member_key group by s.id, s.evidence_id""")
def h3(spark, sf_dir):
    """Supports with the number of their members that the evidence does not hold."""
    s = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id", F.explode("member_keys").alias("member_key")).distinct()
    m = _members(spark, sf_dir).select("evidence_id", "member_key", F.lit(1).alias("held")).distinct()
    return salted_join(s, m, ["evidence_id", "member_key"], F.col("id"), "left").groupBy("id", "evidence_id").agg(F.count_if(F.col("held").isNull()).alias("unread"), F.count("*").alias("members"))


_SAID = f"n as (select distinct label from {_ENT} where label is not null and label <> ''), h as (select e.id, n.label from (select id, text from {_LAST['evidence']} where text is not null) e join n on contains(e.text, n.label))"


@_query("j6_labels_in_evidence", f"with {_SAID} select label, count(*) as evidence from h group by label")
def j6_labels(spark, sf_dir):
    """Labels of statements that occur in evidence, with the number of evidence."""
    return _mentions(spark, sf_dir).groupBy("label").agg(F.count("*").alias("evidence"))


def _mentions(spark, sf_dir) -> DataFrame:
    labels = _entities(spark, sf_dir).select("label").where("label is not null and label <> ''").distinct()
    return contained_names(_latest(spark, sf_dir, "evidence").select("id", "text"), labels, "id", "text", "label")


@_query("h6_longest_label", f"with {_SAID}, r as (select id, label, rank() over (partition by id order by length(label) desc) as r from h) select id, case when count(*) = 1 then min(label) end as label, count(*) as ties from r where r = 1 group by id")
def h6(spark, sf_dir):
    """The longest label that an evidence names; null where several are equally long."""
    per = _mentions(spark, sf_dir).groupBy("id", F.length("label").alias("n")).agg(F.count("*").alias("ties"), F.min("label").alias("label"))
    best = per.groupBy("id").agg(F.max(F.struct("n", "ties", "label")).alias("b"))
    return best.select("id", F.when(F.col("b.ties") == 1, F.col("b.label")).alias("label"), F.col("b.ties").alias("ties"))


@_query("h22_heading_levels", f"""select id, case when number <> '' then len(string_split(number, '.')) when regexp_matches(t, '^\\s*第\\s*[0-9一二三四五六七八九十百]+\\s*章') then 1 end as level from (select id, t, regexp_extract(t, '^\\s*([0-9]+([.][0-9]+)*)([\\s\\x{{4e00}}-\\x{{9fff}}]|$)', 1) as number from (select id, {_plain('text')} as t from {_LAST['source_unit']} where kind = 'heading'))""")
def h22(spark, sf_dir):
    """Level of every heading by its printed number, 1 for chapters, null without number."""
    t = F.translate("text", "．　" + "".join(map(chr, range(0xFF10, 0xFF1A))), ". 0123456789")
    number = F.regexp_extract(t, r"^\s*([0-9]+([.][0-9]+)*)([\s\x{4e00}-\x{9fff}]|$)", 1)
    level = F.when(number != "", F.size(F.split(number, "[.]"))).when(t.rlike(r"^\s*第\s*[0-9一二三四五六七八九十百]+\s*章"), 1)
    return _latest(spark, sf_dir, "source_unit").where("kind = 'heading'").select("id", level.cast("bigint").alias("level"))


@_query("x14_ranking_terms", f"""select id, regexp_replace(regexp_replace(trim(t), '^[0-9.]+\\s*', ''), '(的?(规定|要求|方法|检查))+$', '') as term from (select id, {_plain('text')} as t from {_LAST['source_unit']} where kind = 'heading' and text is not null)""")
def x14(spark, sf_dir):
    """Terms of headings for ranking, without numbers and general endings."""
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    t = F.translate("text", wide, "".join(map(chr, range(0x21, 0x7F))) + " ")
    df = _latest(spark, sf_dir, "source_unit").where("kind = 'heading' and text is not null")
    return df.select("id", F.regexp_replace(F.regexp_replace(F.trim(t), r"^[0-9.]+\s*", ""), "(的?(规定|要求|方法|检查))+$", "").alias("term"))


@_query("h28_statement_identities", f"""select id, sha256(concat_ws(chr(1), coalesce(document_id, chr(2)), coalesce(type, chr(2)), coalesce(regexp_replace(text, '\\s+', '', 'g'), chr(2)), coalesce(array_to_string(list_sort(list_transform(entities, lambda e: coalesce(e.label, '') || '/' || coalesce(e.role, ''))), ';'), chr(2)), coalesce(array_to_string(list_sort(list_transform(source_anchors, lambda a: coalesce(a.source_id, ''))), ';'), chr(2)))) as identity from {_LAST['statements']}""")
def h28(spark, sf_dir):
    """Identity of every statement: document, type, text without spaces, its entities and anchors in any order."""
    none = F.lit("\u0002")
    bag = lambda c, f: F.coalesce(F.array_join(F.sort_array(F.transform(c, f)), ";"), none)
    empty = lambda c: F.coalesce(c, F.lit(""))
    parts = [F.coalesce("document_id", none), F.coalesce("type", none), F.coalesce(compact(F.col("text")), none)]
    parts += [bag("entities", lambda e: F.concat(empty(e["label"]), F.lit("/"), empty(e["role"]))), bag("source_anchors", lambda a: empty(a["source_id"]))]
    return _latest(spark, sf_dir, "statements").select("id", F.sha2(F.concat_ws("\u0001", *parts), 256).alias("identity"))


@_query("a1_counts", "select 'source_unit' as tbl, count(*) as n, count(distinct id) as ids, count(text) as texts from source_unit union all select 'evidence', count(*), count(distinct id), count(text) from evidence union all select 'statements', count(*), count(distinct id), count(text) from statements")
def a1(spark, sf_dir):
    """Rows, ids and texts of every table."""
    per = lambda t: table(spark, sf_dir, t).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count("text").alias("texts")).select(F.lit(t).alias("tbl"), "n", "ids", "texts")
    return per("source_unit").union(per("evidence")).union(per("statements"))


@_query("a8_page_states", f"""with u as (select id, document_id, locator.physical_page as page, kind, quality, text from {_LAST['source_unit']} where locator.physical_page is not null), m as (select distinct source_id from {_MEM} where source_id is not null)
select document_id, page, case when bool_or(coalesce(quality = 'pending_layout_review', false)) then 'pending' when bool_and(coalesce(kind = 'heading', false)) then 'not_required' when bool_or(text is null) or count(*) filter (where coalesce(kind <> 'heading', true) and id not in (select source_id from m)) > 0 then 'incomplete' else 'complete' end as state from u group by document_id, page""")
def a8(spark, sf_dir):
    """State of every page: pending a review, without anything to cover, incomplete (unread or in no evidence), or complete."""
    cited = _members(spark, sf_dir).where("source_id is not null").select(F.col("source_id").alias("id"), F.lit(True).alias("cited")).distinct()
    u = _latest(spark, sf_dir, "source_unit").where("locator.physical_page is not null").select("id", "document_id", F.col("locator.physical_page").alias("page"), "kind", "quality", "text").join(cited, "id", "left")
    heading = F.coalesce(F.col("kind") == "heading", F.lit(False))
    agg = u.groupBy("document_id", "page").agg(
        F.max(F.coalesce(F.col("quality") == "pending_layout_review", F.lit(False))).alias("pending"), F.min(heading).alias("plain"), F.max(F.col("text").isNull() | (~heading & F.col("cited").isNull())).alias("open")
    )
    return agg.select("document_id", "page", F.when(F.col("pending"), "pending").when(F.col("plain"), "not_required").when(F.col("open"), "incomplete").otherwise("complete").alias("state"))


@_query("h12_path_roots", "select split_part(relative_path, '/', 1) as root, case when relative_path is null or trim(relative_path) = '' then 'empty' when regexp_matches(relative_path, '^(/|[A-Za-z]:)') then 'absolute' when regexp_matches(relative_path, '(^|/)[.][.](/|$)') then 'escapes' else 'fine' end as fault, count(*) as n from (select distinct * from document_identity) group by 1, 2")
def h12(spark, sf_dir):
    """Folders of registered documents and why paths are refused."""
    rows = table(spark, sf_dir, "document_identity").distinct()
    return rows.groupBy(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("root"), F.coalesce(path_fault(F.col("relative_path")), F.lit("fine")).alias("fault")).agg(F.count("*").alias("n"))


@_query("s23_document_titles", """with c as (select document_id, count(distinct title) as n, min(title) as t from document_identity where document_id is not null group by document_id)
select u.document_id, case when n = 1 then t end as title, case when n = 1 then 'found' when n > 1 then 'ambiguous' else 'missing' end as status from (select distinct document_id from source_unit) u left join c using (document_id)""")
def s23(spark, sf_dir):
    """Title of every document that has units, found in the catalogue if exactly one is there."""
    return unique_match(table(spark, sf_dir, "source_unit").select("document_id"), table(spark, sf_dir, "document_identity"), "document_id", "title")


@_query("s9_text_units")
def s9(spark, sf_dir):
    """Units that the plain and Markdown parser cuts from every text of the corpus, counted by kind."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    return parse_documents(d).groupBy("document_id", "kind").agg(F.count("*").alias("units"))


@_query("x1_label_forms", f"select form, count(distinct label) as labels from (select label, {_FORM.format(x=_plain('label'))} as form from {_ENT} where label is not null) group by form")
def label_forms(spark, sf_dir):
    """Comparison forms of labels and how many labels share each."""
    return _entities(spark, sf_dir).where("label is not null").groupBy(normalized(F.col("label")).alias("form")).agg(F.countDistinct("label").alias("labels"))


@_query("i1_evidence_keys", f"""select id, sha256(concat_ws(chr(1), coalesce(document_id, chr(2)), coalesce(kind, chr(2)), coalesce(array_to_string(list_sort(list_transform(members, lambda m: coalesce(m.source_id, '') || '/' || coalesce(m.role, '') || '/' || coalesce(cast(m.locator.physical_page as varchar), '') || '/' || coalesce(array_to_string(m.locator.char_range, '-'), ''))), ';'), chr(2)), coalesce(context.table_id, chr(2)))) as print from {_LAST['evidence']}""")
def i1_evidence(spark, sf_dir):
    """Logical key of every evidence: document, kind, members with role, page and character range in any order, table."""
    none, empty = F.lit("\u0002"), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    place = lambda m: F.concat_ws("/", empty(m["source_id"]), empty(m["role"]), empty(m["locator"]["physical_page"]), empty(F.array_join(m["locator"]["char_range"], "-")))
    members = F.coalesce(F.array_join(F.sort_array(F.transform("members", place)), ";"), none)
    e = _latest(spark, sf_dir, "evidence")
    return e.select("id", F.sha2(F.concat_ws("\u0001", F.coalesce("document_id", none), F.coalesce("kind", none), members, F.coalesce("context.table_id", none)), 256).alias("print"))


@_query("i1_statement_keys", f"""select id, sha256(concat_ws(chr(1), coalesce(document_id, chr(2)), coalesce(type, chr(2)), coalesce(array_to_string(list_sort(list_transform(supports, lambda s: coalesce(s.evidence_id, '') || ':' || coalesce(array_to_string(list_sort(s.member_keys), ','), ''))), ';'), chr(2)), trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')))) as print from {_LAST['statements']}""")
def i1_statements(spark, sf_dir):
    """Logical key of every statement: document, type, supports in any order, text with white space collapsed."""
    none = F.lit("\u0002")
    support = lambda s: F.concat(F.coalesce(s["evidence_id"], F.lit("")), F.lit(":"), F.coalesce(F.array_join(F.sort_array(s["member_keys"]), ","), F.lit("")))
    supports = F.coalesce(F.array_join(F.sort_array(F.transform("supports", support)), ";"), none)
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return _latest(spark, sf_dir, "statements").select("id", F.sha2(F.concat_ws("\u0001", F.coalesce("document_id", none), F.coalesce("type", none), supports, text), 256).alias("print"))


@_query("r13_clause_limits")
def r13(spark, sf_dir):
    """Clauses of evidence that state exactly one limit without condition, with its value in the common unit."""
    return evidence_limits(durable(_runs(spark, sf_dir))).drop("value", "run")


def _runs(spark, sf_dir) -> DataFrame:
    u = _latest(spark, sf_dir, "source_unit").select(F.col("id").alias("source_id"), "text", "quality")
    return content_runs(salted_join(_members(spark, sf_dir), u, ["source_id"], F.col("member_key"), "left"))


@_query("r13_checked_facts")
def r13_checked(spark, sf_dir):
    """Measured values of statements against the only clause of an evidence that limits their parameter of their tag."""
    facts = limits_and_facts(_latest(spark, sf_dir, "statements")).where("op is null and dimension is not null")
    return checked_facts(evidence_limits(durable(_runs(spark, sf_dir))), facts)


@_query("x20_content_runs", f"""with q as (select m.evidence_id, m.member_key, m.ord, m.role, u.text, u.quality from {_MEM} m left join {_LAST['source_unit']} u on u.id = m.source_id),
b as (select *, coalesce(role = 'content' and coalesce(quality, '') not in ('uncertain', 'needs_review', 'unreadable') and text is not null, false) as usable from q),
c as (select *, lag(case when usable then text end) over (partition by evidence_id order by ord, member_key) as before from b),
r as (select *, sum(case when before is null or regexp_matches(before, '[。；;：:]\\s*$') or coalesce(regexp_matches(text, '^\\s*[0-9]+([.][0-9]+)*\\s+'), false) then 1 else 0 end) over (partition by evidence_id order by ord, member_key) as run from c)
select evidence_id, run, count(*) as members, string_agg(text, '' order by ord, member_key) as text from r where usable group by evidence_id, run""")
def x20(spark, sf_dir):
    """Text of the runs of readable content members, in which an excerpt must lie."""
    return _runs(spark, sf_dir).select("evidence_id", "run", F.size("member_keys").cast("bigint").alias("members"), "text")


@_query("x19_bound_members")
def x19(spark, sf_dir):
    """The only place of every member's text in the text of its evidence."""
    e = _latest(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), F.col("text").alias("whole"))
    return bound_members(_member_texts(spark, sf_dir).join(e, "evidence_id"))


@_query("v14_completeness", f"""with m as (select distinct evidence_id, member_key from {_MEM}),
s as (select id, count(evidence_id) as named, count(*) filter (where evidence_id is null) as unnamed, count(*) as n from {_SUP} group by id),
k as (select x.id, count(*) filter (where m.member_key is null) as unread from (select id, evidence_id, unnest(member_keys) as member_key from {_SUP} where evidence_id is not null) x left join m on m.evidence_id = x.evidence_id and m.member_key = x.member_key group by x.id)
select t.id, case when t.text is null or t.supports is null or t.source_anchors is null then 'unknown' when coalesce(s.n, 0) = 0 or s.unnamed > 0 or len(t.source_anchors) = 0 or coalesce(k.unread, 0) > 0 then 'incomplete' else 'complete' end as verdict from {_LAST['statements']} t left join s using (id) left join k using (id)""")
def v14(spark, sf_dir):
    """Whether every statement has a text, anchors and supports all of whose members exist; unknown where a part is null."""
    s = _latest(spark, sf_dir, "statements").select("id", "text", "supports", F.size("source_anchors").alias("anchors"), F.col("source_anchors").isNull().alias("bare"))
    unread = h3(spark, sf_dir).groupBy("id").agg(F.sum("unread").alias("unread"))
    df = s.join(unread, "id", "left")
    unnamed = F.exists("supports", lambda x: x["evidence_id"].isNull())
    verdict = F.when(F.col("text").isNull() | F.col("supports").isNull() | F.col("bare"), "unknown").when((F.size("supports") == 0) | unnamed | (F.col("anchors") == 0) | (F.coalesce("unread", F.lit(0)) > 0), "incomplete")
    return df.select("id", verdict.otherwise("complete").alias("verdict"))


_BEFORE = f"(select id, document_id, text from (select *, row_number() over (partition by id order by ingested_at desc, created_at desc) as rn from statements where id is not null and ingested_at < {_CUT}) where rn = 1)"


@_query("v9_patched", f"""with c as {_BEFORE}, l as {_LAST['statements']},
o as (select case when c.id is null then 'add' else 'replace' end as op, l.id, l.document_id, l.text from l left join c on c.id = l.id),
a as (select c.id, c.document_id as owner, case when o.op = 'replace' then o.text else c.text end as text from c left join o on o.id = c.id and o.op = 'replace' and o.document_id is not distinct from c.document_id),
f as (select o.id, o.document_id as owner, o.text from o where op = 'add' and not exists (select 1 from a where a.owner = o.document_id and regexp_replace(coalesce(a.text, ''), '\\s+', '', 'g') = regexp_replace(coalesce(o.text, ''), '\\s+', '', 'g')))
select id, owner, md5(coalesce(text, '')) as print from a union all select id, owner, md5(coalesce(text, '')) from f""")
def v9(spark, sf_dir):
    """Statements of July 2024 patched by the later ones: replaced by the same document, added unless their text is there."""
    rows = table(spark, sf_dir, "statements")
    current = latest(rows.where(F.col("ingested_at") < F.lit("2024-07-01T00:00:00Z").cast("timestamp"))).select("id", F.col("document_id").alias("owner"), "text")
    now = latest(rows).join(current.select("id", F.lit("replace").alias("op")), "id", "left")
    ops = now.select(F.coalesce("op", F.lit("add")).alias("op"), F.when(F.col("op").isNotNull(), F.col("id")).alias("target"), F.col("document_id").alias("owner"), "text", F.when(F.col("op").isNull(), F.col("id")).alias("new_id"))
    after, _ = patched(durable(current), durable(ops))
    return after.select("id", "owner", F.md5(F.coalesce("text", F.lit(""))).alias("print"))


@_query("r9_made_evidence")
def r9(spark, sf_dir):
    """Evidence made anew from the units of every document: first unit, clause number, members, pages and joined text."""
    g = text_groups(_units(spark, sf_dir))
    return g.select("document_id", F.element_at("source_ids", 1).alias("first_id"), "clause", F.size("parts").alias("members"), F.array_min("pages").alias("page"), joined(F.col("parts")).alias("text"))


@_query("r15_candidate_classes", f"with {_CLOSURE}, g as ({SQL['g9_resolved_labels']}), c as (select label, class_id from g where class_id is not null union select g.label, r.anc from g join reach r on r.node = g.class_id) select label, count(*) as classes, min(class_id) as first_class from c group by label")
def r15(spark, sf_dir):
    """Classes that a label may name: the one it resolves to and all above it."""
    pairs = durable(_closure(spark, sf_dir))
    own = durable(_resolved(spark, sf_dir, pairs).where("class_id is not null").select("label", "class_id"))
    above = own.join(pairs.select(F.col("node").alias("class_id"), "anc"), "class_id").select("label", F.col("anc").alias("class_id"))
    return own.union(above).distinct().groupBy("label").agg(F.count("*").alias("classes"), F.min("class_id").alias("first_class"))


@_query("g8_isolated_classes", f"""with d as (select distinct id from domain_classes where id is not null), k as (select distinct id as child, parent from domain_classes where parent is not null union select id, p from (select id, unnest(additional_parents) as p from domain_classes) where p is not null),
known as (select id from d union select id from business_classes), e as (select child, parent from k where parent in (select id from known))
select id, id not in (select child from e) and id not in (select parent from e) and id not in (select class_id from {_ENT} where class_id is not null) as isolated from d""")
def g8(spark, sf_dir):
    """Whether a class has no registered parent, child or statement, so that a synchronisation of the registry deletes it."""
    _, links = class_links(table(spark, sf_dir, "domain_classes"), table(spark, sf_dir, "business_classes"))
    used = links.select(F.col("child").alias("id")).union(links.select("parent")).union(_entities(spark, sf_dir).where("class_id is not null").select("class_id"))
    own = table(spark, sf_dir, "domain_classes").where("id is not null").select("id").distinct()
    return own.join(used.distinct().withColumn("used", F.lit(True)), "id", "left").select("id", F.col("used").isNull().alias("isolated"))


@_query("g12_followed_references")
def g12(spark, sf_dir):
    """References of evidence with what following them gives: the evidence that holds the target, itself, or why none."""
    e = _latest(spark, sf_dir, "evidence")
    told = durable(resolve_references(references(e), numbered(_latest(spark, sf_dir, "source_unit"))))
    target = told.where("status = 'resolved'").select("id", "kind", "number", "end_number", F.explode("target_ids").alias("source_id"))
    holds = _members(spark, sf_dir).where("source_id is not null").groupBy("source_id").agg(F.min("evidence_id").alias("target"), F.count_distinct("evidence_id").alias("n"))
    met = target.join(holds, "source_id", "left").groupBy("id", "kind", "number", "end_number").agg(F.count("n").alias("held"), F.count("*").alias("asked"), F.max(F.col("target").eqNullSafe(F.col("id"))).alias("own"), F.max("n").alias("most"))
    keys = ["id", "kind", "number", "end_number"]
    met = met.withColumnsRenamed({c: f"_{c}" for c in keys})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    df = told.join(met, on, "left").select(*keys, "status", "held", "asked", "own", "most")
    state_ = F.when(F.col("status") != "resolved", F.col("status")).when(F.col("own"), "self").when(F.col("held") < F.col("asked"), "deferred").when(F.col("most") > 1, "several evidence").otherwise("followed")
    return df.select("id", "kind", "number", "end_number", state_.alias("state"))


_WANTED = {"op": "and", "items": [{"op": "le", "parameter": "price", "value": 150000, "unit": "mm", "location": "1-URGENT"}, {"op": "not", "item": {"op": "eq", "parameter": "state", "value": "F", "vocabulary": ["F", "O"]}}]}


@_query("f3_order_states", """with t as (select o_orderkey, case when o_orderstatus in ('F', 'O') and o_orderpriority = '1-URGENT' then o_totalprice * case when o_orderstatus = 'F' then 1 else 10 end <= 150000 end as a, case when o_orderstatus = 'F' then false when o_orderstatus = 'O' then true end as b from orders)
select o_orderkey, case when a and b then 'applicable' when not a or not b then 'not_applicable' else 'unknown' end as state from t""")
def f3(spark, sf_dir):
    """A three-valued condition over the facts of every order: price with unit and place, and a word of a vocabulary."""
    o = table(spark, sf_dir, "orders")
    unit = F.when(F.col("o_orderstatus") == "F", "mm").when(F.col("o_orderstatus") == "O", "cm")
    facts = {"price": {"value": F.col("o_totalprice"), "unit": unit, "location": F.col("o_orderpriority")}, "state": {"word": F.col("o_orderstatus")}}
    return o.select("o_orderkey", state(compile_condition(_WANTED, facts)).alias("state"))


@_query("w9_row_groups", f"""with b as {_BOX}, c as (select * from b where kind = 'cell'), t as (select document_id || '/' || page as table_id, y0, max(y1) as y1 from c group by document_id, page, y0),
r as (select table_id, y0, y1, dense_rank() over (partition by table_id order by y0) - 1 as row_index from t),
s as (select a.table_id, a.row_index, max(b.row_index) as until from r a join r b on a.table_id = b.table_id and b.y0 >= a.y0 and (b.y0 < a.y1 or b.y0 = a.y0) group by a.table_id, a.row_index),
g as (select *, case when max(until) over w is null or row_index > max(until) over w then 1 else 0 end as fresh from s window w as (partition by table_id order by row_index rows between unbounded preceding and 1 preceding)),
h as (select *, sum(fresh) over (partition by table_id order by row_index) as g from g)
select table_id, min(row_index) as first_row, max(until) as last_row from h group by table_id, g""")
def w9(spark, sf_dir):
    """Rows of cells of every page that cells reaching into the next ones hold together."""
    c = boxes(_latest(spark, sf_dir, "source_unit"), ["cell"]).groupBy(F.concat_ws("/", "document_id", "page").alias("table_id"), "y0").agg(F.max("y1").alias("y1"))
    r = durable(c.withColumn("row_index", F.dense_rank().over(Window.partitionBy("table_id").orderBy("y0")) - 1))
    below = r.select("table_id", F.col("y0").alias("at"), F.col("row_index").alias("other"))
    spans = r.join(below, "table_id").where("at >= y0 and (at < y1 or at = y0)").groupBy("table_id", "row_index").agg((F.max("other") - F.col("row_index") + 1).alias("row_span"))
    return row_groups(spans)


_TERMS = ["焊缝检查", "水室"]


@_query("r2_query_groups", "select cast(n as int) as n, token, cast(place as int) as place from (values (0, '焊缝', 0), (0, '缝检', 1), (0, '检查', 2), (1, '水室', 0)) t(n, token, place)")
def r2(spark, sf_dir):
    """Token groups of a query of two terms, in order."""
    groups = query_tokens(spark, " ".join(_TERMS), [*_TERMS, " ", _TERMS[0]])
    return spark.createDataFrame([(n, token, place) for n, g in enumerate(groups) for place, token in enumerate(g)], "n int, token string, place int")


@_query("l3_second_page", f"with l as (select id, text from {_LAST['evidence']} where text is not null), h as (select id, cast(contains(text, '焊缝') as int) + cast(contains(text, '检查') as int) as hits from l) select id, cast(hits as int) as hits from h where hits > 0 order by hits desc, id limit 20 offset 20")
def l3(spark, sf_dir):
    """The second page of 20 by phrases found and id, reached by the cursor of the first."""
    found = search(_latest(spark, sf_dir, "evidence"), [["焊缝"], ["检查"]], "any").select("id", "hits")
    order, request = [F.desc("hits"), "id"], {"query": ["焊缝", "检查"], "order": "hits"}
    _, cursor = page(found, order, 20, request)
    return page(found, order, 20, request, cursor)[0]


@_query("h5_upper_classes", f"""with {_CLOSURE}, e as (select distinct id, coalesce(class_id, kind) as class_id from {_ENT} where coalesce(class_id, kind) is not null), tops as (select id from business_classes where parent is null)
select e.id, e.class_id, min(r.anc) filter (where r.anc in (select id from tops)) as upper, count(distinct r.anc) filter (where r.anc in (select id from tops)) as uppers from e left join reach r on r.node = e.class_id group by e.id, e.class_id""")
def h5(spark, sf_dir):
    """Class of every entity (its own, else its kind) with the upper class it leads to."""
    e = _entities(spark, sf_dir).select("id", F.coalesce("class_id", "kind").alias("class_id")).where("class_id is not null").distinct()
    tops = table(spark, sf_dir, "business_classes").where("parent is null").select(F.col("id").alias("anc"))
    up = _closure(spark, sf_dir).join(tops, "anc", "left_semi").groupBy(F.col("node").alias("class_id")).agg(F.min("anc").alias("upper"), F.count_distinct("anc").alias("uppers"))
    return salted_join(e, up, ["class_id"], F.col("id"), "left").select("id", "class_id", "upper", F.coalesce("uppers", F.lit(0)).alias("uppers"))


def _signed(rows: str) -> str:
    return f"""(select anchor, s, min(id) as id, any_value(sources) as sources from (select id, any_value(concat_ws('|', coalesce(kind, ''), section, table_id)) as anchor, bool_or(said is null) as lacks, string_agg(concat_ws('/', coalesce(m.role, ''), said), ';' order by coalesce(m.ord, pos), pos) as s, list(m.source_id order by coalesce(m.ord, pos), pos) as sources
from (select id, kind, coalesce(context.section, '') as section, coalesce(context.table_id, '') as table_id, unnest(range(len(members))) as pos, unnest(members) as m from {rows}) mm left join us on us.source_id = mm.m.source_id where coalesce(m.role, '') not in ('section_context', 'section') group by id) where not lacks group by anchor, s having count(*) = 1)"""


_EARLY = f"(select * from (select *, row_number() over (partition by id order by ingested_at desc, created_at desc) as rn from evidence where id is not null and ingested_at < {_CUT}) where rn = 1)"
_SIGNED = f"""us as (select id as source_id, md5(regexp_replace(text, '\\s+', '', 'g')) as said from {_LAST['source_unit']}), met as (select o.id as old_id, n.id as new_id, o.sources as a, n.sources as b from {_signed(_EARLY)} o join {_signed(f"(select * from {_LAST['evidence']} where deleted_at is null)")} n using (anchor, s))"""


def _editions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e, units = table(spark, sf_dir, "evidence"), durable(_latest(spark, sf_dir, "source_unit").select("id", "text"))
    old = latest(e.where(F.col("ingested_at") < F.lit("2024-07-01T00:00:00Z").cast("timestamp")))
    return align_editions(durable(signatures(old, units)), durable(signatures(latest(e).where("deleted_at is null"), units)))


@_query("j11_editions", f"with {_SIGNED} select old_id, new_id from met")
def j11_editions(spark, sf_dir):
    """Evidence delivered before July 2024 and the present evidence that stands in the same place and says the same, member by member."""
    return _editions(spark, sf_dir)[0]


@_query("i4_kept_sources", f"with {_SIGNED}, p as (select distinct x as old_id, y as new_id from (select unnest(a) as x, unnest(b) as y from met) where x is not null and y is not null) select old_id, new_id from p where old_id in (select old_id from p group by old_id having count(*) = 1) and new_id in (select new_id from p group by new_id having count(*) = 1)")
def i4(spark, sf_dir):
    """Units of the earlier evidence and those of the present one that take their place, one to one."""
    return _editions(spark, sf_dir)[1]


@_query("s3_table_scan", f"""select e.context.table_id as table_id, m.source_id, u.kind, row_number() over (partition by e.context.table_id order by m.ord, m.evidence_id, m.source_id) as place from (select distinct evidence_id, source_id, min(ord) over (partition by evidence_id, source_id) as ord from {_MEM} where source_id is not null) m join {_LAST['evidence']} e on e.id = m.evidence_id join {_LAST['source_unit']} u on u.id = m.source_id where e.context.table_id is not null""")
def s3(spark, sf_dir):
    """Units of every table that evidence names, in the order of its members."""
    e = _latest(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), F.col("context.table_id").alias("table_id")).where("table_id is not null")
    u = _latest(spark, sf_dir, "source_unit").select(F.col("id").alias("source_id"), "kind")
    m = _members(spark, sf_dir).where("source_id is not null").groupBy("evidence_id", "source_id").agg(F.min("ord").alias("ord")).join(e, "evidence_id").join(u, "source_id")
    order = Window.partitionBy("table_id").orderBy("ord", "evidence_id", "source_id")
    return m.select("table_id", "source_id", "kind", F.row_number().over(order).alias("place"))


_TYPES = ("fact", "anomaly", "parameter", "inspection", "measure", "requirement", "procedure")


@_query("f11_rejects", f"""with s as {_LAST['statements']} select id, 'no text' as reason from s where coalesce(trim(text), '') = '' union all select id, 'unknown type' from s where type is null or type not in {_TYPES} union all select id, 'no support' from s where supports is null or len(supports) = 0
union all select id, 'support without evidence' from s where len(list_filter(supports, lambda x: x.evidence_id is null)) > 0 union all select id, 'no anchor' from s where source_anchors is null or len(source_anchors) = 0 union all select id, 'entity without class' from s where len(list_filter(entities, lambda x: x.ontology_class_id is null)) > 0""")
def f11(spark, sf_dir):
    """Statements that break their contract, one row per reason."""
    s = _latest(spark, sf_dir, "statements")
    empty = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    reasons = F.array(
        F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text"), F.when(~F.coalesce(F.col("type").isin(*_TYPES), F.lit(False)), "unknown type"), F.when(empty("supports"), "no support"),
        F.when(F.exists("supports", lambda x: x["evidence_id"].isNull()), "support without evidence"), F.when(empty("source_anchors"), "no anchor"), F.when(F.exists("entities", lambda x: x["ontology_class_id"].isNull()), "entity without class"),
    )
    return s.select("id", F.explode(F.array_compact(reasons)).alias("reason"))


@_query("j8_undirected_links", f"with {_LINKS} select node, count(distinct other) as neighbours from (select child as node, parent as other from k union all select parent, child from k) where node <> other group by node")
def j8(spark, sf_dir):
    """Classes linked with a class on either end of a link."""
    _, links = class_links(table(spark, sf_dir, "domain_classes"), table(spark, sf_dir, "business_classes"))
    both = links.select(F.col("child").alias("node"), F.col("parent").alias("other")).union(links.select("parent", "child")).where("node <> other")
    return both.distinct().groupBy("node").agg(F.count("*").alias("neighbours"))


_RANK = "case when role = 'subject' then 2 when role = 'object' then 1 else 0 end"


@_query("a2_statement_owners", f"select id, max({_RANK}) as path_rank, max(case when class_id is not null then 1 else 0 end) as owned, array_to_string(list_sort(list_distinct(list(class_id) filter (where class_id is not null))), ',') as owners from {_ENT} group by id")
def a2(spark, sf_dir):
    """Best role, whether any class owns it, and the distinct owners of every statement with entities."""
    rank = F.when(F.col("role") == "subject", 2).when(F.col("role") == "object", 1).otherwise(0)
    per = _entities(spark, sf_dir).groupBy("id").agg(F.max(rank).alias("path_rank"), F.max(F.col("class_id").isNotNull().cast("int")).alias("owned"), F.array_sort(F.collect_set("class_id")).alias("o"))
    return per.select("id", "path_rank", "owned", F.when(F.col("owned") == 1, F.array_join("o", ",")).alias("owners"))


@_query("g7_included_classes", f"with {_CLOSURE}, e as (select distinct id, class_id from {_ENT} where class_id is not null) select id, count(*) as classes from (select id, class_id from e union select e.id, r.anc from e join reach r on r.node = e.class_id) group by id")
def g7(spark, sf_dir):
    """Number of classes that a statement brings in: its own and all above them."""
    e = durable(_entities(spark, sf_dir).where("class_id is not null").select("id", "class_id").distinct())
    above = salted_join(e, _closure(spark, sf_dir).select(F.col("node").alias("class_id"), "anc"), ["class_id"], F.col("id")).select("id", F.col("anc").alias("class_id"))
    return e.union(above).distinct().groupBy("id").agg(F.count("*").alias("classes"))


@_query("g10_bound_entities", f"""with s as (select distinct id, evidence_id, unnest(member_keys) as member_key from {_SUP} where evidence_id is not null), t as (select s.id, u.text from s join {_MEM} m on m.evidence_id = s.evidence_id and m.member_key = s.member_key join {_LAST['source_unit']} u on u.id = m.source_id where u.text is not null),
e as (select distinct id, label from {_ENT} where label is not null and label <> '') select e.id, e.label, bool_or(coalesce(contains(t.text, e.label), false)) as bound from e left join t using (id) group by e.id, e.label""")
def g10(spark, sf_dir):
    """Entities whose label stands letter for letter in a member that supports their statement."""
    chosen = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id", F.explode("member_keys").alias("member_key")).distinct()
    texts = salted_join(chosen, _member_texts(spark, sf_dir).select("evidence_id", "member_key", "text"), ["evidence_id", "member_key"], F.col("id")).where("text is not null").select("id", "text")
    e = _entities(spark, sf_dir).where("label is not null and label <> ''").select("id", "label").distinct()
    return e.join(texts, "id", "left").groupBy("id", "label").agg(F.max(F.coalesce(F.col("text").contains(F.col("label")), F.lit(False))).alias("bound"))


@_query("r5_anchor_terms", f"with {_SAID} select a.id, a.label from h a where not exists (select 1 from h b where b.id = a.id and b.label <> a.label and contains(b.label, a.label))")
def r5(spark, sf_dir):
    """Labels that an evidence names and that no longer label in it contains."""
    own = durable(_mentions(spark, sf_dir))
    longer = own.join(own.withColumnRenamed("label", "other"), "id").where((F.col("label") != F.col("other")) & F.col("other").contains(F.col("label"))).select("id", "label").distinct()
    return own.join(longer, ["id", "label"], "left_anti")


@_query("h16_page_ranges", f"select evidence_id, min(page) as first, max(page) as last from (select evidence_id, page, page - row_number() over (partition by evidence_id order by page) as island from (select distinct evidence_id, page from {_MEM} where page is not null)) group by evidence_id, island")
def h16(spark, sf_dir):
    """Ranges of pages that the members of every evidence stand on."""
    return spans_of(_members(spark, sf_dir), "evidence_id", "page")


@_query("v13_gap_groups")
def v13(spark, sf_dir):
    """Open references of every document by what is wanted and why it is open."""
    e = _latest(spark, sf_dir, "evidence")
    told = resolve_references(references(e), numbered(_latest(spark, sf_dir, "source_unit"))).where("status <> 'resolved'")
    why = F.when(F.col("status") == "external_document", "another document").when(F.col("status").like("ambiguous%"), "not unique").otherwise("not there")
    return told.join(e.select("id", "document_id"), "id").groupBy("document_id", "kind", why.alias("why")).agg(F.count_distinct("number", F.coalesce("end_number", F.lit(""))).alias("numbers"), F.count_distinct("id").alias("evidence"))


@_query("h27_supported_references")
def h27(spark, sf_dir):
    """References that stand in the members a statement rests on; each unit is read once, however many statements cite it."""
    u = _latest(spark, sf_dir, "source_unit").select("id", "document_id", F.struct("section", F.col("locator.physical_page").alias("primary_page")).alias("context"), "text")
    said = durable(references(u).select(F.col("id").alias("source_id"), "kind", "number", "end_number").distinct())
    held = _members(spark, sf_dir).where("source_id is not null").select("evidence_id", "member_key", "source_id").join(said.select("source_id").distinct(), "source_id", "left_semi")
    chosen = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id", F.explode("member_keys").alias("member_key")).distinct()
    cited = salted_join(chosen, held, ["evidence_id", "member_key"], F.col("id")).select("id", "source_id").distinct()
    return salted_join(cited, said, ["source_id"], F.col("id")).select("id", "kind", "number", "end_number").distinct()


@_query("h17_changed_references")
def h17(spark, sf_dir):
    """References that evidence delivered before July 2024 gained or lost up to its last delivery, or with a later record."""
    e = table(spark, sf_dir, "evidence")
    early = latest(e.where(F.col("ingested_at") < F.lit("2024-07-01T00:00:00Z").cast("timestamp")))
    read = lambda df: references(df).select("id", "kind", "number", F.coalesce("end_number", F.lit("")).alias("end_number")).distinct()
    old, new = durable(read(early)), durable(read(latest(e).where("deleted_at is null")))
    keys = ["id", "kind", "number", "end_number"]
    return new.join(old, keys, "left_anti").withColumn("change", F.lit("gained")).union(old.join(new, keys, "left_anti").withColumn("change", F.lit("lost")))
