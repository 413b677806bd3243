"""Queries that validate and fold: rejects with reasons, verdicts, coverage, references, remapping, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.text import fingerprint
from strataloom.functions.truth import kleene_all, state
from strataloom.operators.records import latest
from strataloom.operators.references import numbered, references, resolve_references
from strataloom.operators.skew import salted_join
from strataloom.plans.knowledge_queries import _ENT, _LAST, _MEM, _SUP, _entities, _members, _supports
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


@_query("v1_rejects", f"""select id, concat_ws(';', case when text is null or trim(text) = '' then 'no text' end, case when type is null then 'no type' end, case when entities is null or len(entities) = 0 then 'no entity' end,
case when supports is null or len(supports) = 0 then 'no support' when len(list_filter(supports, lambda s: s.evidence_id is null)) > 0 then 'support without evidence' end, case when source_anchors is null or len(source_anchors) = 0 then 'no anchor' end) as reasons from {_LAST['statements']}
where text is null or trim(text) = '' or type is null or entities is null or len(entities) = 0 or supports is null or len(supports) = 0 or len(list_filter(supports, lambda s: s.evidence_id is null)) > 0 or source_anchors is null or len(source_anchors) = 0""")
def v1(spark, sf_dir):
    """Statements that fail the record contract, with every reason."""
    none = lambda c: F.col(c).isNull() | (F.size(c) == 0)
    support = F.when(none("supports"), "no support").when(F.exists("supports", lambda s: s["evidence_id"].isNull()), "support without evidence")
    reasons = F.concat_ws(";", F.when(F.col("text").isNull() | (F.trim("text") == ""), "no text"), F.when(F.col("type").isNull(), "no type"), F.when(none("entities"), "no entity"), support, F.when(none("source_anchors"), "no anchor"))
    return _latest(spark, sf_dir, "statements").select("id", reasons.alias("reasons")).where("reasons <> ''")


_QUALITY = "case when u.quality in ('good', 'readable', 'parsed', 'verified') then true when u.quality = 'unrecognized' then false end"


@_query("f5_evidence_state", f"""select evidence_id, case when bool_or(t is false) then 'not_applicable' when bool_or(t is null) then 'unknown' else 'applicable' end as state from
(select m.evidence_id, {_QUALITY} as t from {_MEM} m left join {_LAST['source_unit']} u on u.id = m.source_id) group by evidence_id""")
def f5(spark, sf_dir):
    """Whether an evidence may be used: the Kleene conjunction of what is known about its units."""
    good, bad = F.col("quality").isin("good", "readable", "parsed", "verified"), F.col("quality") == "unrecognized"
    u = _latest(spark, sf_dir, "source_unit").select(F.col("id").alias("source_id"), F.when(good, True).when(bad, F.lit(False)).alias("t"))
    return _members(spark, sf_dir).select("evidence_id", "source_id").join(u, "source_id", "left").groupBy("evidence_id").agg(state(kleene_all(F.col("t"))).alias("state"))


@_query("f6_scope_states", f"""select s.id, s.evidence_id, case when e.id is null then 'absent' when e.context.section is null then 'unknown' else 'parsed' end as scope_state, e.context.section as section from (select distinct id, evidence_id from {_SUP} where evidence_id is not null) s left join {_LAST['evidence']} e on e.id = s.evidence_id""")
def f6(spark, sf_dir):
    """Section of every support with its state; no row is filtered."""
    e = _latest(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), F.col("context.section").alias("section"), F.lit(True).alias("there"))
    s = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id").distinct().join(e, "evidence_id", "left")
    return s.select("id", "evidence_id", F.when(F.col("there").isNull(), "absent").when(F.col("section").isNull(), "unknown").otherwise("parsed").alias("scope_state"), "section")


@_query("f10_verified_batches", f"""select document_id, count(*) as statements, bool_and(ok) as verified from (select document_id, supports is not null and len(supports) > 0 and len(list_filter(supports, lambda s: s.evidence_id is null)) = 0 as ok from {_LAST['statements']}) group by document_id""")
def f10(spark, sf_dir):
    """Documents all of whose statements name their evidence."""
    ok = F.col("supports").isNotNull() & (F.size("supports") > 0) & ~F.exists("supports", lambda s: s["evidence_id"].isNull())
    return _latest(spark, sf_dir, "statements").select("document_id", F.coalesce(ok, F.lit(False)).alias("ok")).groupBy("document_id").agg(F.count("*").alias("statements"), F.every("ok").alias("verified"))


@_query("j5_page_of_evidence", f"""with p as (select document_id, locator.physical_page as page, count(*) as units from {_LAST['source_unit']} where locator.physical_page is not null group by document_id, page)
select e.id, e.context.primary_page as page, p.units, p.units is not null as known from {_LAST['evidence']} e left join p on p.document_id = e.document_id and p.page = e.context.primary_page""")
def j5(spark, sf_dir):
    """The primary page of each evidence with the number of units on it, none included."""
    p = _latest(spark, sf_dir, "source_unit").where("locator.physical_page is not null").groupBy("document_id", F.col("locator.physical_page").alias("page")).agg(F.count("*").alias("units"))
    e = _latest(spark, sf_dir, "evidence").select("id", "document_id", F.col("context.primary_page").alias("page"))
    return e.join(p, ["document_id", "page"], "left").select("id", "page", "units", F.col("units").isNotNull().alias("known"))


_NO = "regexp_extract(text, '^\\s*([0-9]+(?:[.][0-9]+)+)\\s', 1)"


@_query("j13_clause_runs", f"""with n as (select document_id, regexp_replace(no, '[.][0-9]+$', '') as prefix, cast(regexp_extract(no, '([0-9]+)$', 1) as int) as last from (select document_id, {_NO} as no from {_LAST['source_unit']} where kind in ('heading', 'clause') and text is not null) where no <> '')
select document_id, prefix, min(last) as first_no, max(last) as last_no, count(distinct last) as present, max(last) - min(last) + 1 - count(distinct last) as gaps from n group by document_id, prefix""")
def j13(spark, sf_dir):
    """Ranges of clause numbers below each prefix, with the numbers missing in between."""
    no = F.regexp_extract("text", r"^\s*([0-9]+(?:[.][0-9]+)+)\s", 1)
    n = _latest(spark, sf_dir, "source_unit").where("kind in ('heading', 'clause') and text is not null").select("document_id", no.alias("no")).where("no <> ''")
    n = n.select("document_id", F.regexp_replace("no", "[.][0-9]+$", "").alias("prefix"), F.regexp_extract("no", "([0-9]+)$", 1).try_cast("int").alias("last"))
    ends = n.groupBy("document_id", "prefix").agg(F.min("last").alias("first_no"), F.max("last").alias("last_no"), F.countDistinct("last").alias("present"))
    return ends.withColumn("gaps", F.col("last_no") - F.col("first_no") + 1 - F.col("present"))


@_query("j16_compound_names", f"""with n as (select distinct id, label, class_id from {_ENT} where label is not null), p as (select a.id, a.label as head, b.label as qualifier from n a join n b on a.id = b.id and a.label <> b.label and a.class_id is not null and b.class_id is null)
select p.id, p.qualifier, p.head, contains(s.text, p.head) as head_said, contains(s.text, p.qualifier) as qualifier_said from p join {_LAST['statements']} s on s.id = p.id where s.text is not null""")
def j16(spark, sf_dir):
    """Pairs of a classified and an unclassified name of one statement, and which of them its text says."""
    n = _entities(spark, sf_dir).where("label is not null").select("id", "label", "class_id").distinct()
    head = n.where("class_id is not null").select("id", F.col("label").alias("head"))
    qualifier = n.where("class_id is null").select("id", F.col("label").alias("qualifier"))
    text = _latest(spark, sf_dir, "statements").where("text is not null").select("id", "text")
    return head.join(qualifier, "id").where("head <> qualifier").distinct().join(text, "id").select("id", "qualifier", "head", F.col("text").contains(F.col("head")).alias("head_said"), F.col("text").contains(F.col("qualifier")).alias("qualifier_said"))


@_query("a12_last_wins", """select doc, text_print, last_id from (select document_id as doc, md5(text) as text_print, arg_max(id, (ingested_at, id)) as last_id, count(distinct id) as n from statements where text is not null and id is not null group by document_id, md5(text)) where n > 1""")
def a12(spark, sf_dir):
    """Statements of a document with the same text: the one delivered last stands for them."""
    s = table(spark, sf_dir, "statements").where("text is not null and id is not null").groupBy(F.col("document_id").alias("doc"), F.md5("text").alias("text_print"))
    return s.agg(F.max(F.struct("ingested_at", "id"))["id"].alias("last_id"), F.countDistinct("id").alias("n")).where("n > 1").drop("n")


@_query("w6_lead_ins", f"""select evidence_id, member_key, last_value(case when leads then member_key end ignore nulls) over (partition by evidence_id order by ord, member_key rows between unbounded preceding and 1 preceding) as lead_key from
(select m.evidence_id, m.member_key, m.ord, coalesce(regexp_matches(u.text, '[：:]\\s*$'), false) as leads, coalesce(regexp_matches(u.text, '^\\s*([（(]\\s*[0-9]+\\s*[)）]|[0-9]{{1,3}}\\s*[)）、]|[0-9]{{1,3}}\\s)'), false) as item from {_MEM} m left join {_LAST['source_unit']} u on u.id = m.source_id) qualify item""")
def w6(spark, sf_dir):
    """The lead-in (ending with a colon) that governs each list member of an evidence."""
    u = _latest(spark, sf_dir, "source_unit").select(F.col("id").alias("source_id"), F.col("text").rlike(r"[：:]\s*$").alias("leads"), F.col("text").rlike(r"^\s*([（(]\s*[0-9]+\s*[)）]|[0-9]{1,3}\s*[)）、]|[0-9]{1,3}\s)").alias("item"))
    m = _members(spark, sf_dir).select("evidence_id", "member_key", "ord", "source_id").join(u, "source_id", "left")
    w = Window.partitionBy("evidence_id").orderBy("ord", "member_key").rowsBetween(Window.unboundedPreceding, -1)
    df = m.withColumn("lead_key", F.last(F.when(F.col("leads"), F.col("member_key")), ignorenulls=True).over(w))
    return df.where("item").select("evidence_id", "member_key", "lead_key")


@_query("l6_row_page", f"""select id, document_id, page from (select id, document_id, locator.physical_page as page from {_LAST['source_unit']} where kind = 'cell') order by page nulls last, id limit 20 offset 20""")
def l6(spark, sf_dir):
    """The second page of 20 cells by page and id."""
    df = _latest(spark, sf_dir, "source_unit").where("kind = 'cell'").select("id", "document_id", F.col("locator.physical_page").alias("page"))
    return df.orderBy(F.col("page").asc_nulls_last(), "id").offset(20).limit(20)


@_query("l8_competing_unread", f"""with r as (select e.id, e.context.section as section, count(s.id) as uses from {_LAST['evidence']} e left join (select distinct id, evidence_id from {_SUP}) s on s.evidence_id = e.id group by e.id, section),
b as (select *, max(case when uses > 0 then length(id) end) over (partition by section) as has_read from r) select section, count(*) as unread from b where uses = 0 and has_read is not null and section is not null group by section""")
def l8(spark, sf_dir):
    """Evidence that no statement uses in sections of which other evidence is used."""
    uses = _supports(spark, sf_dir).where("evidence_id is not null").groupBy("evidence_id").agg(F.countDistinct("id").alias("uses"))
    e = _latest(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), F.col("context.section").alias("section")).join(uses, "evidence_id", "left").where("section is not null")
    per = e.groupBy("section").agg(F.count_if(F.col("uses").isNull()).alias("unread"), F.count("uses").alias("read"))
    return per.where("unread > 0 and read > 0").select("section", "unread")


@_query("u1_all_hits", f"""select class_id, id, max(owned) as owned, count(*) as ways from (select class_id, id, 1 as owned from {_ENT} where role in ('subject', 'object') union all select class_id, id, 0 from {_ENT} where role = 'related') where class_id is not null group by class_id, id""")
def u1(spark, sf_dir):
    """Hits of a class by ownership and by mention, united; ownership wins."""
    e = _entities(spark, sf_dir).where("class_id is not null")
    hits = e.where("role in ('subject', 'object')").select("class_id", "id", F.lit(1).alias("owned")).union(e.where("role = 'related'").select("class_id", "id", F.lit(0)))
    return hits.groupBy("class_id", "id").agg(F.max("owned").alias("owned"), F.count("*").alias("ways"))


@_query("u4_common_members", f"""select a.id as id_a, b.id as id_b, count(*) as common from (select distinct id, evidence_id, unnest(member_keys) as k from {_SUP} where type = 'requirement' and evidence_id is not null) a join (select distinct id, evidence_id, unnest(member_keys) as k from {_SUP} where type = 'inspection' and evidence_id is not null) b using (evidence_id, k) group by a.id, b.id having count(*) >= 3""")
def u4(spark, sf_dir):
    """Requirements and inspections that share three or more members."""
    b = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "type", "evidence_id", F.explode("member_keys").alias("k")).distinct()
    left, right = b.where("type = 'requirement'").select("evidence_id", "k", F.col("id").alias("id_a")), b.where("type = 'inspection'").select("evidence_id", "k", F.col("id").alias("id_b"))
    return salted_join(left, right, ["evidence_id", "k"], F.col("id_a")).groupBy("id_a", "id_b").agg(F.count("*").alias("common")).where("common >= 3")


@_query("x16_slices", f"select id, case when hi > length(text) or lo > hi or lo < 0 then 'out of range' else 'fits' end as state, count(*) as n from (select id, text, locator.char_range[1] as lo, locator.char_range[2] as hi from {_LAST['source_unit']} where len(locator.char_range) = 2 and text is not null) group by id, state")
def x16(spark, sf_dir):
    """Whether the character range of a unit lies within its text."""
    r = F.col("locator.char_range")
    df = _latest(spark, sf_dir, "source_unit").where(F.col("text").isNotNull() & (F.size(r) == 2)).select("id", "text", r[0].alias("lo"), r[1].alias("hi"))
    state_ = F.when((F.col("hi") > F.length("text")) | (F.col("lo") > F.col("hi")) | (F.col("lo") < 0), "out of range").otherwise("fits")
    return df.groupBy("id", state_.alias("state")).agg(F.count("*").alias("n"))


@_query("x23_remapped_ids", f"""with p as (select id, min(id) over (partition by document_id, kind, md5(coalesce(text, ''))) as kept from {_LAST['evidence']})
select s.id, list_sort(list_distinct(list(coalesce(p.kept, s.evidence_id)))) as evidence_ids, count(*) filter (where p.kept <> s.evidence_id) as rewritten from {_SUP} s left join p on p.id = s.evidence_id where s.evidence_id is not null group by s.id""")
def x23(spark, sf_dir):
    """Supports rewritten to the first evidence of the same text, wherever the old id stands."""
    groups = _latest(spark, sf_dir, "evidence").select("id", "document_id", "kind", F.md5(F.coalesce("text", F.lit(""))).alias("t"))
    first = groups.groupBy("document_id", "kind", "t").agg(F.min("id").alias("kept"))
    same = [groups[c].eqNullSafe(first[c]) for c in ("document_id", "kind", "t")]
    p = groups.join(first, same[0] & same[1] & same[2]).select(groups["id"].alias("evidence_id"), "kept")
    s = _supports(spark, sf_dir).where("evidence_id is not null").select("id", "evidence_id").join(p, "evidence_id", "left")
    return s.groupBy("id").agg(F.sort_array(F.collect_set(F.coalesce("kept", "evidence_id"))).alias("evidence_ids"), F.count_if(F.col("kept") != F.col("evidence_id")).alias("rewritten"))


@_query("r7_reference_edges")
def r7(spark, sf_dir):
    """Reference edges from evidence to the evidence that holds the units a reference resolves to."""
    found = resolve_references(references(_latest(spark, sf_dir, "evidence")), numbered(_latest(spark, sf_dir, "source_unit"))).where("status = 'resolved'")
    m = _members(spark, sf_dir).select("evidence_id", "source_id").distinct()
    edges = found.select("id", "kind", "number", "end_number", F.explode("target_ids").alias("source_id")).join(m, "source_id").where("evidence_id <> id")
    return edges.select(F.col("id").alias("source"), F.col("evidence_id").alias("target"), "kind", "number", "end_number").distinct()


@_query("r12_class_coverage", f"""select c.id as class_id, case when max(s.evidence_id) is not null then 'evidence_found' when max(e.id) is not null then 'pending_read' else 'graph_not_found' end as coverage from (select distinct id from domain_classes) c left join {_ENT} e on e.class_id = c.id
left join (select s.id, s.evidence_id from {_SUP} s where s.evidence_id in (select id from evidence)) s on s.id = e.id group by c.id""")
def r12(spark, sf_dir):
    """Whether a class is covered by evidence, only named, or not found."""
    there = table(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id")).distinct()
    s = _supports(spark, sf_dir).select("id", "evidence_id").join(there, "evidence_id", "left_semi").select("id").distinct().withColumn("found", F.lit(1))
    e = _entities(spark, sf_dir).where("class_id is not null").select("class_id", "id").distinct().join(s, "id", "left").groupBy("class_id").agg(F.max("found").alias("found"), F.lit(1).alias("named"))
    own = table(spark, sf_dir, "domain_classes").select(F.col("id").alias("class_id")).distinct().join(e, "class_id", "left")
    return own.select("class_id", F.when(F.col("found") == 1, "evidence_found").when(F.col("named") == 1, "pending_read").otherwise("graph_not_found").alias("coverage"))


@_query("i2_content_changes", """select id, count(distinct sha256(concat_ws(chr(1), coalesce(kind, chr(2)), coalesce(text, chr(2)), coalesce(section, chr(2)), coalesce(quality, chr(2))))) as versions, count(*) as deliveries from source_unit where id is not null group by id having count(*) > 1""")
def i2(spark, sf_dir):
    """Deliveries and distinct contents of units that came more than once; volatile fields do not count."""
    print_ = fingerprint(F.col("kind"), F.col("text"), F.col("section"), F.col("quality"))
    df = table(spark, sf_dir, "source_unit").where("id is not null").groupBy("id").agg(F.countDistinct(print_).alias("versions"), F.count("*").alias("deliveries"))
    return df.where("deliveries > 1")


@_query("i8_invariant", f"""select id, document_id, md5(coalesce(text, '')) as t from statements where id is not null except select id, document_id, md5(coalesce(text, '')) from {_LAST['statements']}""")
def i8(spark, sf_dir):
    """Statements whose text the last delivery changed: a remapping must leave none."""
    cols = ["id", "document_id", F.md5(F.coalesce("text", F.lit(""))).alias("t")]
    return table(spark, sf_dir, "statements").where("id is not null").select(*cols).subtract(_latest(spark, sf_dir, "statements").select(*cols))


@_query("v12_verdicts", f"""with b as (select s.id, bool_and(e.id is not null) as bound, bool_or(e.deleted_at is not null) as gone from (select distinct id, evidence_id from {_SUP}) s left join {_LAST['evidence']} e on e.id = s.evidence_id group by s.id)
select document_id, count(*) filter (where verdict = 'accepted') as accepted, count(*) filter (where verdict = 'rejected') as rejected, count(*) filter (where verdict = 'unverified') as unverified, bool_and(verdict = 'accepted') as complete
from (select st.document_id, case when b.id is null or not b.bound then 'unverified' when b.gone then 'rejected' else 'accepted' end as verdict from {_LAST['statements']} st left join b on b.id = st.id) group by document_id""")
def v12(spark, sf_dir):
    """Verdicts on the statements of each document folded: complete only if all are accepted."""
    e = _latest(spark, sf_dir, "evidence").select(F.col("id").alias("evidence_id"), F.lit(True).alias("there"), F.col("deleted_at").isNotNull().alias("gone"))
    b = _supports(spark, sf_dir).select("id", "evidence_id").distinct().join(e, "evidence_id", "left").groupBy("id").agg(F.every(F.col("there").isNotNull()).alias("bound"), F.max(F.coalesce("gone", F.lit(False))).alias("gone"))
    verdict = F.when(F.col("bound").isNull() | ~F.col("bound"), "unverified").when(F.col("gone"), "rejected").otherwise("accepted")
    df = _latest(spark, sf_dir, "statements").select("id", "document_id").join(b, "id", "left").withColumn("v", verdict)
    return df.groupBy("document_id").agg(*(F.count_if(F.col("v") == k).alias(k) for k in ("accepted", "rejected", "unverified")), F.every(F.col("v") == "accepted").alias("complete"))
