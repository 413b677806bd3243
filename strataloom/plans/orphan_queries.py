"""Queries on references to records that do not exist, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.orphans import ForeignKey, missing_members, month, orphan_cascade, orphan_references, references, targets
from strataloom.session import table


def _evidence_refs(evidence: DataFrame) -> DataFrame:
    members = evidence.select("id", "created_at", "ingested_at", F.explode("members.source_id").alias("key"))
    return references(members, "evidence", "members.source_id", F.col("key"))


def _support_refs(statements: DataFrame) -> DataFrame:
    supports = statements.select("id", "created_at", "ingested_at", F.explode("supports.evidence_id").alias("key"))
    return references(supports, "statements", "supports.evidence_id", F.col("key"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of evidence and statements that is missing, deleted or late."""
    units, evidence, statements = (table(spark, sf_dir, t) for t in ("source_unit", "evidence", "statements"))
    columns = ["tbl", "id", "field", "target_key", "state", "period"]
    known = targets(evidence.select("id", "ingested_at", "deleted_at"))
    by_unit = orphan_references(_evidence_refs(evidence), targets(units.select("id", "ingested_at", "deleted_at")))
    by_evidence = orphan_references(_support_refs(statements), known)
    support = statements.select("id", "created_at", "ingested_at", F.explode("supports").alias("s"))
    keys = support.select("id", "created_at", "ingested_at", F.col("s.evidence_id").alias("owner"), F.explode("s.member_keys").alias("key"))
    members = evidence.select(F.col("id").alias("grp"), F.explode("members.member_key").alias("target_key"))
    by_member = missing_members(references(keys, "statements", "supports.member_keys", F.col("key"), F.col("owner")), members, known)
    return by_unit.select(columns).union(by_evidence.select(columns)).union(by_member.select(columns)).distinct()


def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of direct and inherited orphans per table and month of creation."""
    units, evidence, statements = (table(spark, sf_dir, t) for t in ("source_unit", "evidence", "statements"))
    ids = {n: df.groupBy("id").agg(F.max(F.col("deleted_at").isNotNull()).alias("gone")).where("not gone").select("id") for n, df in (("source_unit", units), ("evidence", evidence))}
    links = [
        ForeignKey("evidence", "source_unit", _evidence_refs(evidence).select("id", "target_key")),
        ForeignKey("statements", "evidence", _support_refs(statements).select("id", "target_key")),
    ]
    months = evidence.select(F.lit("evidence").alias("tbl"), "id", "created_at").union(statements.select(F.lit("statements").alias("tbl"), "id", "created_at"))
    months = months.groupBy("tbl", "id").agg(month(F.min("created_at")).alias("period"))
    return orphan_cascade(ids, links).join(months, ["tbl", "id"]).groupBy("tbl", "period", "kind").agg(F.count("*").alias("n"))


QUERIES = {"p3_found": found, "p3_cascade": cascade}

_REFS = """
ev as (select id, min(ingested_at) as seen_at, strftime(min(created_at) at time zone 'UTC', '%Y-%m') as period from evidence where id is not null group by id),
st as (select id, min(ingested_at) as seen_at, strftime(min(created_at) at time zone 'UTC', '%Y-%m') as period from statements where id is not null group by id),
er as (select distinct id, m.source_id as target_key from (select id, unnest(members) as m from evidence) where m.source_id is not null),
su as (select id, s.evidence_id as owner, s.member_keys as keys from (select id, unnest(supports) as s from statements)),
sr as (select distinct id, owner as target_key from su where owner is not null),
unit_t as (select id as target_key, min(ingested_at) as first_at, bool_or(deleted_at is not null) as gone from source_unit group by id),
ev_t as (select id as target_key, min(ingested_at) as first_at, bool_or(deleted_at is not null) as gone from evidence group by id)"""

SQL = {
    "p3_found": f"""with {_REFS},
mem as (select distinct id as owner, m.member_key as target_key from (select id, unnest(members) as m from evidence)),
mr as (select distinct id, owner, target_key from (select id, owner, unnest(keys) as target_key from su) where target_key is not null and owner is not null),
direct as (
  select 'evidence' as tbl, id, 'members.source_id' as field, target_key,
    case when gone is null then 'missing' when gone then 'deleted' when first_at > seen_at then 'late' end as state, period
  from er join ev using (id) left join unit_t using (target_key)
  union all
  select 'statements', id, 'supports.evidence_id', target_key,
    case when gone is null then 'missing' when gone then 'deleted' when first_at > seen_at then 'late' end, period
  from sr join st using (id) left join ev_t using (target_key)
  union all
  select 'statements', id, 'supports.member_keys', target_key, 'missing', period from mr join st using (id)
  where exists (select 1 from ev_t t where t.target_key = owner) and not exists (select 1 from mem m where m.owner = mr.owner and m.target_key = mr.target_key)
)
select distinct tbl, id, field, target_key, state, period from direct where state is not null""",
    "p3_cascade": f"""with {_REFS},
e0 as (select distinct id from er where not exists (select 1 from unit_t t where t.target_key = er.target_key and not gone)),
s0 as (select distinct id from sr where not exists (select 1 from ev_t t where t.target_key = sr.target_key and not gone)),
s1 as (select distinct id from sr where target_key in (select id from e0) and id not in (select id from s0)),
alls as (select 'evidence' as tbl, id, 'direct' as kind from e0 union all select 'statements', id, 'direct' from s0 union all select 'statements', id, 'inherited' from s1),
months as (select 'evidence' as tbl, id, period from ev union all select 'statements', id, period from st)
select tbl, period, kind, count(*) as n from alls join months using (tbl, id) group by tbl, period, kind""",
}
