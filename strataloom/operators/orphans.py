"""References to records that do not exist: direct findings and the cascade down the foreign-key graph.

All joins are made on pre-aggregated keys: each distinct target key is looked up once, so a key named by a third of
all rows costs one row in the lookup. Only keys that turn out to be suspicious travel back to the referring rows, and
that join is salted, so no single task receives all rows of a hot key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.skew import SALTS, salted_join
from strataloom.session import durable


def month(at: Column) -> Column:
    """The month of a time in UTC, whatever the time zone of the session."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM")


def references(df: DataFrame, tbl: str, field: str, key: Column, group: Column | None = None) -> DataFrame:
    """Rows ``tbl, id, field, grp, target_key, seen_at, period`` of one reference field.

    ``df`` has ``id, created_at, ingested_at`` besides what ``key`` explodes. Repeated deliveries collapse to the first
    one. A null key or id is no reference; a null ``created_at`` gives a null period.
    """
    grp = F.lit(None).cast("string") if group is None else group
    return (
        df.select("id", "created_at", "ingested_at", grp.alias("grp"), key.alias("target_key"))
        .where(F.col("target_key").isNotNull() & F.col("id").isNotNull())
        .groupBy("id", "grp", "target_key")
        .agg(F.min("ingested_at").alias("seen_at"), month(F.min("created_at")).alias("period"))
        .withColumns({"tbl": F.lit(tbl), "field": F.lit(field)})
    )


def targets(df: DataFrame) -> DataFrame:
    """One row per existing key: ``target_key, first_at, gone`` (gone: any delivery carries ``deleted_at``)."""
    gone = F.max(F.col("deleted_at").isNotNull()) if "deleted_at" in df.columns else F.lit(False)
    return df.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("target_key")).agg(F.min("ingested_at").alias("first_at"), gone.alias("gone"))


def _suspicious(refs: DataFrame, target: DataFrame) -> DataFrame:
    """Distinct referenced keys for which at least one reference can be a finding."""
    wanted = refs.groupBy("target_key").agg(F.min("seen_at").alias("earliest"))
    return (
        wanted.join(target, "target_key", "left")
        .where(F.col("gone").isNull() | F.col("gone") | (F.col("first_at") > F.col("earliest")))
        .select("target_key", "first_at", "gone")
    )


def orphan_references(refs: DataFrame, target: DataFrame, salts: int = SALTS) -> DataFrame:
    """References whose target is missing, deleted or late: the reference columns and ``state``.

    missing: no row has the key; deleted: some row of the target is marked deleted; late: the target was first
    delivered after the referring record. An empty target table makes every reference missing. A null delivery time
    on either side cannot be compared and is never late.
    """
    state = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("first_at") > F.col("seen_at"), "late")
    found = salted_join(refs, _suspicious(refs, target), ["target_key"], F.col("id"), salts=salts)
    return found.withColumn("state", state).where(F.col("state").isNotNull()).drop("first_at", "gone")


def missing_members(refs: DataFrame, members: DataFrame, owners: DataFrame, salts: int = SALTS) -> DataFrame:
    """Member references (``grp`` names the owner) whose owner exists while it has no such member.

    ``members`` has ``grp, target_key``; ``owners`` has ``target_key`` of the existing owners.
    """
    wanted = refs.select("grp", "target_key").where("grp is not null").distinct()
    absent = wanted.join(members.select("grp", "target_key").distinct(), ["grp", "target_key"], "left_anti")
    absent = absent.join(owners.select(F.col("target_key").alias("grp")), "grp", "left_semi")
    return salted_join(refs, absent, ["grp", "target_key"], F.col("id"), salts=salts).withColumn("state", F.lit("missing"))


@dataclass(frozen=True)
class ForeignKey:
    """Rows ``id, target_key`` by which table ``child`` refers to table ``parent``."""

    child: str
    parent: str
    refs: DataFrame


def orphan_cascade(ids: Mapping[str, DataFrame], links: Sequence[ForeignKey], max_rounds: int = 1000) -> DataFrame:
    """Direct and inherited orphans of every table: ``tbl, id, kind, round``.

    ``ids[t]`` has the distinct ``id`` of the live records of table ``t``. A record is a direct orphan if any of its
    keys is not live in the parent table (round 0), an inherited one if it refers to an orphan (round of the shortest
    way). Rounds of semi-joins run until none is added; each round is checkpointed, so its cost does not grow, and only
    the records added last are joined. Links between a table and itself and circles of tables end as well, for an
    orphan is added once. Empty tables give an empty result.
    """
    link = [(k.child, k.parent, k.refs.where("id is not null and target_key is not null").select("id", "target_key").distinct()) for k in links]
    frontier = None
    for child, parent, refs in link:
        dangling = refs.select("target_key").distinct().join(ids[parent].select(F.col("id").alias("target_key")), "target_key", "left_anti")
        direct = salted_join(refs, dangling, ["target_key"], F.col("id"), "left_semi").select(F.lit(child).alias("tbl"), "id").distinct()
        frontier = direct if frontier is None else frontier.union(direct)
    if frontier is None:
        raise ValueError("at least one foreign key is needed")
    found = durable(frontier.distinct().withColumns({"kind": F.lit("direct"), "round": F.lit(0)}))
    last = found
    for step in range(1, max_rounds + 1):
        parts = []
        for child, parent, refs in link:
            gone = last.where(F.col("tbl") == parent).select(F.col("id").alias("target_key"))
            parts.append(salted_join(refs, gone, ["target_key"], F.col("id"), "left_semi").select(F.lit(child).alias("tbl"), "id"))
        new = parts[0]
        for part in parts[1:]:
            new = new.union(part)
        last = durable(new.distinct().join(found.select("tbl", "id"), ["tbl", "id"], "left_anti").withColumns({"kind": F.lit("inherited"), "round": F.lit(step)}))
        if last.isEmpty():
            return found
        found = durable(found.union(last))
    raise RuntimeError(f"the cascade did not end within {max_rounds} rounds")
