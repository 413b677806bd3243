"""Queries on class hierarchies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.hierarchy import build_hierarchy, class_links, reachable_pairs
from strataloom.session import durable, table


def _build(spark: SparkSession, sf_dir: str):
    return build_hierarchy(*class_links(table(spark, sf_dir, "domain_classes"), table(spark, sf_dir, "business_classes")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of which one leads up to the other; (x, x) for a class that leads up to itself."""
    pairs = reachable_pairs(_build(spark, sf_dir))
    return pairs.select(F.least("node", "anc").alias("id_a"), F.greatest("node", "anc").alias("id_b")).distinct()


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root, depth, root, number of descendants and circle mark of every class, by first parents."""
    forest = _build(spark, sf_dir).forest
    return forest.select("node", "root", "depth", F.concat_ws(" > ", "path").alias("path"), (F.col("size") - 1).alias("descendants"), "on_circle")


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes on circles of links: the node and the smallest id of its circle's strongly connected set."""
    pairs = durable(reachable_pairs(_build(spark, sf_dir)))
    looping = pairs.where("node = anc").select("node")
    within = pairs.join(looping, "node", "left_semi").join(looping.select(F.col("node").alias("anc")), "anc", "left_semi")
    both = within.join(within.select(F.col("node").alias("anc"), F.col("anc").alias("node")), ["node", "anc"], "left_semi")
    return both.groupBy("node").agg(F.min("anc").alias("circle"), F.count("*").alias("members"))


QUERIES = {"p5_found": found, "p5_paths": paths, "p5_circles": circles}

_CLOSURE = """with recursive nodes as (select distinct id from domain_classes where id is not null union select id from business_classes),
raw as (select id as child, parent from domain_classes union select id, unnest(additional_parents) from domain_classes union select id, parent from business_classes),
links as (select distinct child, parent from raw where parent in (select id from nodes) and child is not null),
reach(node, anc) as (select child, parent from links union select r.node, l.parent from reach r join links l on l.child = r.anc)
"""

_PATHS = """with recursive nodes as (select distinct id from domain_classes where id is not null union select id from business_classes),
raw as (select id as child, parent, 0 as rank from domain_classes union select id, unnest(additional_parents), 1 from domain_classes union select id, parent, 0 from business_classes),
links as (select child, parent, min(rank) as rank from raw where parent in (select id from nodes) and child is not null group by child, parent),
first as (select child, min({'rank': rank, 'parent': parent}).parent as parent from links group by child),
up(node, anc) as (select child, parent from first union select u.node, f.parent from up u join first f on f.child = u.anc),
circle as (select distinct node from up where node = anc),
least as (select node, min(anc) as least from up where node in (select node from circle) group by node),
tree as (select n.id as node, case when l.node = l.least then null else f.parent end as parent from nodes n left join first f on f.child = n.id left join least l on l.node = n.id),
walk(node, root, depth, path) as (select node, node, 0, node from tree where parent is null union all select t.node, w.root, w.depth + 1, w.path || ' > ' || t.node from tree t join walk w on t.parent = w.node),
below(node, anc) as (select node, parent from tree where parent is not null union all select b.node, t.parent from below b join tree t on t.node = b.anc where t.parent is not null),
counts as (select anc, count(*) as n from below group by anc)
"""

SQL = {
    "p5_paths": _PATHS + "select w.node, w.root, w.depth, w.path, coalesce(n, 0) as descendants, w.node in (select node from circle) as on_circle from walk w left join counts on anc = w.node",
    "p5_found": _CLOSURE + "select distinct least(node, anc) as id_a, greatest(node, anc) as id_b from reach",
    "p5_circles": _CLOSURE + "select a.node, min(a.anc) as circle, count(*) as members from reach a join reach b on a.node = b.anc and a.anc = b.node group by a.node",
}
