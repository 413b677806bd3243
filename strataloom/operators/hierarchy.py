"""Parent-child links to full hierarchies: nested-set ranges over a spanning forest, plus closure over further links.

Every node keeps one link (its first parent) in the forest. Subtree sizes are summed upwards and preorder positions are
handed down by prefix sums over siblings; both run by pointer doubling, so their rounds grow with the logarithm of the
depth. Nodes that the doubling never finishes hang on a circle of first parents; the circle is cut at its smallest id.
Descendants of a node are then the positions of one range. Links beyond the forest (further parents, cut links) are
closed by joining the ranges of their two ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import durable

#: Siblings are summed in this many buckets per parent, so a parent of a third of all nodes is no single task.
SIBLING_BUCKETS = 64
#: Ranges are cut into chunks of so many positions before their positions are listed.
RANGE_CHUNK = 4096


@dataclass(frozen=True)
class Hierarchy:
    """forest: ``node, parent, root, depth, path, start, size, on_circle``; extra: ``child, parent`` links beyond the forest."""

    forest: DataFrame
    extra: DataFrame


def class_links(rows: DataFrame, more: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (``node``) and links (``child, parent, rank``) of tables with ``id, parent`` and perhaps ``additional_parents``.

    Null ids are no nodes; null and unregistered parents and null arrays are no links; repeated rows count once.
    """
    parts = [rows] if more is None else [rows, more]
    nodes = links = None
    for df in parts:
        own = df.select(F.col("id").alias("node")).where("node is not null")
        up = df.select(F.col("id").alias("child"), F.col("parent"), F.lit(0).alias("rank"))
        if "additional_parents" in df.columns:
            up = up.union(df.select("id", F.explode("additional_parents"), F.lit(1)))
        nodes, links = (own, up) if nodes is None else (nodes.union(own), links.union(up))
    nodes = durable(nodes.distinct())
    links = links.where("child is not null and parent is not null").groupBy("child", "parent").agg(F.min("rank").alias("rank"))
    known = links.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi")
    return nodes, durable(known.select("child", "parent", "rank"))


def _jump(state: DataFrame, **carry) -> DataFrame:
    """One doubling: follow the pointer ``jump`` once more; carry maps a column to a function of (own, ancestor's)."""
    ahead = state.select(F.col("node").alias("jump"), F.col("jump").alias("_next"), *(F.col(c).alias(f"_{c}") for c in carry))
    joined = state.join(ahead, "jump", "left")
    kept = {c: F.when(F.col("jump").isNull(), F.col(c)).otherwise(f(F.col(c), F.col(f"_{c}"))) for c, f in carry.items()}
    rest = [c for c in state.columns if c not in {"node", "jump", *carry}]
    return joined.select("node", F.col("_next").alias("jump"), *rest, *(e.alias(c) for c, e in kept.items()))


def _circles(first: DataFrame) -> DataFrame:
    """``node, least`` of the nodes on a circle of first parents; least is the circle's smallest id."""
    state, open_before = durable(first.select("node", F.col("parent").alias("jump"))), -1
    while True:
        state = durable(_jump(state))
        left = state.where("jump is not null").count()
        if left == open_before or not left:
            break
        open_before = left
    trapped = durable(state.where("jump is not null").select("node"))
    state = durable(first.join(trapped, "node", "left_semi").select("node", F.col("parent").alias("jump"), F.col("node").alias("least")))
    for _ in range(max(1, trapped.count()).bit_length()):
        state = durable(_jump(state, least=F.least))
    on = state.select(F.col("jump").alias("node")).where("node is not null").distinct()
    return state.join(on, "node").select("node", "least")


def _offsets(sized: DataFrame) -> DataFrame:
    """``node, offset``: 1 and the sizes of the earlier siblings, summed over buckets and then within each."""
    keyed = sized.select("node", "parent", "size", F.pmod(F.xxhash64("node"), F.lit(SIBLING_BUCKETS)).alias("bucket"))
    within = Window.partitionBy("parent", "bucket").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = keyed.groupBy("parent", "bucket").agg(F.sum("size").alias("total"))
    totals = totals.select(F.col("parent").alias("p"), F.col("bucket").alias("b"), F.coalesce(F.sum("total").over(across), F.lit(0)).alias("before"))
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(totals, F.col("parent").eqNullSafe(F.col("p")) & (F.col("bucket") == F.col("b")))
    return placed.select("node", (F.lit(1) + F.col("before") + F.col("inside")).alias("offset"))


def build_hierarchy(nodes: DataFrame, links: DataFrame) -> Hierarchy:
    """The forest of first parents with nested-set ranges and the links beyond it.

    The first parent is the link of least rank, then of least id. ``depth`` is 0 for a root; ``path`` leads from the
    root to the node. Nodes on a circle of first parents have ``on_circle`` true. Empty tables give empty results.
    """
    best = links.groupBy("child").agg(F.min(F.struct("rank", "parent")).alias("b")).select(F.col("child").alias("node"), F.col("b.parent").alias("parent"))
    first = durable(nodes.join(best, "node", "left"))
    circle = durable(_circles(first))
    cut = circle.where("node = least").select("node", F.lit(True).alias("cut"))
    tree = durable(
        first.join(cut, "node", "left")
        .join(circle.select("node", F.lit(True).alias("on_circle")), "node", "left")
        .select("node", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), F.coalesce("on_circle", F.lit(False)).alias("on_circle"))
    )
    state = durable(tree.select("node", F.col("parent").alias("jump"), F.lit(1).cast("long").alias("size"), F.array("node").alias("path")))
    while True:
        given = state.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("size").alias("given"))
        state = _jump(state, path=lambda own, up: F.concat(up, own)).join(given, "node", "left")
        state = durable(state.select("node", "jump", (F.col("size") + F.coalesce("given", F.lit(0))).alias("size"), "path"))
        if state.where("jump is not null").isEmpty():
            break
    sized = durable(tree.join(state.drop("jump"), "node"))
    walk = durable(tree.join(_offsets(sized), "node").select("node", F.col("parent").alias("jump"), "offset"))
    while not walk.where("jump is not null").isEmpty():
        walk = durable(_jump(walk, offset=lambda own, up: own + up))
    forest = durable(
        sized.join(walk.select("node", (F.col("offset") - 1).alias("start")), "node").select(
            "node", "parent", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"), "path", "start", "size", "on_circle"
        )
    )
    kept = forest.where("parent is not null").select(F.col("node").alias("child"), "parent")
    return Hierarchy(forest, durable(links.select("child", "parent").join(kept, ["child", "parent"], "left_anti")))


def forest_pairs(forest: DataFrame, with_self: bool = False) -> DataFrame:
    """``anc, node``: every ancestor in the forest (and the node itself), from the ranges of positions."""
    least = 0 if with_self else 1
    spans = forest.where(F.col("size") > least).select(F.col("node").alias("anc"), (F.col("start") + least).alias("lo"), (F.col("start") + F.col("size") - 1).alias("hi"))
    chunks = spans.withColumn("lo", F.explode(F.sequence("lo", "hi", F.lit(RANGE_CHUNK).cast("long")))).withColumn("hi", F.least("hi", F.col("lo") + RANGE_CHUNK - 1))
    places = chunks.repartition("anc", "lo").select("anc", F.explode(F.sequence("lo", "hi")).alias("start"))
    return places.join(forest.select("start", "node"), "start").select("anc", "node")


def reachable_pairs(h: Hierarchy) -> DataFrame:
    """``node, anc``: every node and each node it leads up to by one or more links of any kind; (x, x) on a circle."""
    tree = durable(forest_pairs(h.forest, with_self=True))
    extra = h.extra
    entries = extra.select(F.col("parent").alias("entry")).distinct()
    step = (
        entries.join(tree, entries.entry == tree.node)
        .join(extra, F.col("anc") == F.col("child"))
        .select("entry", F.col("parent").alias("reach"))
        .union(entries.select("entry", F.col("entry").alias("reach")))
        .distinct()
    )
    closed = durable(step)
    count = closed.count()
    while True:
        onward = closed.select(F.col("entry").alias("reach"), F.col("reach").alias("further"))
        closed = durable(closed.join(onward, "reach").select("entry", F.col("further").alias("reach")).distinct())
        grown = closed.count()
        if grown == count:
            break
        count = grown
    enter = tree.join(extra, F.col("anc") == F.col("child")).select("node", F.col("parent").alias("entry")).distinct()
    deep = enter.join(closed, "entry").select("node", F.col("reach").alias("at")).distinct()
    beyond = deep.join(tree.select("anc", F.col("node").alias("at")), "at").select("node", "anc")
    return tree.where("node <> anc").select("node", "anc").union(beyond).distinct()
