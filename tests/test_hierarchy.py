import random

import pytest

from strataloom.operators.hierarchy import build_hierarchy, class_links, forest_pairs, reachable_pairs


def reach(links):
    up = {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    out = set()
    for node in up:
        stack, seen = list(up[node]), set()
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += up.get(x, ())
        out |= {(node, x) for x in seen}
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, parent string, additional_parents array<string>")


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_with_circles(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)]
    rows = [(n, rng.choice([*names, None, "unknown"]), rng.choice([None, [], [rng.choice(names)], [rng.choice(names), None]])) for n in names]
    rows += [rows[3], rows[3], (None, "n1", None)]
    h = build_hierarchy(*class_links(table(spark, rows)))
    links = {(i, p) for i, parent, more in rows if i for p in [parent, *(more or [])] if p in names}
    assert {(r["node"], r["anc"]) for r in reachable_pairs(h).collect()} == reach(links)
    forest = {r["node"]: r for r in h.forest.collect()}
    assert set(forest) == set(names)
    assert len({r["start"] for r in forest.values()}) == len(names)
    pairs = {(r["anc"], r["node"]) for r in forest_pairs(h.forest).collect()}
    assert pairs == {(a, n) for n, r in forest.items() for a in r["path"][:-1]}
    for n, r in forest.items():
        assert r["path"][-1] == n and r["path"][0] == r["root"] and r["depth"] == len(r["path"]) - 1
        assert r["size"] == 1 + sum(a == n for a, _ in pairs)


def test_empty_single_and_own_parent(spark):
    h = build_hierarchy(*class_links(table(spark, []).limit(0)))
    assert h.forest.count() == 0 and reachable_pairs(h).count() == 0
    h = build_hierarchy(*class_links(table(spark, [("x", "x", None)])))
    assert [tuple(r) for r in reachable_pairs(h).collect()] == [("x", "x")]
    assert h.forest.first()["on_circle"]


def test_hub(spark):
    h = build_hierarchy(*class_links(table(spark, [("hub", None, None)] + [(f"k{i}", "hub", None) for i in range(300)])))
    assert h.forest.where("node = 'hub'").first()["size"] == 301
    assert h.forest.agg({"start": "max"}).first()[0] == 300
