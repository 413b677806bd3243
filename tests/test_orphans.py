import datetime

import pytest
from pyspark.sql import functions as F

from strataloom.operators.orphans import ForeignKey, missing_members, orphan_cascade, orphan_references, references, targets

DAY = [datetime.datetime(2024, 5, d) for d in range(1, 20)]


def test_states_and_edge_cases(spark):
    refs = spark.createDataFrame(
        [("a", DAY[0], DAY[5], ["t1", "t1", None]), ("a", DAY[0], DAY[9], ["t1"]), ("b", DAY[0], DAY[1], ["t1", "gone", "none"]), ("c", None, DAY[3], []), (None, DAY[0], DAY[0], ["none"]), ("d", None, None, ["t1"])],
        "id string, created_at timestamp, ingested_at timestamp, keys array<string>",
    )
    target = spark.createDataFrame([("t1", DAY[3], None), ("t1", DAY[8], None), ("gone", DAY[0], None), ("gone", DAY[2], DAY[2]), (None, DAY[0], None)], "id string, ingested_at timestamp, deleted_at timestamp")
    exploded = refs.select("id", "created_at", "ingested_at", F.explode("keys").alias("key"))
    found = orphan_references(references(exploded, "x", "keys", F.col("key")), targets(target))
    got = {(r["id"], r["target_key"], r["state"], r["period"]) for r in found.collect()}
    assert got == {("b", "t1", "late", "2024-05"), ("b", "gone", "deleted", "2024-05"), ("b", "none", "missing", "2024-05")}
    assert {r["state"] for r in orphan_references(references(exploded, "x", "keys", F.col("key")), targets(target.limit(0))).collect()} == {"missing"}
    assert orphan_references(references(exploded.limit(0), "x", "keys", F.col("key")), targets(target)).count() == 0


def test_missing_members(spark):
    refs = spark.createDataFrame([("s", "e1", "m9", DAY[0], "2024-05"), ("s", "e1", "m1", DAY[0], "2024-05"), ("s", "none", "m1", DAY[0], "2024-05")], "id string, grp string, target_key string, seen_at timestamp, period string")
    members = spark.createDataFrame([("e1", "m1")], "grp string, target_key string")
    owners = spark.createDataFrame([("e1",)], "target_key string")
    assert [(r["id"], r["target_key"]) for r in missing_members(refs, members, owners).collect()] == [("s", "m9")]


@pytest.mark.parametrize("seed", range(3))
def test_cascade_against_brute_force(spark, seed):
    import random

    rng = random.Random(seed)
    ids = {t: {f"{t}{i}" for i in range(12)} for t in "abc"}
    links = [(c, p, rng.choice(sorted(ids[c])), rng.choice(sorted(ids[p]) + ["none"])) for c, p in (("b", "a"), ("c", "b"), ("a", "c"), ("b", "b")) for _ in range(7)]
    orphan = {(c, i) for c, p, i, k in links if k not in ids[p]}
    direct = set(orphan)
    while True:
        more = {(c, i) for c, p, i, k in links if (p, k) in orphan} - orphan
        if not more:
            break
        orphan |= more
    tables = {t: spark.createDataFrame([(i,) for i in sorted(v)], "id string") for t, v in ids.items()}
    keys = [ForeignKey(c, p, spark.createDataFrame([(i, k) for c2, p2, i, k in links if (c2, p2) == (c, p)], "id string, target_key string")) for c, p in {(c, p) for c, p, _, _ in links}]
    got = {(r["tbl"], r["id"]): r["kind"] for r in orphan_cascade(tables, keys).collect()}
    assert got == {x: "direct" if x in direct else "inherited" for x in orphan}
