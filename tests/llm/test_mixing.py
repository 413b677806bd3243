import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.llm import mixing_queries
from strataloom.llm.mixing import TOKENIZER, flight, landing, mix, shares, token_counts


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 9)), max_size=40), st.integers(0, 99))
def test_flight_keeps_both_totals(rows, seed):
    p, size = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    after = flight(p, size, np.random.default_rng(seed))
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert np.isclose(after.sum(), p.sum(), atol=1e-6) and np.isclose((after * size).sum(), (p * size).sum(), atol=1e-5)
    landed = landing(after, size)
    assert set(landed) <= {0.0, 1.0}


def test_mix(spark):
    rng = np.random.default_rng(2)
    rows = [(i, ["big", "small", "tiny"][0 if i < 3000 else 1 if i < 3600 else 2], int(rng.integers(5, 60))) for i in range(3640)] + [(9999, None, 50), (9998, "none", 50), (9997, "big", 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 20)], "source string, target_share double, max_repeats int")
    mixed = mix(sized, targets, block=256)
    got = {r["source"]: r for r in shares(mixed, targets).collect()}
    total = sum(r["tokens"] for r in got.values())
    for name, share, cap in (("big", 0.5, 1), ("small", 0.3, 3), ("tiny", 0.2, 20)):
        assert abs(got[name]["tokens"] - share * total) <= 200 and got[name]["most_repeats"] <= cap
    assert mixed.where("doc_id in (9999, 9998, 9997)").count() == 0
    assert mix(sized, targets.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mix(sized, targets.union(spark.createDataFrame([("gone", 0.1, 1)], targets.schema)))
    with pytest.raises(ValueError):
        mix(sized, targets, block=7)
    least = mix(sized, targets, block=8)
    assert least.groupBy("doc_id").count().where("count > 1").count() == 0 and least.count() > 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no public vocabulary here")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "the pump"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["tokens"] for r in token_counts(df, ["doc_id"]).collect()} == {1: 2, 2: 0, 3: 0}


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no public vocabulary here")
def test_queries(spark, tmp_path):
    texts = [(i, "the pump runs " * (1 + i % 7), "wide" if i % 3 else "narrow") for i in range(300)] + [(900, "no source", None), (901, None, "wide"), (902, "", "wide")]
    spark.createDataFrame(texts, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("wide", 0.6, 1), ("narrow", 0.4, 3)], "source string, target_share double, max_repeats int").write.parquet(f"{tmp_path}/mix_target.parquet")
    got = {r["source"]: r for r in mixing_queries.QUERIES["p8_shares"](spark, str(tmp_path)).collect()}
    assert all(abs(got[s]["actual_share"] - got[s]["target_share"]) < 0.01 and got[s]["most_repeats"] <= cap for s, cap in (("wide", 1), ("narrow", 3)))
    used = mixing_queries.QUERIES["p8_mixed"](spark, str(tmp_path)).collect()
    assert sum(r["tokens"] * r["repeats"] for r in used) == sum(r["tokens"] for r in got.values()) and not {900, 901, 902} & {r["doc_id"] for r in used}
