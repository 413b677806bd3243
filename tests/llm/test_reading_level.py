import numpy as np

from strataloom.llm.reading_level import features, formula, reading_levels


def _corpus(spark, rows=300):
    rng = np.random.default_rng(3)
    words = [["cat", "sun", "run"], ["pump", "valve", "oil"], ["isolate", "torque", "bearing"], ["gradient", "damping", "rotor"], ["covariance", "asymptotic", "functional"]]
    docs, labels = [], []
    for i in range(rows):
        level = i % 5
        docs.append((i, " ".join(rng.choice(words[level], 30))))
        if i % 3:
            labels.append((i, "r", level + 1))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, rater string, level int")


def test_held_out_accuracy(spark):
    docs, labels = _corpus(spark)
    got = {r["doc_id"]: r["level"] for r in reading_levels(docs, labels).collect()}
    assert len(got) == 300
    assert np.mean([got[i] == i % 5 + 1 for i in range(0, 300, 3)]) > 0.95


def test_null_empty_and_no_labels(spark):
    docs, labels = _corpus(spark, 60)
    odd = docs.union(spark.createDataFrame([(900, None), (901, ""), (902, "!!!")], docs.schema))
    got = {r["doc_id"]: (r["level"], r["posterior"]) for r in reading_levels(odd, labels).collect()}
    assert all(got[k][1] == 0 and 1 <= got[k][0] <= 5 for k in (900, 901, 902))
    assert reading_levels(odd, labels.limit(0)).count() == 63
    assert reading_levels(docs.limit(0), labels).count() == 0


def test_features():
    assert len(features("")) == 0
    assert len(features("水泵 ab 12")) == 3
    assert formula("A b.") < formula("Notwithstanding considerable thermodynamic irreversibility " * 8)
