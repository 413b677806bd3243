import itertools

import pytest
from pyspark.sql import functions as F

from strataloom.functions.text import search_tokens
from strataloom.functions.truth import compile_condition, kleene_all, kleene_any, state
from strataloom.operators.components import components
from strataloom.operators.names import contained_names
from strataloom.operators.records import change_report, latest, merged
from strataloom.operators.retrieval import ladder, page, query_tokens, search
from strataloom.operators.spans import nearest, sections, spans_of


def test_search_tokens(spark):
    df = spark.createDataFrame([("１．２５ MM 焊缝检查",), ("1.25 mm 焊缝检查",), ("轴",), ("",), (None,), ("Straße",)], "t string")
    got = [r[0] for r in df.select(search_tokens(F.col("t"))).collect()]
    assert got[0] == got[1] == ["1.25", "mm", "焊缝", "缝检", "检查"]
    assert got[2:] == [["轴"], [], [], ["strasse"]]


def test_kleene_folds(spark):
    values = [True, False, None]
    for rows in itertools.chain.from_iterable(itertools.product(values, repeat=n) for n in (1, 2)):
        df = spark.createDataFrame([(v,) for v in rows], "v boolean").agg(kleene_all(F.col("v")).alias("a"), kleene_any(F.col("v")).alias("o"))
        a, o = df.first()
        assert a == (False if False in rows else None if None in rows else True)
        assert o == (True if True in rows else None if None in rows else False)


@pytest.mark.parametrize(
    ("expression", "wanted"),
    [
        ({"op": "le", "parameter": "gap", "value": 0.1, "unit": "mm", "location": "孔"}, "applicable"),
        ({"op": "le", "parameter": "gap", "value": 0.01, "unit": "mm", "location": "孔"}, "not_applicable"),
        ({"op": "le", "parameter": "gap", "value": 0.1, "unit": "mm", "location": "轴"}, "unknown"),
        ({"op": "le", "parameter": "gap", "value": 0.1, "unit": "MPa", "location": "孔"}, "unknown"),
        ({"op": "eq", "parameter": "state", "value": "冷态"}, "unknown"),
        ({"op": "eq", "parameter": "state", "value": "冷态", "vocabulary": ["冷态", "热态"]}, "not_applicable"),
        ({"op": "not", "item": {"op": "eq", "parameter": "state", "value": "热 态"}}, "not_applicable"),
        ({"op": "or", "items": [{"op": "eq", "parameter": "state", "value": "热态"}, {"op": "eq", "parameter": "none", "value": "x"}]}, "applicable"),
        ({"op": "and", "items": [{"op": "eq", "parameter": "state", "value": "热态"}, {"op": "eq", "parameter": "none", "value": "x"}]}, "unknown"),
        ({"op": "and", "items": []}, "unknown"), (None, "unknown"), ({"op": "xx"}, "unknown"),
    ],
)
def test_conditions(spark, expression, wanted):
    df = spark.createDataFrame([(0.00005, "m", "孔", "热态")], "v double, u string, l string, w string")
    facts = {"gap": {"value": F.col("v"), "unit": F.col("u"), "location": F.col("l")}, "state": {"word": F.col("w")}}
    assert df.select(state(compile_condition(expression, facts))).first()[0] == wanted


def test_search_and_pages(spark):
    df = spark.createDataFrame([("a", "焊缝应检查"), ("b", "焊缝焊缝"), ("c", "检查记录"), ("d", None), ("e", "")], "id string, text string")
    both = search(df, query_tokens(spark, "焊缝", ["焊缝", "检查"]), "all")
    assert [r["id"] for r in both.collect()] == ["a"]
    some = {r["id"]: r["hits"] for r in search(df, query_tokens(spark, "x", ["焊缝", "检查", " 焊缝 "]), "any").collect()}
    assert some == {"a": 2, "b": 1, "c": 1}
    assert ladder(df, "焊缝", anchors=["无此物"], terms=["焊缝"])[0] == "original_term_fallback"
    with pytest.raises(ValueError):
        query_tokens(spark, " ")
    first, cursor = page(df, ["id"], 2, {"q": 1})
    second, _ = page(df, ["id"], 2, {"q": 1}, cursor)
    assert [r["id"] for r in first.collect()] == ["a", "b"] and [r["id"] for r in second.collect()] == ["c", "d"]
    with pytest.raises(ValueError):
        page(df, ["id"], 2, {"q": 2}, cursor)


def test_names_both_ways(spark):
    texts = spark.createDataFrame([(1, "abc 主汽阀"), (2, "b"), (3, None), (4, "")], "id int, text string")
    names = spark.createDataFrame([("b",), ("bc",), ("abc",), ("主汽阀",), ("",), (None,), ("zz",)], "name string")
    a = {tuple(r) for r in contained_names(texts, names, "id", "text", "name").collect()}
    b = {(t["id"], n["name"]) for t in texts.collect() for n in names.collect() if t["text"] and n["name"] and n["name"] in t["text"]}
    assert a == b == {(1, "b"), (1, "bc"), (1, "abc"), (1, "主汽阀"), (2, "b")}
    assert contained_names(texts, names.limit(0), "id", "text", "name").count() == 0


def test_components(spark):
    links = [(f"a{i}", f"a{i + 1}") for i in range(40)] + [("x", "y"), ("x", "x"), ("z", None), ("q", "q")]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert {got[f"a{i}"] for i in range(41)} == {"a0"} and got["y"] == got["x"] == "x" and got["q"] == "q" and "z" not in got
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_records(spark):
    rows = spark.createDataFrame([("a", 1, "x", "s", None), ("a", 2, None, "t", None), ("b", 5, "y", "u", 5), (None, 1, "z", "v", None)], "id string, ingested_at int, text string, content string, deleted_at int")
    assert {(r["id"], r["text"]) for r in latest(rows).collect()} == {("a", None), ("b", "y")}
    assert {(r["id"], r["text"]) for r in merged(rows.select("id", "ingested_at", "text")).collect()} == {("a", "x"), ("b", "y")}
    assert {tuple(r) for r in change_report(rows.where("id is not null"), F.lit(2)).collect()} == {("a", "updated"), ("b", "created")}


def test_spans_sections_nearest(spark):
    df = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("g", 5), ("g", None)], "g string, v int")
    assert sorted(tuple(r) for r in spans_of(df, "g", "v").collect()) == [("g", 1, 2), ("g", 5, 5)]
    h = spark.createDataFrame([("7", "d", 10, 0, 1), ("7.1", "d", 10, 1, 2), ("7.2", "d", 14, 0, 2), ("8", "d", 15, 0, 1)], "id string, document_id string, page int, ord int, level int")
    assert {r["id"]: r["last_page"] for r in sections(h).collect()} == {"7": 15, "7.1": 14, "7.2": 15, "8": None}
    left = spark.createDataFrame([("a", "d", 5), ("b", "d", 8), ("c", "d", 3), ("e", "x", 1)], "id string, doc string, page int")
    right = spark.createDataFrame([("r1", "d", 4), ("r2", "d", 8), ("r3", "d", 8), ("r4", "d", 2)], "rid string, doc string, page int")
    assert {r["id"]: (r["rid"], r["distance"]) for r in nearest(left, right, "doc", "page", "id", "rid").collect()} == {"a": ("r1", 1)}
