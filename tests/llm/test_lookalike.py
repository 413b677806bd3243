import pytest
from pyspark.sql import Row

from strataloom.llm.lookalike import alike_pairs, canonical, fold, options, suspects


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("ＤＲＣ－８０４９１", "DRC-80491"), ("5 ℃", "5 °C"), ("5㎜", "5mm"), ("3 ㎡", "3 m²"), ("⽔⾯", "水面"), ("über", "über"), ("a​b­c", "abc"),
        ("a b c", "a b c"), ("A‐1", "A-1"), ("x² ≠ x2", "x² ≠ x2"), ("", ""), ("ｶﾞ", "ガ"), ("a\nb", "a\nb"),
    ],
)
def test_fold(given, wanted):
    assert fold(given) == wanted
    assert fold(fold(given)) == fold(given)


def test_suspects_and_options():
    assert suspects("the оil cooler") == [("оil", "L")]
    assert options("оil", "L") == ["oil"]
    assert suspects("Зазор у насоса") == []
    assert suspects("5 μm") == []


def test_repair_needs_the_vocabulary(spark):
    rows = [Row(id="a", text="the oil cooler"), Row(id="b", text="the оil cooler"), Row(id="c", text="a zоk"), Row(id="d", text=None), Row(id="e", text="")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r["id"]: r["canonical"] for r in canonical(df, ["id"]).collect()}
    assert got == {"a": "the oil cooler", "b": "the oil cooler", "c": "a zоk", "e": ""}


def test_repair_with_null_keys_extra_columns_and_repeats(spark):
    df = spark.createDataFrame([(None, "ABC-1", 1), (None, "АBC-1", 2), ("x", "АBC-1", 3), ("x", "АBC-1", 3)], "id string, text string, raw int")
    got = sorted((r["id"] or "", r["canonical"]) for r in canonical(df, ["id"]).collect())
    assert got == [("", "ABC-1"), ("", "ABC-1"), ("x", "ABC-1"), ("x", "ABC-1")]


def test_pairs_leave_out_equal_copies(spark):
    df = spark.createDataFrame([("t", "b", "1", "L"), ("t", "a", "2", "L"), ("t", "c", "1", "L"), ("t", "d", "9", "M")], "tbl string, id string, raw string, look string")
    assert sorted(tuple(r) for r in alike_pairs(df, "tbl").collect()) == [("t", "a", "b"), ("t", "a", "c")]
    assert alike_pairs(df.limit(0), "tbl").count() == 0
