import tempfile

import pytest
from pyspark.sql import functions as F

from strataloom.functions.comparison import quantity_in_text, verdict
from strataloom.functions.limits import read_limits
from strataloom.functions.quantities import read_quantities, usual
from strataloom.operators.clause_limits import bound_text, checked_facts, clause_limits, content_runs, evidence_limits
from strataloom.operators.patches import patched
from strataloom.operators.skew import salted_join
from strataloom.plans.survey_queries import QUERIES


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("偏差1.5毫米", {(1.5, "mm")}), ("零下25摄氏度", {(-25.0, "°C")}), ("−25℃", {(-25.0, "°C")}), ("稳压15分钟", {(15.0, "min")}), ("0.20千帕/小时", {(0.2, "kPa/h")}), ("百分之5", {(5.0, "%")}), ("1纳米", set()), ("4mm/unknown", set()),
        *((f"限值为5{u}", set()) for u in ("m²", "m³", "m2", "m^2", "m/s", "m·s", "m-2", "mΩ", "m_foo")),
    ],
)
def test_quantities_of_the_fixtures(text, wanted):
    assert {(float(q.value), usual(q.unit)) for q in read_quantities(text) if q.unit} == wanted


def test_quantity_in_text():
    assert quantity_in_text(10, "mm", "测得1厘米") and not quantity_in_text(10, "m", "测得10毫米") and quantity_in_text(-25, "℃", "气温零下25摄氏度") and quantity_in_text(0, "℃", "0摄氏度")
    assert quantity_in_text(5, "m²", "面积为5m²") and not quantity_in_text(5, "m²", "面积为5m³")
    assert quantity_in_text("1.25", "倍工作压力", "不小于工作压力的1.25倍") and not quantity_in_text("1.25", "倍额定压力", "不小于工作压力的1.25倍")
    assert not quantity_in_text(None, "mm", "1mm") and not quantity_in_text(True, "mm", "1mm") and not quantity_in_text(1, "", "1mm") and not quantity_in_text(1, "mm", None) and not quantity_in_text("3～5", "mm", "3～5mm")


def check(value, op="le", unit="mm", limit=3, own="mm", applicability="applicable", facts=1, **more):
    quantity = {"target": "壳体", "parameter": "偏差", "value": limit, "unit": unit, "op": op} | more.get("quantity", {})
    return verdict(quantity, {"value": value, "unit": own} | more.get("fact", {}), facts, applicability)[0]


def test_verdicts():
    assert [check(3), check(3, "lt"), check("3.000000000001"), check(2, "ge"), check(3, "eq")] == ["satisfied", "not_satisfied", "not_satisfied", "not_satisfied", "satisfied"]
    assert check("0.003", own="m") == "satisfied" and check("1.2", "ge", "1", "1.25", "倍") == "not_satisfied" and check(10, "ge", "s", 600, "min") == "satisfied"
    assert check("1.30", "ge", "倍工作压力", "1.25", "倍工作压力") == "satisfied" and check("1.20", "ge", "倍工作压力", "1.25", "倍工作压力") == "not_satisfied"
    assert {check("1.30", "ge", "倍工作压力", "1.25", own) for own in ("倍额定压力", "倍")} == {"unknown"}
    unknown = [{"applicability": "unknown"}, {"own": None}, {"own": "MPa"}, {"quantity": {"target": None}}, {"fact": {"target": "另一部件"}}, {"quantity": {"parameter": None}}, {"quantity": {"location": "端面"}}, {"quantity": {"op": "about"}}, {"quantity": {"value": "3～5"}}, {"facts": 2}]
    assert {check(3, **k) for k in unknown} == {"unknown"} == {check(float("nan")), check(True), check(None)}
    assert check(3, quantity={"location": "端面"}, fact={"location": "端面"}) == "satisfied" and check(3, quantity={"location": "端面"}, fact={"location": "侧面"}) == "unknown" and check(3, applicability="not_applicable") == "not_applicable"


def test_clause_limits():
    said = lambda text: [(x[1], x[2], x[3], x[6]) for x in clause_limits(text)]
    assert said("标高偏差不大于44mm；间隙应小于3毫米，合格。") == [("le", 44.0, "mm", None), ("lt", 3.0, "mm", None)]
    assert said("端面偏差不大于2mm") == [("le", 2.0, "mm", "端面")] and said("端面和侧面偏差不大于2mm") == []
    assert said("如果停机偏差不大于2mm") == [] and said("安装前偏差不大于2mm") == [] and said("长5m的管偏差不大于2mm") == [] and said("不大于2mm且不小于1mm") == [] and said("") == []
    assert not read_limits("偏差2mm")[0]


def test_content_runs_and_checked_facts(spark):
    rows = [("e", "a", 0, "content", "AB-1的间隙应不大", None), ("e", "b", 1, "content", "于3 mm。", None), ("e", "c", 2, "content", "CD-2的间隙不大于1 mm", "unreadable"), ("e", "d", 3, "section", "总则", None), ("e", "f", 4, "content", None, None), ("f", "a", 0, "content", "2.1 EF-3的偏差不大于5 mm", None), ("f", "b", 1, "content", "2.2 EF-3的偏差不大于6 mm。", None)]
    runs = content_runs(spark.createDataFrame(rows, "evidence_id string, member_key string, ord int, role string, text string, quality string"))
    got = {(r["evidence_id"], tuple(r["member_keys"])): r["text"] for r in runs.collect()}
    assert got == {("e", ("a", "b")): "AB-1的间隙应不大于3 mm。", ("f", ("a",)): "2.1 EF-3的偏差不大于5 mm", ("f", ("b",)): "2.2 EF-3的偏差不大于6 mm。"}
    facts = spark.createDataFrame([("AB-1", "间隙", "length", 2000.0), ("AB-1", "间隙", "length", 2000.0), ("EF-3", "偏差", "length", 1.0), ("CD-2", "间隙", "length", 1.0), ("AB-1", "重量", "mass", 1.0), (None, "间隙", "length", 1.0)], "tag string, parameter string, dimension string, common double")
    limits = evidence_limits(runs)
    assert {(r["tag"], r["parameter"]): (r["candidates"], r["status"]) for r in checked_facts(limits, facts).collect()} == {("AB-1", "间隙"): (1, "satisfied"), ("EF-3", "偏差"): (2, "unknown"), ("CD-2", "间隙"): (0, "unknown"), ("AB-1", "重量"): (0, "unknown")}
    assert evidence_limits(runs.limit(0)).count() == 0


def test_bound_text():
    assert bound_text("应 检查管板", ["另应检", " 查管\n板。"]) == [(0, 1, 3), (1, 1, 5)]
    assert bound_text("检查", ["检查，检查"]) is None and bound_text("无", ["检查"]) is None and bound_text(" ", ["检查"]) is None and bound_text("a", []) is None


def test_patches(spark):
    current = spark.createDataFrame([("a", "t1", "甲 乙"), ("b", "t2", "丙")], "id string, owner string, text string")
    ops = [("replace", "a", "t1", "新", None), ("replace", "b", "t1", "x", None), ("replace", "c", "t1", "x", None), ("add", None, "t1", "丁", "n1"), ("add", None, "t2", " 丙", "n2"), ("add", None, "t1", "y", "b"), ("drop", "a", "t1", "x", None), ("replace", "a", "t1", "新", None)]
    after, refused = patched(current, spark.createDataFrame(ops, "op string, target string, owner string, text string, new_id string"))
    assert {tuple(r) for r in after.collect()} == {("a", "t1", "新"), ("b", "t2", "丙"), ("n1", "t1", "丁")}
    assert sorted(r["reason"] for r in refused.collect()) == ["another owner", "id taken", "no such target", "unknown operation"]


def test_salted_join_equals_the_plain_one(spark):
    left = spark.createDataFrame([(i % 3 or None, i, [i]) for i in range(40)], "k int, v int, a array<int>")
    right = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (9, "w")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, salted_join(left, right, ["k"], F.col("v"), how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    assert salted_join(left, right, ["k"]).count() == left.join(right, "k").count()


def test_list_parents_broadcast_no_units(spark):
    """The units are neither copied nor broadcast, whatever size their compressed columns suggest."""
    rows = [(f"u{i}", None if i == 5 else f"{i} 甲应清洁") for i in range(6)]
    with tempfile.TemporaryDirectory() as d:
        at = ("timestamp'2024-01-01' as ingested_at", "timestamp'2024-01-01' as created_at", "'d' as document_id")
        spark.createDataFrame(rows, "id string, text string").selectExpr("*", *at).write.parquet(f"{d}/source_unit.parquet")
        members = [("e", [(f"m{i}", f"u{i}", i, "content", (1,)) for i in range(7)])]
        spark.createDataFrame(members, "id string, members array<struct<member_key: string, source_id: string, ord: int, role: string, locator: struct<physical_page: int>>>").selectExpr("*", *at).write.parquet(f"{d}/evidence.parquet")
        df = QUERIES["w8_list_parents"](spark, d)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "sequence(" not in plan
        assert sorted(map(tuple, df.collect())) == [("e", f"m{i}", 1, None) for i in range(5)]
