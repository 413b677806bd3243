from decimal import Decimal

from strataloom.functions.limits import read_limits
from strataloom.operators.limits import limits_and_facts
from strataloom.plans import structure_queries


def said(text):
    return [(x.op, x.value, x.unit) for x in read_limits(text)[0]]


def test_all_limits_of_a_text():
    assert said("保压时间应不大于74.6个小时") == [("le", 74.6, "h")]
    assert said("间隙应不大于869 µm") == [("le", 869.0, "μm")]
    assert said("占比应不小于５‰，压力应小于3千帕；长度不应超过２.５英寸。") == [("ge", 5.0, "‰"), ("lt", 3.0, "kPa"), ("le", 2.5, "in")]
    assert said("转速应不大于3000 r/min，面积应大于5 m²，温度高于零下5℃") == [("le", 3000.0, "r/min"), ("gt", 5.0, "m2"), ("gt", -5.0, "°C")]
    assert said("压力不高于3 kPa，不得低于2 kPa") == [("le", 3.0, "kPa"), ("ge", 2.0, "kPa")]
    assert said("数值单位：千牛。AB-1的拉力应不大于33.5。") == [("le", 33.5, "kN")]
    assert said("应不大于5。") == [] and said("") == []


# Parameter, limit and fact as printed, and both in one unit as worked out by hand.
PAIRS = [
    ("背压", "3千帕", "2999帕", "pressure", 3000, 2999), ("试验压力", "0.2兆帕", "200 kPa", "pressure", 200, 200), ("浸泡时间", "90秒", "2 min", "time", 90, 120), ("保压时间", "3小时", "179分钟", "time", 180, 179),
    ("拉力", "4千牛", "4001 N", "force", 4000, 4001), ("质量", "2千克", "2.5公斤", "mass", 2, 2.5), ("堵管率", "1%", "9‰", "share", 10, 9), ("壁温", "30℃", "303.15 K", "temperature", 30, 30), ("水平度", "2mm/m", "3毫米每米", "slope", 2, 3),
    ("降速", "2kPa/h", "1999 Pa/h", "rate", 2000, 1999), ("间隙", "500µm", "0.6毫米", "length", 500, 600), ("偏差", "五厘米", "1英寸", "length", 50, 25.4), ("转速", "5 r/min", "4 r/min", None, 5, 4), ("厚度", "3 mm", "3 kPa", None, 3, 3),
]
COMPARE = {"应不大于": ("le", lambda a, b: a <= b), "应小于": ("lt", lambda a, b: a < b), "不低于": ("ge", lambda a, b: a >= b), "应大于": ("gt", lambda a, b: a > b), "应等于": ("eq", lambda a, b: a == b)}


def test_every_unit_is_compared(spark):
    rows, want = [], set()
    for i, (parameter, limit, fact, dimension, a, b) in enumerate(PAIRS):
        rows.append((f"f{i}", f"实测ABC-{i}的{parameter}：{fact}。"))
        for word, (op, holds) in COMPARE.items():
            rows.append((f"r{i}{op}", f"ABC-{i}的{parameter}{word}{limit}，合格。"))
            want.add((f"r{i}{op}", f"ABC-{i}", parameter, op, "unknown" if dimension is None else "satisfied" if holds(Decimal(str(b)), Decimal(str(a))) else "not_satisfied"))
    rows += [("f", "实测ＡＢ－７的间隙：3 mm。实测AB-7的间隙：4000微米。"), ("r", "AB-7的间隙应不大于5 mm。"), ("g", "实测AB-8的间隙：3～4 mm。"), ("s", "AB-8的间隙应不大于5 mm。"), ("t", "AB-9的间隙应不大于5 mm。"), ("null", None)]
    want |= {("r", "AB-7", "间隙", "le", "unknown"), ("s", "AB-8", "间隙", "le", "unknown"), ("t", "AB-9", "间隙", "le", "unknown")}
    df = spark.createDataFrame([(key, text, i) for i, (key, text) in enumerate(rows)], "id string, text string, n int")
    structure = structure_queries._latest
    structure_queries._latest = lambda *a: df
    try:
        got = [tuple(r) for r in structure_queries.QUERIES["x11_comparisons"](spark, "").collect()]
    finally:
        structure_queries._latest = structure
    assert len(got) == len(set(got)) and set(got) == want
    assert limits_and_facts(df.limit(0)).count() == 0
