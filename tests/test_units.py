import numpy as np
import pandas as pd
import pytest

from strataloom.functions.quantities import decimal_style, read_quantities, rounded, style_bucket, to_common
from strataloom.operators.units import common_quantities, style_weights, unit_posteriors


def read(text):
    return [(d, rounded(v)) for d, v in (to_common(q.value, q.unit) for q in read_quantities(text) if q.unit)]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("偏差1.5毫米", [("length", 1500)]), ("零下25摄氏度", [("temperature", -25000)]), ("油温达到−34℃时", [("temperature", -34000)]), ("稳压15分钟", [("time", 900)]),
        ("0.20千帕/小时", [("pressure_rate", 200)]), ("堵管率为百分之5", [("share", 50000)]), ("限值为5m²", []), ("流速约5 m/s", []), ("频率50 Hz，转速3000 r/min", []), ("1.2×10⁴ Pa", [("pressure", 12000)]),
        ("Angaben in Stunden. JGN-40049: Haltezeit links 34,7, rechts 2,5.", [("time", 124920), ("time", 9000)]), ("Für UVM-10000 gilt Prüfdruck 8 590N.", [("force", 8590)]), ("RHE-12225的中心偏差应为117～892μm。", [("length", 117), ("length", 892)]),
        ("浸泡时间达到十四昼夜时", [("time", 1209600)]), ("Keep it between 0.7‰ and 2.7‰.", [("share", 700), ("share", 2700)]), ("At T the offset was 4.72\" (accepted).", [("length", 119888)]), ("出口温度为88°F。", [("temperature", 31111)]),
        ("±0.80 mm/m at the base", [("slope", 800)]), ("", []), ("第38级叶片应编号，按8.10.14条执行。", []), ("水平度为3毫米每米", [("slope", 3000)]), ("全数检查十分重要", []),
    ],
)
def test_read(text, wanted):
    assert read(text) == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("中心偏差应不大于五十四厘米", [("length", 540000)]), ("真空下降速度：四十帕/小时", [("pressure_rate", 40)]), ("外露长度为五十八微米", [("length", 58)]), ("拉力：七十九公斤力", [("force", 775)]),
        ("吊装质量：十磅", [("mass", 4536)]), ("填料用量：二十二克", [("mass", 22)]), ("压降速率为七十帕/小时", [("pressure_rate", 70)]),
        ("压力为四十千帕", [("pressure", 40000)]), ("压力五千帕", [("pressure", 5000)]), ("一万二千零五帕", [("pressure", 12005)]), ("三万帕", [("pressure", 30000)]), ("三百千克", [("mass", 300000)]), ("间隙三至五毫米", [("length", 3000), ("length", 5000)]),
        ("一点五毫米", [("length", 1500)]), ("零下三十度", [("temperature", -30000)]), ("十五分后停运", [("time", 900)]), ("二百七十三开", [("temperature", -150)]), ("约二三十天", [("time", 2592000)]),
        ("一度停运", []), ("十分重要", []), ("三分之一", []), ("三十分之一", []), ("单位：千帕", []), ("数值以千牛计", []), ("从一开始", []), ("66.1千牛", [("force", 66100)]), ('标为"十"', []), ("第三十米处", []), ("二十米/秒", []), ("三平方米", []), ("五十立方米", []), ("四千次", []), ("应不大于半小时", [("time", 1800)]), ("半个小时", [("time", 1800)]), ("一个半小时", []), ("阀门半开", []),
    ],
)
def test_read_chinese_numerals(text, wanted):
    assert read(text) == wanted


def test_units_of_bare_values_by_mixture():
    rng = np.random.default_rng(1)
    known = pd.DataFrame({"bin": np.round(np.log10(rng.lognormal(np.log(3000), 0.2, 200)) / 0.05).astype(int), "unit": ["mm"] * 150 + ["cm"] * 50, "n": 1})
    bare = pd.DataFrame({"bin": [round(np.log10(3.1) / 0.05), round(np.log10(0.3) / 0.05)], "n": [10, 10]})
    got = unit_posteriors(known, bare)
    assert list(got["unit"]) == ["mm", "cm"] and (got["posterior"] > 0.9).all()


def test_table(spark):
    rows = [(f"s{i}", f"实测ABC-{10000 + i}的间隙：{2 + i % 3}.5 mm。") for i in range(30)] + [("bare", "ABC-20000的间隙，左侧2.6，右侧0。"), ("null", None), ("empty", ""), ("s1", "实测ABC-10001的间隙：3.5 mm。")]
    got = common_quantities(spark.createDataFrame(rows, "id string, text string")).collect()
    assert sum(not r["inferred"] for r in got) == 30
    bare = {r["amount"]: r for r in got if r["inferred"]}
    assert bare[2600]["unit"] == "mm" and not bare[2600]["uncertain"] and bare[None]["uncertain"]
    assert common_quantities(spark.createDataFrame([], "id string, text string")).count() == 0


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("क्लीयरेंस ५ मिमी", [("length", 5000)]), ("الخلوص ٣ مم", [("length", 3000)]), ("间隙不大于三毫米", [("length", 3000)]), ("压力不低于十千帕", [("pressure", 10000)]), ("三十毫米", [("length", 30000)]),
        ("Spiel: 1,250 mm laut Zeichnung", [("length", 1250)]), ("clearance: 1,250 mm by the drawing", [("length", 1250000)]),
        ("A-1: Spiel 3,5. Angaben in mm.", [("length", 3500)]), ("Angaben in mm. A-1: Spiel 3,5. B-2: Weg 2,5. Es gibt 21 Schrauben.", [("length", 3500), ("length", 2500)]),
        ("单位：mm。甲的间隙3.5。单位：kPa。乙的压力2。换热面积8 m²，容积7.4 m³。", [("length", 3500), ("pressure", 2000)]), ("3.5。", []),
    ],
)
def test_read_across_sentences(text, wanted):
    assert read(text) == wanted


def test_decimal_style_learned_from_separators(spark):
    rows = [(f"Spalt am Rotor: {i},5 mm",) for i in range(20)] + [(f"rotor gap: {i}.5 mm",) for i in range(20)] + [(None,), ("",), ("Spalt 1,250 mm",)]
    weights = style_weights(spark.createDataFrame(rows, "text string"))
    assert weights[style_bucket("spalt")] > 1 > -1 > weights[style_bucket("gap")]
    assert decimal_style("Spalt 1,250", weights) == "comma" and decimal_style("gap 1,250", weights) == "point" and decimal_style("Spalt 1.250,5 gap") == "comma"
    assert not style_weights(spark.createDataFrame([], "text string")).any()


def test_named_units_are_prior_evidence():
    known = pd.DataFrame({"bin": np.round(np.log10(np.random.default_rng(1).lognormal(np.log(3000), 0.2, 200)) / 0.05).astype(int), "unit": "mm", "n": 1})
    at = round(np.log10(3.1) / 0.05)
    bare = pd.DataFrame({"bin": [at, at, at, 120], "named": ["mm", "kPa", None, "cm"], "n": [1, 1, 1, 1]})
    got = unit_posteriors(known, bare)
    assert list(got["unit"]) == ["mm", "kPa", "mm", "cm"] and (got["posterior"] > 0.9).all()


def test_unitless_values_come_through_the_mixture(spark):
    rows = [(f"s{i}", f"实测ABC-{10000 + i}的间隙：{2 + i % 3}.5 mm。") for i in range(30)] + [(f"h{i}", f"实测ABC-{20000 + i}的重量：{20 + i % 9} kg。") for i in range(30)]
    rows += [("bare", "实测ABC-3的间隙：3.1。"), ("named", "单位：mm。实测ABC-4的间隙：3.1。"), ("apart", "实测ABC-5的间隙：0.4。单位：cm。"), ("heat", "单位：°F。实测ABC-6的温度：50。"), ("odd", "实测ABC-7的间隙：70000。"), ("no", "实测ABC-8的颜色：7。"), ("zero", "单位：mm。实测ABC-9的间隙：0。")]
    got = {r["id"]: r for r in common_quantities(spark.createDataFrame(rows, "id string, text string")).where("inferred").collect()}
    assert (got["bare"]["amount"], got["bare"]["unit"], got["bare"]["uncertain"]) == (3100, "mm", False)
    assert got["named"]["amount"] == 3100 and got["apart"]["amount"] == 4000 and got["apart"]["unit"] == "cm" and got["heat"]["amount"] == 10000 and got["zero"]["amount"] == 0
    assert not any(got[k]["uncertain"] for k in ("named", "apart", "heat", "zero")) and got["no"]["uncertain"] and got["no"]["amount"] is None
    # With one known unit nothing else is possible, so even an outlier takes it.
    assert got["odd"]["unit"] == "mm"
