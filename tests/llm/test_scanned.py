from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strataloom.llm import scanned
from strataloom.llm.scanned import COSINE, best_threshold, broken, code_misread, corrected_line, defects, glyph_edits, near, page_mark, reflowed, repaired


@pytest.mark.parametrize(
    ("line", "wanted"),
    [("- 12 -", ("marked", False, 12)), ("·2B·", ("marked", True, 28)), ("vii", ("roman", False, None)), ("第 7 页", ("marked", False, 7)), ("12", ("plain", False, 12)), ("4.5", None), ("mm).", None), ("", None)],
)
def test_page_mark(line, wanted):
    assert page_mark(line) == wanted


def test_small_parts():
    assert code_misread("UFW", "76l37") and not code_misread("UFW", "76137")
    assert near("加热器施■图说明", "加热器施工图说明") and not near("abcdefgh", "xyzdefgh")
    assert "the" in glyph_edits("tbe") and "remained" in glyph_edits("rernained")
    assert [c[2:] for c in broken([(1, "two con-"), (2, "tact (GPE-"), (3, "55648)")])] == [("con", "-", "tact")]


def test_defects(spark):
    body = "The crew shall measure the contact area of the guide key.\nThe high-pressure heater is clean and the contact area is dry."
    rows = [Row(id=f"u{i}", document_id="d", page=i, text=f"Condenser Guide\n{body}\n- {i} -", text_origin="ocr_text") for i in range(1, 13)]
    rows.append(Row(id="bad", document_id="d", page=13, text="Condenser Gu!de\ntbe crew shall measure the con-\ntact area of the high-\npressure heater.\n13", text_origin=None))
    rows += [Row(id="null", document_id="d", page=None, text=None, text_origin="ocr_text"), Row(id="native", document_id="d", page=1, text="tbe con-\ntact", text_origin="native_text"), Row(id="empty", document_id=None, page=None, text="", text_origin="ocr_text")]
    df = spark.createDataFrame(rows, "id string, document_id string, page int, text string, text_origin string")
    df = df.selectExpr("id", "document_id", "text", "text_origin", "named_struct('physical_page', page) as locator")
    got = {tuple(r) for r in defects(df).where("id = 'bad'").collect()}
    assert got == {("bad", 1, "running_head"), ("bad", 1, "misread"), ("bad", 2, "misread"), ("bad", 2, "broken_word"), ("bad", 5, "page_number")}
    text = {r["id"]: r["text"] for r in repaired(df).collect()}
    assert text["bad"] == "the crew shall measure the contact area of the high-pressure heater."
    assert text["u1"].startswith("The crew shall measure the contact area of the guide key.") and "Condenser Guide" not in text["u1"] and text["empty"] == ""
    clean = {(r["line_no"], r["defect"]) for r in defects(df).where("id = 'u1'").collect()}
    assert clean == {(1, "running_head"), (4, "page_number")}
    assert defects(df.limit(0)).count() == 0


def test_lines_put_right():
    assert corrected_line("Tbe GPE-5S648 is 1l.5mm", "", "", {"tbe": "the"}, {}) == "The GPE-55648 is 11.5mm"
    assert corrected_line("隔扳的", "", "", {}, {"隔扳的": "板"}) == "隔板的"
    assert reflowed([(1, "a con-"), (2, "tact (GPE-"), (3, "55648)"), (4, "is dry.")], {1}) == "a contact (GPE-55648) is dry."
    assert reflowed([(1, "检查两"), (2, "次。"), (3, "另行通知")], set()) == "检查两次。\n另行通知"
    assert reflowed([], set()) == ""


def _scans(spark, rows):
    return spark.createDataFrame(rows, "id string, text string").selectExpr("id", "id as document_id", "text", "'ocr_text' as text_origin", "named_struct('physical_page', 1) as locator")


def test_first_and_last_ideographs(spark):
    rows = [(f"u{i}", "螺栓紧固后应检查\n缸体接管") for i in range(30)] + [(f"first{k}", "蝶栓紧固后应检查\n缸体接管") for k in "ab"] + [(f"last{k}", "螺栓紧固后应检查\n缸体接菅") for k in "ab"]
    df = _scans(spark, rows)
    assert {tuple(r) for r in defects(df).collect()} == {("firsta", 1, "misread"), ("firstb", 1, "misread"), ("lasta", 2, "misread"), ("lastb", 2, "misread")}
    assert {r["text"] for r in repaired(df).collect()} == {"螺栓紧固后应检查缸体接管"}


def test_vectors_decide(spark):
    rows = [(f"u{i}", f"Close the pump head before the crew leaves.\nThe pump head is dry number {i % 7} today.") for i in range(60)]
    rows += [("wrong", "Close the pump hcad before tbe crew leaves."), ("right", "A glass bead lies beside my ring.")]
    df = _scans(spark, rows)
    assert {tuple(r) for r in defects(df).collect()} == {("wrong", 1, "misread")}
    assert {tuple(r) for r in defects(df, threshold=-1.0).collect()} == {("wrong", 1, "misread"), ("right", 1, "misread")}


def test_ideographs_at_home_elsewhere_stay(spark):
    """An ideograph of its own that stands where another one mostly stands is told by its vector, not by counts alone."""
    rows = [(f"u{i}", "管道应检查两次\n阀门应检查两次") for i in range(40)] + [(f"v{i}", "人员入场登记\n水箱入口清洁") for i in range(12)]
    rows += [("own", "阀门均检查两次"), ("own2", "均检查两次均清洁")] + [(f"w{i}", "均检查焊缝，均检查螺栓") for i in range(12)] + [("odd", "阀门庆检查两次"), ("odd2", "管道庆检查两次")]
    assert {tuple(r) for r in defects(_scans(spark, rows)).collect()} == {("odd", 1, "misread"), ("odd2", 1, "misread")}


def test_threshold_from_held_out_pairs():
    assert 0.2 < best_threshold([0.3, 0.4, 0.5, 0.6], [0.0, 0.1, 0.2]) <= 0.3
    assert best_threshold([], [0.1]) == COSINE == best_threshold([0.3], [])


def test_every_held_out_word_teaches(spark, monkeypatch):
    """No number of buckets bounds how many words teach the threshold."""
    told = []
    monkeypatch.setattr(scanned, "best_threshold", lambda same, other: told.append((Counter(same), Counter(other))) or 0.0)
    n = 10_000
    rows = spark.range(n).selectExpr("explode(array(concat('w', id), concat('w', id, '\\u0001'))) as a", "concat('b', id) as b", "1L as n")
    assert scanned.learned_threshold(rows, rows.groupBy("b").agg(F.sum("n").alias("nb")).withColumn("total", F.lit(2 * n))) == 0.0
    (same, other), = told
    assert sum(same.values()) == n and min(same) > 0.99 and sum(other.values()) == n - 1 and set(other) == {0.0}
    assert best_threshold({0.3: 2, 0.6: 2}, {0.1: 5}) == best_threshold([0.3, 0.3, 0.6, 0.6], [0.1] * 5)


def test_held_out_places_count_in_the_vectors_that_decide(spark):
    ids = spark.range(400).selectExpr("concat('u', id) as id").withColumn("held", F.pmod(F.xxhash64("id"), F.lit(scanned.HELD_OUT)) == 0)
    held, rest = ([r["id"] for r in ids.where(c).collect()] for c in ("held", "not held"))
    rows = [(held[0], ["zeta", "head", "omega"]), (rest[0], ["zeta", "hcad", "omega"])] + [(key, [f"x{k}", "head", f"y{k}"]) for k, key in enumerate(rest[1:21])] + [(rest[21], [f"other{k}" for k in range(300)])]
    parsed = spark.createDataFrame([(key, words, [-1] * len(words)) for key, words in rows], "id string, words array<string>, cut array<int>")
    got = scanned.word_links(parsed, scanned.word_counts(parsed), COSINE).where("rare = 'hcad'").collect()
    assert [r["common"] for r in got] == ["head"]


def test_two_confusions():
    assert "mill" in {x for w in glyph_edits("rni1l") for x in glyph_edits(w)} and set(glyph_edits("rni1l")) & set(glyph_edits("mill", back=True))
