import pytest
from pyspark.sql import functions as F

from strataloom.operators.binding import resolved_labels
from strataloom.operators import snapshot
from strataloom.operators.editions import align_editions, signatures
from strataloom.operators.evidence_groups import clause_slices, closed_selection, members_in_order, native_scopes, text_groups
from strataloom.operators.sync import identities, rewritten, sync_actions

UNIT = "id string, document_id string, kind string, text string, page int, ord int, section string"


def groups(spark, rows):
    df = spark.createDataFrame([(key, "d", kind, text, page, ord_, section) for key, text, page, ord_, kind, section in rows], UNIT)
    return [(r["clause"], r["source_ids"], r["pages"]) for r in text_groups(df).orderBy("grp").collect()]


def row(key, text, page=1, ord_=0, kind="paragraph", section="2 Test"):
    return key, text, page, ord_, kind, section


def test_groups_of_clauses_span_pages(spark):
    rows = [row("a", "2.1.1 检查应符合下列规定："), row("b", "1 阀门应灵活。", ord_=1), row("c", "2 管路应畅通。", 2), row("d", "2.1.2 另项要求。", 2, 1)]
    assert groups(spark, rows) == [("2.1.1", ["a", "b", "c"], [1, 2]), ("2.1.2", ["d"], [2])]


def test_headings_and_page_gaps_close_groups(spark):
    rows = [row("a", "2.1.1 规定："), row("h", "2.2 Other", ord_=1, kind="heading"), row("b", "应记录。", ord_=2), row("c", "3 条件", 4)]
    assert [g[1] for g in groups(spark, rows)] == [["a"], ["b"], ["c"]]


def test_fragments_are_no_members(spark):
    rows = [row("n", "2.1.1"), row("a", "应接地。", ord_=1), row("m", "；", ord_=2), row("b", "2.1.2 应清洁。", ord_=3)]
    assert groups(spark, rows) == [("2.1.1", ["a"], [1]), ("2.1.2", ["b"], [1])]
    assert groups(spark, [row("x", "14"), row("y", "；", ord_=1), row("z", None, ord_=2), row("e", "", ord_=3)]) == []


def test_clauses_within_a_block(spark):
    text = "3 温度应低于1000℃。\n7.2.4 基础检查应符合下列规定："
    slices = clause_slices(text)
    assert [s[0] for s in slices] == [None, "7.2.4"] and "".join(text[a:b] for _, a, b in slices) == text
    assert clause_slices("") == [] and clause_slices("无条款")[0][0] is None
    rows = [row("p", "7.2.3 校正应符合下列规定："), row("a", text, ord_=1), row("b", "1 基础应合格。", ord_=2)]
    assert groups(spark, rows) == [("7.2.3", ["p", "a"], [1]), ("7.2.4", ["a", "b"], [1])]


def closed(spark, members, selected):
    m = spark.createDataFrame([("e", key, i, role, text) for i, (key, role, text) in enumerate(members)], "evidence_id string, member_key string, ord int, role string, text string")
    s = spark.createDataFrame([("s", "e", key) for key in selected], "sel_id string, evidence_id string, member_key string")
    return sorted(r["member_key"] for r in closed_selection(s, m).collect())


def test_selections_are_completed(spark):
    c = "content"
    split = [("lead", "section", "检查应符合下列规定："), ("first", c, "应检查管"), ("second", c, "板和隔板中心应复查合格；"), ("third", c, "另一要求应检查。")]
    assert closed(spark, split, ["lead", "second"]) == ["first", "lead", "second"]
    assert closed(spark, [("first", c, "端面应平整。"), ("second", c, "螺栓应紧固。")], ["second"]) == ["second"]
    assert closed(spark, [("lead", "section", "应提交下列施工记录："), ("first", c, "1 凝汽器基础检查记录；"), ("second", c, "2 支持弹簧安装记录。")], ["second"]) == ["lead", "second"]
    assert closed(spark, [("first", c, "试验压力不得小于工作"), ("on", c, "压力的1.25倍；"), ("sibling", c, "2 保压时间为10 min。")], ["on"]) == ["first", "on"]
    assert closed(spark, [("prefix", c, "间隙应为"), ("decimal", c, "0.20mm。")], ["decimal"]) == ["decimal", "prefix"]
    assert closed(spark, [("first", c, "1) 第一项尚未结束"), ("second", c, "2) 第二项。")], ["second"]) == ["second"]
    assert closed(spark, [("first", c, "1. 间隙不得大于0.20mm。"), ("second", c, "2. 试验压力不得低于1.25倍。")], ["second"]) == ["second"]
    assert closed(spark, [("first", c, None), ("second", c, "")], ["second", "gone"]) == ["second"]


def test_lead_ins_are_followed_to_the_first_one(spark):
    """A lead-in that ends the run of an item has that item's parents above it, any number of times; no round limits it."""
    chain = [x for i in range(12) for x in ((f"item{i:02}", "content", f"{i + 1} 第项应清洁"), (f"lead{i:02}", "content", "应符合下列规定："))]
    assert closed(spark, chain, ["lead11"]) == sorted(key for key, _, _ in chain) and closed(spark, chain, ["item01"]) == ["item00", "item01", "lead00", "lead01"]


def test_selections_plan_no_round_within_a_round(spark):
    m = spark.createDataFrame([("e", "a", 0, "content", "1 甲。")], "evidence_id string, member_key string, ord int, role string, text string")
    s = spark.createDataFrame([("s", "e", "a")], "sel_id string, evidence_id string, member_key string")
    plan = closed_selection(s, m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") <= 5


def test_odd_member_keys(spark):
    """A key in two runs leads to both; null places and keys stand last, as in SQL."""
    m = spark.createDataFrame([("e", "a", 0, "content", "甲。"), ("e", "x", 1, "content", "乙。"), ("e", "a", 2, "content", "丙"), ("e", "b", 3, "content", "丁。"), ("e", None, 4, "content", "戊。"), ("e", "c", None, "content", "己。")], "evidence_id string, member_key string, ord int, role string, text string")
    s = spark.createDataFrame([("s", "e", "b"), ("n", "e", None), ("n", "f", None)], "sel_id string, evidence_id string, member_key string")
    assert {tuple(r) for r in closed_selection(s, m).collect()} == {("s", "e", "a"), ("s", "e", "b"), ("n", "e", None)}
    assert [r["member_key"] for r in members_in_order(m).orderBy("run").collect()] == ["a", "x", "a", "b", None, "c"]


def test_list_parents(spark):
    texts = ["应符合下列规定：", "1 甲应清洁：", "1) 乙应干燥；", "(1) 丙；", "2) 丁；", "2 戊。", "己。"]
    df = spark.createDataFrame([("e", f"m{i}", i, "content", t) for i, t in enumerate(texts)], "evidence_id string, member_key string, ord int, role string, text string")
    got = {r["member_key"]: r["parent_key"] for r in members_in_order(df).collect()}
    assert got == {"m0": None, "m1": "m0", "m2": "m1", "m3": "m2", "m4": "m1", "m5": "m0", "m6": None}


def test_sync_keeps_identities(spark):
    schema = "id string, logical_key string, text string"
    stored = spark.createDataFrame([("old", "k1", "a"), ("retired", "k2", "b"), ("same", "k3", "c"), ("x", "k4", "d"), ("y", "k4", "d")], schema)
    incoming = spark.createDataFrame([("new", "k1", "a"), ("same", "k3", "changed"), ("z", "k4", "d"), ("fresh", None, "e"), (None, "k9", "f"), ("same", "k3", "changed")], schema)
    got = {(r["id"], r["incoming_id"]): r["action"] for r in sync_actions(stored, incoming, F.col("text")).collect()}
    assert got == {("old", "new"): "unchanged", ("retired", None): "deleted", ("same", "same"): "updated", ("x", None): "deleted", ("y", None): "deleted", ("z", "z"): "created", ("fresh", "fresh"): "created"}
    refs = spark.createDataFrame([("s", "new"), ("s", "same"), ("t", None)], "statement string, evidence_id string")
    assert {tuple(r) for r in rewritten(refs, identities(stored, incoming), "evidence_id").select("statement", "evidence_id").collect()} == {("s", "old"), ("s", "same"), ("t", None)}
    assert {r["action"] for r in sync_actions(stored, stored, F.col("text")).collect()} == {"unchanged"}
    assert sync_actions(stored.limit(0), stored.limit(0), F.col("text")).count() == 0


def test_labels_by_suffix(spark):
    names = [("Heater", "加热器"), ("LowPressureHeater", "低压加热器"), ("Tank", "水箱"), ("Pump", "泵"), ("Check", "检查"), ("Check2", "检查"), (None, "无")]
    above = spark.createDataFrame([("LowPressureHeater", "Heater")], "node string, anc string")
    run = lambda labels, extra=(): {r["label"]: (r["class_id"], r["method"]) for r in resolved_labels(spark.createDataFrame([(x,) for x in labels], "label string"), spark.createDataFrame([*names, *extra], "class_id string, name string"), above).collect()}
    got = run(["待安装的低压加热器", "低压加热器外壁", "加热器", "水箱加热器", "全部检查", "大泵", " 水 箱", None, ""])
    assert got == {"待安装的低压加热器": ("LowPressureHeater", "suffix"), "低压加热器外壁": (None, None), "加热器": ("Heater", "exact"), "水箱加热器": ("Heater", "qualified"), "全部检查": (None, None), "大泵": (None, None), " 水 箱": ("Tank", "exact")}
    assert run(["待安装的低压加热器"], [("Tank", "压加热器")]) == {"待安装的低压加热器": (None, None)}


def test_native_scopes(spark):
    rows = [("e", "h1", 0, "section", "heading", "第2章 安装"), ("e", "h2", 1, "section", "heading", "2.1 范围"), ("e", "a", 2, "content", "clause", "2.1.1 本节仅适用于凝汽器。"), ("e", "b", 3, "content", "paragraph", "本 章适用于水箱。"), ("e", "c", 4, "content", "paragraph", "本标准适用于泵。"), ("e", "d", 5, "content", "paragraph", "不适用于泵。"), ("f", "a", 0, "content", "paragraph", "本章适用于水箱。"), ("f", "n", 1, "content", "paragraph", None)]
    df = spark.createDataFrame(rows, "evidence_id string, member_key string, ord int, role string, kind string, text string")
    assert {tuple(r) for r in native_scopes(df).collect()} == {("e", "a", "section", "h2"), ("e", "b", "section", "h1"), ("e", "c", "document", None)}


def test_snapshots_appear_at_once(spark, tmp_path):
    root = f"file:{tmp_path}/s"
    assert snapshot.current(spark, root) is None
    with pytest.raises(ValueError):
        snapshot.read(spark, root, "t")
    one = snapshot.publish({"t": spark.range(3), "u": spark.range(1)}, root)
    assert snapshot.current(spark, root) == one and snapshot.read(spark, root, "t").count() == 3
    with pytest.raises(Exception):
        snapshot.publish({"t": spark.range(9), "u": spark.range(4).selectExpr("raise_error('broken') as x")}, root)
    assert snapshot.current(spark, root) == one and snapshot.read(spark, root, "t").count() == 3 and len(list((tmp_path / "s" / "data").iterdir())) == 1
    two = snapshot.publish({"t": spark.range(5)}, root)
    assert snapshot.current(spark, root) == two and snapshot.read(spark, root, "t").count() == 5


MEMBERS = "array<struct<source_id: string, ord: int, role: string>>"


def align(spark, old, new):
    def signed(rows):
        evidence = spark.createDataFrame([(key, "text", (section, None), [(f"{key}-{i}", i, "content") for i in range(len(texts))] + [(f"{key}-h", 9, "section")]) for key, section, texts in rows], f"id string, kind string, context struct<section: string, table_id: string>, members {MEMBERS}")
        units = spark.createDataFrame([(f"{key}-{i}", t) for key, _, texts in rows for i, t in enumerate(texts) if t != "gone"], "id string, text string")
        return signatures(evidence, units)

    return tuple({tuple(r) for r in part.collect()} for part in align_editions(signed(old), signed(new)))


def test_editions(spark):
    old = [("a", "2.1", ["甲应接地。", "乙。"]), ("b", "2.2", ["丙应清洁。"])]
    assert align(spark, old, [("x", "2.1", ["甲应 接地。", "乙。"]), ("y", "2.2", ["丙应清洁。"])]) == ({("a", "x"), ("b", "y")}, {("a-0", "x-0"), ("a-1", "x-1"), ("b-0", "y-0")})
    assert align(spark, old, [("x", "2.1", ["甲应接地。", "乙。"]), ("y", "2.2", ["丙应干燥。"])])[0] == {("a", "x")}
    # Repeated clauses without a place of their own, another division into members, and a missing unit align with none.
    assert align(spark, [("a", "2.1", ["甲。"]), ("b", "2.1", ["甲。"])], [("x", "2.1", ["甲。"])])[0] == set()
    assert align(spark, [("a", "2.1", ["甲应接地。", "乙。"])], [("x", "2.1", ["甲应接地。乙。"])]) == (set(), set())
    assert align(spark, [("a", "2.1", ["甲。", "gone"])], [("x", "2.1", ["甲。", "gone"])])[0] == set()
    assert align(spark, [("r1", "T1", ["1", "2"]), ("r2", "T1", ["3", "4"])], [("s1", "T1", ["1", "2"]), ("s2", "T1", ["3", "5"])])[0] == {("r1", "s1")}
