"""Queries that no SQL restates, over small tables whose results are worked out by hand."""

import datetime

import pytest

from strataloom.plans import survey_queries

LATER = datetime.datetime(2025, 1, 1, tzinfo=datetime.timezone.utc)
AT = datetime.datetime(2024, 3, 1, tzinfo=datetime.timezone.utc)
LOCATOR = "physical_page int, logical_page string, bbox array<double>, char_range array<int>, original_hash string"
UNIT = f"id string, document_id string, revision_id string, kind string, text string, locator struct<{LOCATOR}>, text_origin string, ord int, section string, quality string, attributes string, created_at timestamp, ingested_at timestamp, deleted_at timestamp"
MEMBER = "member_key string, source_id string, ord int, role string, locator struct<physical_page: int, char_range: array<int>>, text_origin string"
EVIDENCE = f"id string, document_id string, revision_id string, kind string, members array<struct<{MEMBER}>>, context struct<primary_page: int, table_id: string, section: string>, text string, logical_key string, created_at timestamp, ingested_at timestamp, deleted_at timestamp"
STATEMENT = "id string, document_id string, type string, text string, entities array<struct<label: string, class: string, role: string, ontology_class_id: string>>, supports array<struct<evidence_id: string, member_keys: array<string>>>, source_anchors array<struct<source_id: string, locator: struct<physical_page: int>>>, logical_key string, created_at timestamp, ingested_at timestamp"


def unit(key, text, kind="paragraph", page=1, ord_=0, doc="d"):
    return key, doc, "r", kind, text, (page, None, None, None, None), "native_text", ord_, "1", "readable", None, AT, AT, None


def evidence(key, text, members, page=1, doc="d"):
    return key, doc, "r", "text", [(f"{key}-{i}", s, i, "content", (page, None), None) for i, s in enumerate(members)], (page, None, "1"), text, None, AT, AT, None


def statement(key, text, cites, members=()):
    return key, "d", "fact", text, [], [(c, list(members)) for c in cites], [], None, AT, AT


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    units = [
        unit("u1", "2.1.1 阀门应检查，", "clause"), unit("u2", "间隙不大于3 mm。", ord_=1), unit("u3", "2.1.2 管路应畅通。", "clause", ord_=2), unit("u4", "2.1.3 水箱应清洁。\n2.1.4 泵应干燥。", "clause", 2),
        unit("u5", "表1 限值", "caption", 2, 1), unit("u6", None, ord_=9), unit("u6", None, ord_=9), unit("u7", "2.1.1 另一本书。", "clause", doc="other"),
    ]
    found = [
        evidence("e1", "2.1.1 阀门应检查， 间隙不大于3 mm。按2.1.2条及表1，见2.1.9条；DL/T 9999的2.1.1条。", ["u1", "u2", None]), evidence("e2", "2.1.2 管路应畅通，见2.1.2条。AB-1的压力0.2 MPa。", ["u3", "gone"]), evidence("e3", None, ["u4"]), evidence("e4", "", ["u5"], 2),
    ]
    said = [
        statement("s1", "AB-1的间隙应不大于0.3厘米，AB-1的压力应小于7 kPa。见2.1.2条。", ["e1", None]), statement("s2", "AB-1的压力200千帕，见2.1.2条和2.1.7条。实测AB-1的压力：200 kPa。", ["e2"]), statement("s3", None, []), statement("s4", "", ["nowhere"]),
        statement("s2", "AB-1的压力200千帕，见2.1.2条和2.1.7条。实测AB-1的压力：200 kPa。", ["e2"]),
    ]
    for name, rows, schema in (("source_unit", units, UNIT), ("evidence", found, EVIDENCE), ("statements", said, STATEMENT)):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    spark.createDataFrame([(1, "# Pump\n\nIt runs.\n\n- a\n- b"), (2, None), (3, "")], "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return path


def rows(spark, path, name):
    got = [tuple(r) for r in survey_queries.QUERIES[name](spark, path).collect()]
    assert len(got) == len(set(map(str, got)))
    return {tuple(map(str, r)) for r in got}


def test_quantities(spark, tables):
    assert rows(spark, tables, "x7_quantities") == {("s1", "length", "厘米", "3000"), ("s1", "pressure", "kPa", "7000"), ("s2", "pressure", "千帕", "200000"), ("s2", "pressure", "kPa", "200000")}
    assert rows(spark, tables, "x10_in_evidence") == {("s1", "length", "3000", "True"), ("s1", "pressure", "7000", "False"), ("s2", "pressure", "200000", "True")}
    assert rows(spark, tables, "f4_missing_parameters") == {("AB-1", "间隙", "1")}


def test_references(spark, tables):
    assert rows(spark, tables, "h1_missing_references") == {("s2", "clause", "2.1.7")}
    states = {(r[0], r[1], r[2]): r[4] for r in rows(spark, tables, "g12_followed_references")}
    assert states == {
        ("e1", "clause", "2.1.2"): "followed", ("e1", "table", "1"): "followed", ("e1", "clause", "2.1.9"): "missing", ("e1", "clause", "2.1.1"): "external_document", ("e2", "clause", "2.1.2"): "self",
    }
    assert rows(spark, tables, "v13_gap_groups") == {("d", "clause", "not there", "1", "1"), ("d", "clause", "another document", "1", "1")}


def test_supported_and_changed_references(spark, tmp_path):
    lost = evidence("e6", "按2.1.3条执行。", [])
    found = [evidence("e5", None, ["r1", "u1"]), lost, (*lost[:6], "按2.1.4条执行。", *lost[7:9], LATER, None), (*evidence("e7", "按2.1.5条执行。", [])[:9], LATER, None)]
    said = [statement("s5", None, ["e5"], ["e5-0", "e5-0", "none"]), statement("s6", None, ["e5"], ["e5-1"])]
    for name, made, schema in (("source_unit", [unit("r1", "应符合2.1.2的规定，见表1。"), unit("u1", "2.1.1 阀门。"), unit("n", None)], UNIT), ("evidence", found, EVIDENCE), ("statements", said, STATEMENT)):
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(spark, str(tmp_path), "h27_supported_references") == {("s5", "clause", "2.1.2", "None"), ("s5", "table", "1", "None")}
    assert rows(spark, str(tmp_path), "h17_changed_references") == {("e6", "clause", "2.1.4", "", "gained"), ("e6", "clause", "2.1.3", "", "lost"), ("e7", "clause", "2.1.5", "", "gained")}


def test_groups_and_places(spark, tables):
    assert rows(spark, tables, "w4_clause_slices") == {("u1", "2.1.1", "0", "12"), ("u3", "2.1.2", "0", "12"), ("u4", "2.1.3", "0", "13"), ("u4", "2.1.4", "13", "24"), ("u7", "2.1.1", "0", "11")}
    groups = rows(spark, tables, "w5_text_groups")
    assert groups == {("d", "u1", "2.1.1", "2", "1", "1"), ("d", "u3", "2.1.2", "1", "1", "1"), ("d", "u4", "2.1.3", "1", "2", "2"), ("d", "u4", "2.1.4", "1", "2", "2"), ("other", "u7", "2.1.1", "1", "1", "1")}
    made = {(r[1], r[2]): r[5] for r in rows(spark, tables, "r9_made_evidence")}
    assert made["u1", "2.1.1"] == "2.1.1 阀门应检查，间隙不大于3 mm。" and made["u4", "2.1.4"] == "2.1.4 泵应干燥。"
    assert rows(spark, tables, "x19_bound_members") == {("e1", "e1-0", "0", "12"), ("e1", "e1-1", "13", "23")}
    assert {r[1:] for r in rows(spark, tables, "r13_clause_limits")} == {("间隙不大于3 mm", "le", "mm", "length", "3000.0", "None")}
    assert {r[0] for r in rows(spark, tables, "s9_text_units")} == {"1"}


def test_empty_tables(spark, tables, tmp_path):
    for name in ("source_unit", "evidence", "statements", "documents"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("w5_text_groups", "w4_clause_slices", "x7_quantities", "x10_in_evidence", "f4_missing_parameters", "h1_missing_references", "h27_supported_references", "h17_changed_references", "g12_followed_references", "v13_gap_groups", "r9_made_evidence", "x19_bound_members", "r13_clause_limits", "r13_checked_facts", "s9_text_units"):
        assert survey_queries.QUERIES[name](spark, str(tmp_path)).count() == 0
