import hashlib

import pytest
from pyspark.sql import functions as F

from strataloom.operators.assembly import aligned, assembled, compared
from strataloom.operators.layout import header_rows, lines, overlaps, row_groups
from strataloom.operators.references import clause_references, resolve_clauses
from strataloom.sources.markdown import note_rows, parse, parse_documents, pipe_cells
from strataloom.sources.tabular import check_allowlist, file_table, read_table, unique_match

TEXT = """# Title #
Intro line
goes on ![pump](img/p.png) and ![x][Ref].

Sub
---
- one
  more
  - two
1. three

| a | b `|` c |
|---|:-:|
| 1[^n] | x \\| y |
| 2 | z |

[^n]: only cold
[ref]: other.png "t"
```py
# no heading
```
$$
E = mc^2
$$
"""


def test_markdown():
    units = parse(TEXT)
    kinds = [u[0] for u in units]
    assert kinds == ["heading", "paragraph", "heading", "list_item", "list_item", "list_item", "cell", "cell", "cell", "cell", "cell", "cell", "table_note", "code", "formula", "picture", "picture"]
    assert units[0][1:5] == ("Title", 1, 1, 1) and units[2][1:5] == ("Sub", 2, 5, 6)
    assert units[3][1] == "one\nmore" and units[4][2] == 2
    assert [u[1] for u in units if u[0] == "cell"] == ["a", "b `|` c", "1[^n]", "x \\| y", "2", "z"]
    assert units[13][1] == "# no heading" and units[14][1] == "E = mc^2"
    assert [u[8] for u in units if u[0] == "picture"] == ["img/p.png", "other.png"]
    assert parse("") == [] and parse("\n\n") == []


def test_pipe_cells():
    assert pipe_cells("| a | `x|y` | b\\|c |") == [("a", 2), ("`x|y`", 6), ("b\\|c", 14)]


def test_markdown_tables(spark):
    df = spark.createDataFrame([("d", TEXT, 1), ("n", None, 2), ("e", "", 3)], "document_id string, text string, ord int")
    units = parse_documents(df)
    assert units.where("document_id <> 'd'").count() == 0 and units.count() == 17
    assert [tuple(r) for r in note_rows(units).collect()] == [("d", "n", 1, [1])]


def test_allowlist(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    rows = [(good, "3", "a.txt"), ("xyz", "3", "b.txt"), (good, "9", "../c"), (good, "3", "/d"), (good, "3", "none.txt"), (good, "3", "none.txt"), (None, None, None)]
    listing = tmp_path / "list.tsv"
    listing.write_text("# version=7\n# note\n\nsha256\tsize_bytes\tpath\n" + "\n".join("\t".join(map(str, r)) for r in rows[:3]) + "\n")
    meta, read = read_table(spark, str(listing))
    assert meta == {"version": "7"} and read.count() == 3 and read.columns == ["sha256", "size_bytes", "path"]
    files = file_table(spark, str(tmp_path / "in"))
    assert [tuple(r) for r in files.collect()] == [("a.txt", good, 3)]
    table = spark.createDataFrame(rows, "sha256 string, size_bytes string, path string")
    got = sorted((r["path"] or "", r["fault"]) for r in check_allowlist(table, files, 7).collect())
    assert got == [("", "path empty"), ("../c", "path escapes"), ("/d", "path absolute"), ("b.txt", "malformed hash"), ("none.txt", "listed twice"), ("none.txt", "missing file")]
    assert [r["fault"] for r in check_allowlist(table.limit(0), files, 1).collect()] == ["entries: 0"]


def test_unique_match(spark):
    catalogue = spark.createDataFrame([("p", "1"), ("p", "1"), ("q", "1"), ("q", "2"), (None, "3")], "path string, doc string")
    keys = spark.createDataFrame([("p",), ("q",), ("r",), ("r",)], "path string")
    assert sorted(tuple(r) for r in unique_match(keys, catalogue, "path", "doc").collect()) == [("p", "1", "found"), ("q", None, "ambiguous"), ("r", None, "missing")]


def test_row_groups_and_headers(spark):
    spans = spark.createDataFrame([("t", 0, 1), ("t", 1, 2), ("t", 2, 1), ("t", 3, None), ("u", 0, 3), ("u", 1, 1), ("u", 2, 1)], "table_id string, row_index int, row_span int")
    assert sorted(tuple(r) for r in row_groups(spans).collect()) == [("t", 0, 0), ("t", 1, 2), ("t", 3, 3), ("u", 0, 2)]
    cells = [("t", r, c, x, False) for r, row in enumerate([["Part", "Tolerance (mm)"], ["a", "±3"], ["b", "5"]]) for c, x in enumerate(row)]
    cells += [("n", r, 0, x, None) for r, x in enumerate(["1", "2"])] + [("s", 0, 0, "x", True), ("s", 1, 0, None, False)]
    got = {r["table_id"]: (r["state"], r["unit_columns"]) for r in header_rows(spark.createDataFrame(cells, "table_id string, row_index int, column_index int, text string, column_header boolean")).collect()}
    assert got == {"t": ("inferred", [1]), "n": ("unknown", []), "s": ("stated", [])}


def test_overlaps_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = []
    for i in range(60):
        x, y = rng.uniform(-50, 600), rng.uniform(0, 800)
        rows.append((f"b{i:02}", "d", i % 2, x, y, x + rng.choice([0, 30, 250]), y + rng.uniform(1, 200)))
    df = spark.createDataFrame(rows, "id string, document_id string, page int, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[2] == b[2] and a[5] > a[3] and b[5] > b[3]:
                area = max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
                if area / min((a[5] - a[3]) * (a[6] - a[4]), (b[5] - b[3]) * (b[6] - b[4])) > 0.3:
                    want.add((a[0], b[0]))
    got = [(r["id_a"], r["id_b"]) for r in overlaps(df, 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert lines(df).groupBy("page").agg(F.max("line")).count() == 2


def test_assembly_alignment_comparison(spark):
    members = "array<struct<ord:int,source_id:string,role:string>>"
    ev = spark.createDataFrame([("e", [(1, "b", "content"), (0, "a", "content"), (2, "c", "content"), (3, "h", "section"), (4, "gone", "content")]), ("f", []), ("g", None)], f"id string, members {members}")
    units = spark.createDataFrame([("a", "p", "The gap"), ("b", "p", "is 3 mm。"), ("c", "p", "（1）甲"), ("h", "heading", "H")], "id string, kind string, text string")
    got = {r["id"]: (r["text"], r["members"], r["absent"]) for r in assembled(ev, units).collect()}
    assert got == {"e": ("The gap is 3 mm。\n（1）甲", 5, 1)}
    old = spark.createDataFrame([("o1", "k"), ("o2", "m"), ("o3", "m"), ("o4", None)], "id string, k string")
    new = spark.createDataFrame([("n1", "k"), ("n1", "k"), ("n2", "m"), ("n4", None)], "id string, k string")
    assert [tuple(r) for r in aligned(old, new, ["k"]).collect()] == [("o1", "n1")]
    limits = spark.createDataFrame([("a", "le", 3.0, "length"), ("b", "lt", 3.0, "length"), ("c", "le", 1.0, "time"), ("d", "le", 1.0, "length"), ("e", None, 1.0, "length")], "p string, op string, value double, dimension string")
    facts = spark.createDataFrame([("a", 3.0, "length"), ("b", 3.0, "length"), ("c", 1.0, "length"), ("d", 1.0, "length"), ("d", 2.0, "length"), ("e", 1.0, "length")], "p string, value double, dimension string")
    assert {r["p"]: r["status"] for r in compared(limits, facts, ["p"]).collect()} == {"a": "satisfied", "b": "not_satisfied", "c": "unknown", "d": "unknown", "e": "unknown"}


def test_references(spark):
    ev = spark.createDataFrame([("e", "d", "按2.1.1条及２．２条，另见3.1条、9.9条。"), ("n", "d", None)], "id string, document_id string, text string")
    units = spark.createDataFrame([("a", "d", "2.1.1 甲"), ("b", "d", "2.2.1 乙"), ("c", "d", "3.1 丙"), ("c2", "d", "3.1 丁"), ("x", "other", "9.9 戊")], "id string, document_id string, text string")
    got = {r["number"]: (r["status"], r["target_id"]) for r in resolve_clauses(clause_references(ev), units).collect()}
    assert got == {"2.1.1": ("resolved", "a"), "2.2": ("children", None), "3.1": ("ambiguous", None), "9.9": ("missing", None)}
