"""References to clauses, sections, tables and figures: reading them and resolving them to the units of a document."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions.text import _NARROW, _WIDE, clause_number
from strataloom.session import durable

REFERENCE = r"([0-9]+(?:[.][0-9]+)+)\s*条"


def clause_references(df: DataFrame, text: str = "text") -> DataFrame:
    """``id, document_id, number`` of every clause number followed by the word for clause; repeats stay."""
    plain = F.translate(F.col(text), _WIDE, _NARROW)
    return df.where(F.col(text).isNotNull()).select("id", "document_id", F.explode(F.regexp_extract_all(plain, F.lit(REFERENCE), F.lit(1))).alias("number"))


def resolve_clauses(references: DataFrame, units: DataFrame) -> DataFrame:
    """``id, number, status, target_id`` of references (``id, document_id, number``) among numbered ``units``.

    resolved: one unit of the document has the number; ambiguous: several; children: none, but units below it; else
    missing. Children are found by every ancestor number of a unit, so the join is on equality.
    """
    wanted = references.distinct()
    have = units.select("document_id", F.col("id").alias("target_id"), clause_number(F.col("text")).alias("number")).where("number is not null")
    own = have.groupBy("document_id", "number").agg(F.count("*").alias("n"), F.min("target_id").alias("target_id"))
    parts = F.split("number", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    kids = have.select("document_id", F.explode(above).alias("number")).groupBy("document_id", "number").agg(F.count("*").alias("kids"))
    df = wanted.join(own, ["document_id", "number"], "left").join(kids, ["document_id", "number"], "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").when(F.col("kids") > 0, "children").otherwise("missing")
    return df.select("id", "number", status.alias("status"), F.when(F.col("n") == 1, F.col("target_id")).alias("target_id"))


_NUMBER = r"(?:(?:[A-Za-z](?:\s*[.．]\s*)?)?\d+(?:\s*[.．]\s*\d+)*|[A-Za-z])"
_TO = rf"(?:\s*(?:条款|条|节)?\s*(?:至|到|～|~|—|–|－|-)\s*第?\s*(?P<end>{_NUMBER}))?"
# Forms of references, the earlier ones first.
_FORMS = (
    ("prefix", re.compile(rf"(?P<label>条款|章节|章|节|表|图|table|figure|fig\.?|clause|section)\s*(?P<number>{_NUMBER}){_TO}(?![\d.．A-Za-z])", re.I)),
    ("suffix", re.compile(rf"(?<![\d.．A-Za-z])(?:第\s*)?(?P<number>{_NUMBER}){_TO}\s*(?P<label>条款|条|章|节|表|图)(?!号)", re.I)),
    ("cue", re.compile(rf"(?:符合|按照?|参照|依据|参见|见)[^\d\n。；]{{0,18}}?(?P<number>\d+(?:\s*[.．]\s*\d+)+){_TO}(?![\d.．A-Za-z%℃])")),
)
_KINDS = {"表": "table", "table": "table", "图": "figure", "figure": "figure", "fig": "figure", "fig.": "figure", "章节": "section", "章": "section", "节": "section", "section": "section"}
_TAIL = re.compile(r"\s*(?:(?:的\s*)?(?:有关|相关)?\s*(?:规定|要求|内容|执行)|[，,。；;、）)\n]|$)")
_STANDARD_CUE = re.compile(r"[A-Z]{1,8}\s*/\s*T?\s*$")
_EXTERNAL = re.compile(r"[A-Z]{1,8}\s*/?\s*T?\s*\d{3,}|《[^》]+》")
_CLAUSE_LINE = re.compile(r"^\s*(\d+(?:[.．]\d+){2,})(?=\s|[一-鿿]|$)")
_SHORT_CLAUSE = re.compile(r"^\s*(\d+[.．]\d+)(?=\s|[一-鿿]|$)")
_HEADING = re.compile(r"^\s*(\d+(?:[.．]\d+)*)(?=\s|[一-鿿]|$)")
_REFERENCE = "id string, document_id string, section string, page int, kind string, number string, end_number string, external boolean, place int"
_ENTRY = "document_id string, kind string, number string, target_id string, section string, page int"


def _plain_number(number: str) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", number)).upper()


def read_references(text: str) -> list[tuple[str, str, str | None, bool, int]]:
    """(kind, number, last number of a range, external, place) of every reference of a text in order of place.

    A later form takes no text that an earlier one has taken. Measurements and numbers of GB/T standards behind a cue word and
    counts (1条管道, 2节短管) are no references; external ones follow the name of another document in their sentence.
    """
    found: list[tuple[int, int, tuple]] = []
    for form, pattern in _FORMS:
        for m in pattern.finditer(text):
            if any(m.start() < b and m.end() > a for a, b, _ in found):
                continue
            label = m.groupdict().get("label") or "条"
            kind, number = _KINDS.get(label.lower(), "clause"), _plain_number(m["number"])
            ahead = _TAIL.match(text, m.end())
            if form == "cue" and (not ahead or _STANDARD_CUE.search(text, m.start(), m.start("number"))):
                continue
            if form == "suffix" and kind in ("clause", "section") and "." not in number and (not m[0].lstrip().startswith("第") or not ahead):
                continue
            start = max(text.rfind(c, 0, m.start()) for c in "。；\n") + 1
            external = bool(_EXTERNAL.search(text, start, m.start()))
            found.append((m.start(), m.end(), (kind, number, _plain_number(m["end"]) if m["end"] else None, external, m.start())))
    return [row for _, _, row in sorted(found)]


def unit_numbers(kind: str | None, text: str) -> set[tuple[str, str]]:
    """(kind, number) of what a unit holds: clauses at the start of its lines, a section heading, or the table or figure that a caption names."""
    if kind == "caption":
        named = [r[:2] for r in read_references(text) if r[0] in ("table", "figure")]
        return {n for n in named if sum(n[0] == o[0] for o in named) == 1}
    if kind in ("cell", "table_note"):
        return set()
    lines = [m for line in text.splitlines() if (m := _CLAUSE_LINE.match(line) or (kind == "clause" and _SHORT_CLAUSE.match(line)))]
    if not lines and kind == "heading" and (m := _HEADING.match(text)):
        return {("section", _plain_number(m[1]))}
    return {("clause", _plain_number(m[1])) for m in lines}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in _REFERENCE.split(", ")]
    for batch in batches:
        rows = [(key, doc, section, page, *r) for key, doc, section, page, text in batch.itertuples(index=False) for r in read_references(text)]
        out = pd.DataFrame(rows, columns=names)
        out["page"] = out["page"].astype("Int64")
        yield out


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in _ENTRY.split(", ")]
    for batch in batches:
        rows = [(doc, *n, key, section, page) for key, doc, section, page, text, kind in batch.itertuples(index=False) for n in sorted(unit_numbers(kind, text))]
        out = pd.DataFrame(rows, columns=names)
        out["page"] = out["page"].astype("Int64")
        yield out


def references(evidence: DataFrame) -> DataFrame:
    """Every reference of ``evidence`` (``id, document_id, text, context``) with the section and page it stands in; repeats stay."""
    df = evidence.where("text rlike '(?i)条|章|节|表|图|符合|按|参照|依据|见|table|fig|clause|section'")
    return df.select("id", "document_id", F.col("context.section").alias("section"), F.col("context.primary_page").alias("page"), "text").mapInPandas(_read, _REFERENCE)


def numbered(source_unit: DataFrame) -> DataFrame:
    """``document_id, kind, number, target_id, section, page`` of every number that a unit of ``source_unit`` holds."""
    df = source_unit.where("text rlike '[0-9０-９]' or kind = 'caption' and text is not null")
    return df.select("id", "document_id", "section", F.col("locator.physical_page").alias("page"), "text", "kind").mapInPandas(_number, _ENTRY).distinct()


def resolve_references(refs: DataFrame, entries: DataFrame) -> DataFrame:
    """``id, kind, number, end_number, status, target_ids`` of the distinct references among the numbered units of their document.

    A clause number that no unit has stands for the clauses below it, else for the section of that number. Of several
    units with a number, those of the section of the reference come first, then those on the nearest page; what is
    not unique then is ambiguous. A range needs both ends. Equal questions are answered once.
    """
    same = ["document_id", "kind", "number", "end_number", "section", "page"]
    refs = durable(refs.drop("place").distinct())
    asks = durable(refs.where("not external").select(*same).distinct().withColumn("ask", F.monotonically_increasing_id()))
    held = entries.groupBy("document_id", "kind", "number", F.col("section").alias("e_section"), F.col("page").alias("e_page")).agg(F.countDistinct("target_id").alias("n"), F.min("target_id").alias("target_id"))
    held = durable(held)
    keep = ["ask", "section", "page", F.col("number").alias("wanted"), "end_number"]
    has = ["found", "e_section", "e_page", "n", "target_id"]
    single = asks.where("end_number is null")
    exact = single.select("document_id", "kind", F.col("number").alias("found"), *keep).join(held.withColumnRenamed("number", "found"), ["document_id", "kind", "found"])
    rest = single.where("kind = 'clause'").join(exact.select("ask").distinct(), "ask", "left_anti")
    parts = F.split("number", r"\.")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".")))
    below = held.where("kind = 'clause'").select("document_id", F.explode(above).alias("wanted"), F.col("number").alias("found"), *has[1:])
    below = rest.select("document_id", *keep).join(below, ["document_id", "wanted"])
    rest = rest.join(below.select("ask").distinct(), "ask", "left_anti")
    titled = rest.select("document_id", *keep).join(held.where("kind = 'section'").select("document_id", F.col("number").alias("wanted"), F.col("number").alias("found"), *has[1:]), ["document_id", "wanted"])
    stem, last = lambda c: F.regexp_extract(c, r"^(.*)\.[^.]*$", 1), lambda c: F.regexp_extract(c, r"(?:^|\.)([0-9]+)$", 1).try_cast("bigint")
    proper = (stem("number") == stem("end_number")) & last("number").isNotNull() & last("end_number").isNotNull()
    spans = asks.where(F.col("end_number").isNotNull() & proper).select("document_id", "kind", stem("number").alias("stem"), last("number").alias("lo"), last("end_number").alias("hi"), *keep)
    within = spans.join(held.select("document_id", "kind", stem("number").alias("stem"), last("number").alias("at"), F.col("number").alias("found"), *has[1:]), ["document_id", "kind", "stem"]).where("at between lo and hi")
    columns = ["ask", "section", "page", "wanted", "end_number", *has]
    w = Window.partitionBy("ask", "found")
    c = exact.select(*columns).union(below.select(*columns)).union(titled.select(*columns)).union(within.select(*columns))
    c = c.withColumn("near", F.coalesce((F.col("section") != "") & (F.col("section") == F.col("e_section")), F.lit(False))).withColumn("best", F.max("near").over(w)).where("near = best")
    c = c.withColumns({"all": F.sum("n").over(w), "far": F.abs(F.col("e_page") - F.col("page"))}).withColumn("least", F.min("far").over(w)).where("all = 1 or least is null or far = least")
    per = c.groupBy("ask", "wanted", "end_number", "found").agg(F.sum("n").alias("n"), F.min("target_id").alias("target_id"))
    per = per.groupBy("ask").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("target_id")).alias("target_ids"), F.max(F.col("found") == F.col("wanted")).alias("first"), F.max(F.coalesce(F.col("found") == F.col("end_number"), F.lit(False))).alias("last"))
    odd = F.col("end_number").isNotNull() & ~proper
    ends = F.col("end_number").isNotNull() & ~F.coalesce(F.col("first") & F.col("last"), F.lit(False))
    status = F.when(odd, "ambiguous_range").when(F.col("n") > 1, "ambiguous").when(ends, "missing_range_endpoint").when(F.col("n") == 1, "resolved").otherwise("missing")
    told = durable(asks.join(per, "ask", "left").select(*same, status.alias("status"), F.when(status == "resolved", F.col("target_ids")).alias("target_ids")))
    on = [refs[k].eqNullSafe(told[k]) for k in same]
    met = refs.where("not external").join(told, [*on]).select(refs["id"], refs["kind"], refs["number"], refs["end_number"], told["status"], told["target_ids"])
    outside = refs.where("external").select("id", "kind", "number", "end_number", F.lit("external_document"), F.lit(None).cast("array<string>"))
    return met.union(outside).distinct()
