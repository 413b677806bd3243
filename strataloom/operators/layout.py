"""Boxes on pages: lines, overlaps and neighbours, by tiles instead of comparing all boxes of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 120.0


def boxes(df: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """``id, document_id, page, kind, x0, y0, x1, y1`` of units with a page and a box of four numbers."""
    box = F.col("locator.bbox")
    rows = df.where("locator.physical_page is not null and locator.bbox is not null and size(locator.bbox) = 4")
    rows = rows.where(F.col("kind").isin(kinds)) if kinds else rows
    return rows.select("id", "document_id", F.col("locator.physical_page").alias("page"), "kind", *(box[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))


def _tiles(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    steps = lambda lo, hi: F.sequence(F.floor(lo / TILE).cast("int"), F.floor(hi / TILE).cast("int"))
    return F.flatten(F.transform(steps(x0, x1), lambda x: F.transform(steps(y0, y1), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def overlaps(df: DataFrame, least: float) -> DataFrame:
    """``id_a, id_b, share``: boxes of a page whose common area is more than ``least`` of the smaller one.

    Boxes meet in the tile that holds the corner of their common area, so each pair is formed once. Boxes without area
    overlap with none.
    """
    rows = df.where("x1 > x0 and y1 > y0").withColumn("tile", F.explode(_tiles(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))))
    b = rows.select("document_id", "page", "tile", *(F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    pair = rows.join(b, ["document_id", "page", "tile"]).where("id < b_id")
    left, top = F.greatest("x0", "b_x0"), F.greatest("y0", "b_y0")
    corner = (F.floor(left / TILE) == F.col("tile.x")) & (F.floor(top / TILE) == F.col("tile.y"))
    area = F.greatest(F.lit(0.0), F.least("x1", "b_x1") - left) * F.greatest(F.lit(0.0), F.least("y1", "b_y1") - top)
    small = F.least((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), (F.col("b_x1") - F.col("b_x0")) * (F.col("b_y1") - F.col("b_y0")))
    return pair.where(corner).select(F.col("id").alias("id_a"), F.col("b_id").alias("id_b"), (area / small).alias("share")).where(F.col("share") > least)


def lines(df: DataFrame) -> DataFrame:
    """Boxes with ``line``: on each page a new line starts where a box begins below everything above it."""
    w = Window.partitionBy("document_id", "page").orderBy("y0", "y1", "x0", "id")
    above = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", F.when(above.isNull() | (F.col("y0") > above), 1).otherwise(0))
    return rows.withColumn("line", F.sum("_new").over(w)).drop("_new")


def row_groups(cells: DataFrame) -> DataFrame:
    """``table_id, first_row, last_row`` of the rows of tables that spanning cells hold together.

    ``cells`` has ``table_id, row_index, row_span``; spans of null or less count as 1.
    """
    spans = cells.select("table_id", "row_index", (F.col("row_index") + F.greatest(F.coalesce("row_span", F.lit(1)), F.lit(1)) - 1).alias("until")).groupBy("table_id", "row_index").agg(F.max("until").alias("until"))
    w = Window.partitionBy("table_id").orderBy("row_index")
    reach = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(reach.isNull() | (F.col("row_index") > reach), 1).otherwise(0))
    return marked.withColumn("_g", F.sum("_new").over(w)).groupBy("table_id", "_g").agg(F.min("row_index").alias("first_row"), F.max("until").alias("last_row")).drop("_g")


def header_rows(cells: DataFrame) -> DataFrame:
    """``table_id, state, unit_columns`` of tables (``table_id, row_index, column_index, text, column_header``).

    stated: some cell is marked as a column header; inferred: no cell of row 0 is a number, row 0 has every column, and
    some of its cells end in a unit in brackets above at least two rows of numbers only; else unknown.
    """
    number = F.col("text").rlike(r"^\s*[±+\-−]?\s*[0-9]+(?:[.,][0-9]+)?\s*$")
    c = cells.withColumns({"num": F.coalesce(number, F.lit(False)), "unit": F.coalesce(F.col("text").rlike(r"[(（][A-Za-z°℃%/µμ‰]+[)）]\s*$"), F.lit(False))})
    body = F.col("row_index") > 0
    per = c.groupBy("table_id", "column_index").agg(
        F.max(F.when(~body, F.col("num"))).alias("head_num"), F.max(F.when(~body, F.col("unit"))).alias("head_unit"), F.min(F.when(body, F.col("num"))).alias("all_num"),
        F.countDistinct(F.when(body, F.col("row_index"))).alias("rows"), F.max(F.coalesce("column_header", F.lit(False))).alias("marked"),
    )
    good = F.coalesce(F.col("head_unit") & F.col("all_num") & (F.col("rows") >= 2), F.lit(False))
    t = per.groupBy("table_id").agg(F.max("marked").alias("marked"), F.min(F.coalesce(~F.col("head_num"), F.lit(False))).alias("words"), F.sort_array(F.collect_list(F.when(good, F.col("column_index")))).alias("unit_columns"))
    state = F.when(F.col("marked"), "stated").when(F.col("words") & (F.size("unit_columns") > 0), "inferred").otherwise("unknown")
    return t.select("table_id", state.alias("state"), "unit_columns")
