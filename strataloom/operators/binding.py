"""Classes of labels: exact names, object and kind compounds, and the most specific name a label ends with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.functions.text import normalized


def _specific(hits: DataFrame, above: DataFrame) -> DataFrame:
    """``form, class_id`` of the only class of a form once classes above another of its classes are left out."""
    hits = hits.distinct()
    lower = hits.join(hits.withColumnRenamed("class_id", "other"), "form").where("class_id <> other")
    beaten = lower.join(above.select(F.col("node").alias("other"), F.col("anc").alias("class_id")), ["other", "class_id"], "left_semi").select("form", "class_id").distinct()
    left = hits.join(beaten, ["form", "class_id"], "left_anti")
    return left.groupBy("form").agg(F.count("*").alias("n"), F.min("class_id").alias("class_id")).where("n = 1").drop("n")


def resolved_labels(labels: DataFrame, names: DataFrame, above: DataFrame) -> DataFrame:
    """``label, class_id, method`` of labels (``label``) among class names (``class_id, name``); null where not unique.

    exact: the label is a name of one class. qualified: it is a name followed by the name of a kind. suffix: it ends with
    a name of two characters or more. Of several classes those above another one (``above``: ``node, anc``) are left
    out, and what is not unique then stays unresolved. A label meets names by its own suffixes, so no pair of all labels
    and names is formed; the number of suffixes is the length of the label.
    """
    said = labels.where("label is not null").select("label", normalized(F.col("label")).alias("form")).where("length(form) > 0").distinct()
    known = names.where("name is not null and class_id is not null").select("class_id", normalized(F.col("name")).alias("form")).where("length(form) > 0").distinct()
    forms = said.select("form").distinct()
    exact = forms.join(known, "form").groupBy("form").agg(F.countDistinct("class_id").alias("n"), F.min("class_id").alias("class_id"))
    rest = forms.join(exact.select("form"), "form", "left_anti")
    cut = rest.select("form", F.explode(F.expr("transform(sequence(2, greatest(2, length(form))), i -> struct(substring(form, i) as tail, substring(form, 1, i - 1) as head))")).alias("s")).select("form", "s.tail", "s.head")
    hits = cut.where("length(tail) > 0").join(known.select(F.col("form").alias("tail"), "class_id"), "tail")
    one = known.groupBy("form").agg(F.countDistinct("class_id").alias("n")).where("n = 1").select(F.col("form").alias("head"))
    qualified = _specific(hits.join(one, "head", "left_semi").select("form", "class_id"), above)
    suffix = _specific(hits.where("length(tail) >= 2").select("form", "class_id"), above)
    found = exact.select("form", F.when(F.col("n") == 1, F.col("class_id")).alias("class_id"), F.lit("exact").alias("method"))
    found = found.union(qualified.select("form", "class_id", F.lit("qualified")))
    found = found.union(suffix.join(qualified.select("form"), "form", "left_anti").select("form", "class_id", F.lit("suffix")))
    df = said.join(found, "form", "left")
    return df.select("label", "class_id", F.when(F.col("class_id").isNotNull(), F.col("method")).alias("method"))
