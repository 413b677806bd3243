"""Names contained in texts, without comparing every name with every text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.operators.skew import salted_join


def _starts(text: str, width: int):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (width - 1)), lambda i: F.substring(F.col(text), i, F.lit(width))))


def contained_names(texts: DataFrame, names: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``key, name`` of every distinct name that occurs in a text; null and empty names and null texts give nothing.

    Places of texts and names meet on up to three first characters and are confirmed; a beginning that many texts hold
    is spread over tasks. Nothing is collected, whatever the number of names.
    """
    names = names.select(name).where(F.length(name) > 0).distinct()
    texts = texts.select(key, text).where(F.col(text).isNotNull())
    found = None
    for width in (1, 2, 3):
        part = names.where(F.length(name) == width if width < 3 else F.length(name) >= 3).withColumn("_k", F.substring(name, 1, width))
        places = texts.where(F.length(text) >= width).select(key, text, F.explode(_starts(text, width)).alias("_k"))
        # Places that no name begins at are left out before the text travels with them.
        near = places.join(part.select("_k").distinct(), "_k", "left_semi")
        hit = salted_join(near, part, ["_k"], F.col(key)).where(F.col(text).contains(F.col(name))).select(key, name)
        found = hit if found is None else found.union(hit)
    return found.distinct()
