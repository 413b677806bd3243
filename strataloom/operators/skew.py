"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], by: Column | None = None, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right`` on the columns ``on``; the rows of a key of ``left`` spread over ``salts`` tasks.

    ``right`` is repeated once per salt, so it is the side with few rows per key. ``by`` spreads the rows of ``left``
    (by default all its columns that can be hashed); ``how`` is inner, left, left_semi or left_anti.
    """
    plain = [F.col(f.name) for f in left.schema if f.dataType.typeName() not in ("map", "variant")]
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*plain) if by is None else F.xxhash64(by), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")
