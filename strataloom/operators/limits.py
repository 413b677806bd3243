"""Limits and measured values of texts as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from strataloom.functions.limits import read_limits

_READ = "id string, op string, value double, unit string, dimension string, common double, tag string, parameter string"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [part.split()[0] for part in _READ.split(", ")]
    for batch in batches:
        rows = [(key, *x) for key, text in zip(batch["id"], batch["text"], strict=True) for found in read_limits(text) for x in found]
        yield pd.DataFrame(rows, columns=names)


def limits_and_facts(df: DataFrame) -> DataFrame:
    """``id, op, value, unit, dimension, common, tag, parameter`` of every limit of ``df`` (``id, text``) and, with null ``op``, of every measured value.

    ``common`` is the value in the common unit of the dimension; both are null for a unit that the table does not have.
    """
    return df.select("id", "text").where("text is not null").mapInPandas(_read, _READ)
