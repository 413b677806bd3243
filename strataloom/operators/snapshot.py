"""Snapshots of several tables that appear together or not at all: written beside the present one, then named by one rename."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, root: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")


def current(spark: SparkSession, root: str) -> str | None:
    """Name of the published snapshot below ``root``: the marker of the highest number; None before the first."""
    files, path = _files(spark, root)
    if not files.exists(path("published")):
        return None
    marks = sorted(s.getPath().getName() for s in files.listStatus(path("published")))
    return marks[-1].split("-", 1)[1] if marks else None


def publish(tables: Mapping[str, DataFrame], root: str) -> str:
    """Write all tables as one snapshot below ``root`` and publish it; the name of the snapshot.

    Data go to a folder of their own. Only when all are written does a marker file, renamed into place, name the
    snapshot, so readers see the old one or the new one. A failure removes what was written and leaves the old one.
    Of two writers of the same number, the rename of one fails.
    """
    spark = next(iter(tables.values())).sparkSession
    files, path = _files(spark, root)
    name = uuid.uuid4().hex
    try:
        for table, df in tables.items():
            df.write.parquet(f"{root}/data/{name}/{table}")
        files.mkdirs(path("published"))
        marks = sorted(s.getPath().getName() for s in files.listStatus(path("published")))
        number = int(marks[-1].split("-", 1)[0]) + 1 if marks else 1
        files.create(path(f"data/{name}/marker")).close()
        if any(m.startswith(f"{number:012d}-") for m in marks) or not files.rename(path(f"data/{name}/marker"), path(f"published/{number:012d}-{name}")):
            raise RuntimeError("another snapshot was published meanwhile")
    except BaseException:
        files.delete(path(f"data/{name}"), True)
        raise
    return name


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the published snapshot."""
    name = current(spark, root)
    if name is None:
        raise ValueError("no snapshot is published")
    return spark.read.parquet(f"{root}/data/{name}/{table}")
