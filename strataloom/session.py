"""Session helpers: building a session, reading tables and cutting lineage durably."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; ``conf`` adds or overrides (dots written as double underscores)."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.master(master).appName("strataloom")
    for key, value in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; one is set only where the cluster names none (tests, local use)."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="strataloom-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows go to a table in the shared checkpoint folder and are read from there.

    A lost executor costs no recomputation. Unlike a checkpointed plan, whose size estimate multiplies over rounds of
    joins, the table has its true size, by which the optimizer decides what may be broadcast.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``durable`` that no later plan reads."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            path = _hadoop_path(df.sparkSession, name).getParent()
            if path.getParent().getName().startswith(_PREFIX):
                path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all tables that ``durable`` made in this session; for long sessions, once no result of earlier plans is read any more."""
    path = f"{checkpoint_dir(spark)}/{_PREFIX}{spark.sparkContext.applicationId}"
    _remove(spark, path)


_PREFIX = "strataloom-tables-"


def _hadoop_path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _tables(spark: SparkSession) -> str:
    """Folder of this session's tables; it is deleted when Python ends."""
    path = f"{checkpoint_dir(spark)}/{_PREFIX}{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        atexit.register(_remove, spark, path)
    return path


_made: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = _hadoop_path(spark, path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass
