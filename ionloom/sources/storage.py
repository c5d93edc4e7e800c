"""The folder that all nodes share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Rows that one task sorts, or groups, beyond which more tasks share them.
ROWS_A_TASK = 250_000
#: Paths written inside each scratch() that is open, the innermost last.
_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one where none is set, and only on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ionloom-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def dealt(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """df, of so many rows, by the hash of its keys: in the session's number of partitions, or in more, so that none gets far more than ROWS_A_TASK.

    What a task sorts is then bounded, however large the table; windows, groups and joins by these keys need no other shuffle.
    """
    n = -(-(rows or 0) // ROWS_A_TASK)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


@contextmanager
def own_setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, for the statements inside and not beyond."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors and is computed once.

    The shuffle files of the write are removed as soon as the table stands. Inside a scratch() the table passes with it; with
    ``outer`` it outlives that one, and passes with the one around it, if any.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ionloom-{name}-{uuid.uuid4().hex}"
    with own_setting(spark, _CLEAN, "true"):
        df.write.parquet(path)
    level = 2 if outer else 1
    if len(_passing.get()) >= level:
        _passing.get()[-level].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for those written as ``outer``."""
    token = _passing.set((*_passing.get(), []))
    try:
        yield
    finally:
        paths = _passing.get()[-1]
        _passing.reset(token)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
