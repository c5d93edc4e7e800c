"""What the corpus operators share: reading tables, cutting lineage, telling texts apart and handling them in small pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import scratch, shared_dir, written

__all__ = ["join_one", "pieces", "scratch", "shared_dir", "small", "table", "text_key", "written"]

#: Bytes of texts that are turned into Python objects at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
#: Rows, or values where a row holds many, up to which a side is broadcast; beyond, both sides are shuffled.
BROADCAST_VALUES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: str = "text") -> Column:
    """128 bits by which texts are told apart, as hexadecimal digits; null for null."""
    return F.md5(F.col(text).cast("string").cast("binary"))


def small(df: DataFrame, values: Column | None = None) -> DataFrame:
    """df, for broadcasting if it is small enough; df must be cheap to read. values: how many a row holds, if not one."""
    n = df.agg(F.coalesce(F.sum(F.lit(1) if values is None else values), F.lit(0))).first()[0]
    return F.broadcast(df) if n <= BROADCAST_VALUES else df


def join_one(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """rows with the columns of ``one``, which has one row a key at most, or nulls; rows must be cheap to read, and may have hot keys.

    A key with more rows than a mean partition holds is hot, so there are fewer hot keys than partitions: what ``one`` has for
    them is broadcast and their rows stay where they are. All others are shuffled by key; rows without a key meet nothing.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    hot = written(counts.filter(F.col("n") > max(rows.count() // parts, 1)).select(key), "hot")
    columns = [*rows.columns, *[c for c in one.columns if c != key]]
    known = F.broadcast(one.join(F.broadcast(hot), key, "left_semi"))
    of_hot = rows.join(F.broadcast(hot), key, "left_semi").join(known, key, "left")
    of_rest = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left_anti").join(one, key, "left")
    keyless = rows.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(one.schema[c].dataType).alias(c) for c in columns[len(rows.columns) :]])
    return of_hot.select(*columns).union(of_rest.select(*columns)).union(keyless.select(*columns))


def pieces(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts (the column of this number) take few bytes, however long the batches are.

    Spark bounds a batch by rows and bytes, but a text as a Python object, and what is made of it, takes far more.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes + 64) // PIECE_BYTES
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        for a, b in zip(starts, [*starts[1:], len(part)]):
            yield batch.slice(int(a), int(b - a))
