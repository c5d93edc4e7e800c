"""Chromatograms over signal tables that grow: a folder of long point files read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import Tolerance

POINTS = "spectrum_index bigint, acquired timestamp, mz double, intensity double"


def point_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Points (spectrum_index, acquired, mz, intensity) of Parquet files as they appear in a folder."""
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_xic(points: DataFrame, mz: float, tolerance: Tolerance, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, intensity, points): summed signal within the tolerance by tumbling window; points later than the watermark are left out."""
    lo, hi = tolerance.limits(mz)
    near = points.withWatermark("acquired", late).filter(F.col("mz").between(lo, hi))
    return near.groupBy(F.window("acquired", every).alias("w")).agg(F.sum("intensity").alias("intensity"), F.count("*").alias("points")).select(F.col("w.start").alias("start"), "intensity", "points")


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to Parquet, once each, until all files there are have been read."""
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
