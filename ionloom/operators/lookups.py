"""Finding spectra by index, place, identifier, scan number and time, one by one and in bulk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, scan_number


def by_index(metadata: DataFrame, index: int) -> DataFrame:
    return metadata.filter(F.col("spectrum_index") == index)


def by_ordinal(metadata: DataFrame, ordinal: int, parts: int | None = None) -> DataFrame:
    """The spectrum at a place, from 0, in index order; none if there are fewer.

    Indices are counted by range, cut at approximate quantiles, and only the range that holds the place is sorted.
    """
    parts = parts or int(metadata.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(metadata.stat.approxQuantile("spectrum_index", [k / parts for k in range(1, parts)], min(0.01, 0.1 / parts)))) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("spectrum_index"))) if cuts else F.lit(0)
    for r in metadata.filter("spectrum_index is not null").groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a range
        if 0 <= ordinal < r["count"]:
            return metadata.filter(part == r.part).orderBy("spectrum_index").offset(ordinal).limit(1)
        ordinal -= r["count"]
    return metadata.limit(0)


def index_of_ids(metadata: DataFrame) -> DataFrame:
    """(id, spectrum_index): of spectra with one native identifier, the last."""
    return metadata.filter("id is not null").groupBy("id").agg(F.max("spectrum_index").alias("spectrum_index"))


def index_of_scans(metadata: DataFrame) -> DataFrame:
    """(scan, spectrum_index): of spectra with one scan number, the first."""
    return metadata.withColumn("scan", scan_number("id")).filter("scan is not null").groupBy("scan").agg(F.min("spectrum_index").alias("spectrum_index"))


def nearest_time(metadata: DataFrame, time: float) -> DataFrame:
    """The one row (spectrum_index, rt) nearest in time; the earlier of two as near, then the lower index; none for a time that is no number."""
    off = finite(F.abs(finite("rt") - F.lit(float(time))))
    best = metadata.select(F.struct(off.alias("off"), finite("rt").alias("rt"), F.col("spectrum_index").alias("i")).alias("s")).filter("s.off is not null").agg(F.min("s").alias("s"))
    return best.filter("s is not null").select(F.col("s.i").alias("spectrum_index"), "s.rt")


def nearest_times(metadata: DataFrame, queries: DataFrame, query_id: str = "query_id", time: str = "time", parts: int | None = None) -> DataFrame:
    """(query_id, time, spectrum_index, rt) for each query with a finite time, as nearest_time().

    The time axis is cut at quantiles; within a part the neighbours come from one window over spectra and times, and the
    spectra next to a part's ends from a table of one row a part. So no task holds the whole axis. Each time is looked up once,
    however many queries ask for it, and its answer joined back to them.
    """
    spark = metadata.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = metadata.select(finite("rt").alias("t"), F.col("spectrum_index").alias("i")).filter("t is not null").groupBy("t").agg(F.min("i").alias("i"))
    own_queries = queries.select(F.col(query_id).alias("q"), F.col(time).alias("asked"), finite(time).alias("t")).filter("t is not null")
    asked = own_queries.select("t").distinct()
    cuts = sorted(set(own.stat.approxQuantile("t", [k / parts for k in range(1, parts)], min(0.01, 0.1 / parts)))) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>"), lambda c: c <= F.col("t")))
    hit = F.struct("t", "i")
    rows = own.select(part.alias("part"), "t", hit.alias("s"), F.lit(0).alias("kind"))
    rows = rows.union(asked.select(part.alias("part"), "t", F.lit(None).cast(rows.schema["s"].dataType).alias("s"), F.lit(1).alias("kind")))
    # Both windows grow by a row at a time, one ahead and one back; of equal times spectra come first either way.
    grown = lambda *by: Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.last("s", ignorenulls=True).over(grown("t", "kind"))
    after = F.last("s", ignorenulls=True).over(grown(F.desc("t"), "kind"))
    inside = rows.select("part", "t", "kind", before.alias("below"), after.alias("above")).filter("kind = 1")
    ends = own.select(part.alias("part"), hit.alias("s")).groupBy("part").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    every = spark.range(len(cuts) + 1).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    v = Window.orderBy("part")
    every = every.select("part", F.last("high", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("prev"), F.first("low", ignorenulls=True).over(v.rowsBetween(1, Window.unboundedFollowing)).alias("next"))
    full = inside.join(F.broadcast(every), "part").withColumn("below", F.coalesce("below", "prev")).withColumn("above", F.coalesce("above", "next"))
    later = F.col("below").isNull() | (F.col("above.t") - F.col("t") < F.col("t") - F.col("below.t"))
    best = F.when(later, F.col("above")).otherwise(F.col("below"))
    found = full.select("t", best.alias("s")).filter("s is not null")
    told = own_queries.join(found, "t").select(F.col("q").alias(query_id), F.col("asked").alias(time), "s")
    return told.select(query_id, time, F.col("s.i").alias("spectrum_index"), F.col("s.t").alias("rt"))


def first_spectra(metadata: DataFrame, n: int = 5) -> DataFrame:
    return metadata.orderBy("spectrum_index").limit(n)
