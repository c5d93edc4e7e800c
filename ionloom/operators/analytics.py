"""Extracted-ion chromatograms, run summaries and the target-list range join, all on long tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import Tolerance, activation_methods, finite, is_msn

#: Rows of a target list up to which it is broadcast.
BROADCAST_ROWS = 1_000_000
#: Targets of one list, about.
LISTED = 10_000


def xic(metadata: DataFrame, points: DataFrame, mz: float, tolerance: Tolerance, keep: Column | None = None) -> DataFrame:
    """(spectrum_index, rt, intensity): for each spectrum that is kept, the summed intensity within the tolerance, 0 if nothing is there.

    The window's bounds are literals and go down to the scan; points are summed before they meet the metadata.
    """
    lo, hi = tolerance.limits(mz)
    spectra = metadata if keep is None else metadata.filter(keep)
    sums = points.filter(F.col("mz").between(lo, hi)).groupBy("spectrum_index").agg(F.sum("intensity").alias("found"))
    return spectra.join(sums, "spectrum_index", "left").select("spectrum_index", "rt", F.coalesce("found", F.lit(0.0)).alias("intensity"))


def target_windows(points: DataFrame, targets: DataFrame, tolerance: Tolerance, width: float | None = None) -> DataFrame:
    """points and the distinct target_mz of targets (target_mz) where the point lies within the tolerance of it.

    m/z is cut into buckets; a target stands in every bucket that its window meets, a point in one; an equi-join on buckets and
    the exact window decide. Pairs are as many as matches, and targets of one m/z count once. Buckets are as wide as a window unless a width is given: on the m/z
    axis for absolute tolerances, on its logarithm for relative ones, where all windows are equally wide. So a target stands in
    two buckets, or three where a bound lies on an edge.
    """
    share = tolerance.value / 1e6
    by_log = tolerance.relative and share < 1 and width is None
    if by_log:
        width = max(math.log((1 + share) / (1 - share)), 1e-9)
    elif width is None:
        top = targets.agg(F.max(tolerance.absolute_at("target_mz"))).first()[0] if tolerance.relative else tolerance.value
        width = max(2 * float(top or 0), 1e-6)
    axis = (lambda x: F.coalesce(F.ln(F.abs(x)), F.lit(0.0))) if by_log else (lambda x: x)  # a window has one sign, and nought is alone
    side = (lambda x: F.signum(x)) if by_log else (lambda x: F.lit(0.0))
    bucket = lambda x: F.floor(axis(F.col(x)) / width)
    bounds = tolerance.bounds("target_mz")
    wide = targets.select("target_mz").filter("target_mz is not null").distinct().withColumn("lo", bounds["lo"]).withColumn("hi", bounds["hi"])
    met = F.sequence(F.least(bucket("lo"), bucket("hi")), F.greatest(bucket("lo"), bucket("hi")))
    spread = wide.withColumn("side", side(F.col("target_mz"))).withColumn("bucket", F.explode(met))
    if spread.count() <= BROADCAST_ROWS:
        spread = F.broadcast(spread)
    placed = points.filter("mz is not null").withColumn("side", side(F.col("mz"))).withColumn("bucket", bucket("mz"))
    near = placed.join(spread, ["side", "bucket"]).filter((F.col("mz") >= F.col("lo")) & (F.col("mz") <= F.col("hi")))
    return near.drop("side", "bucket", "lo", "hi")


def with_targets(found: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with a target_mz, each for every target of that m/z, by its other columns.

    The targets of an m/z come as lists of LISTED at most, so that a row meets them, and is repeated, only behind the shuffle.
    """
    rest = [c for c in targets.columns if c != "target_mz"]
    sizes = targets.groupBy("target_mz").agg(F.ceil(F.count("*") / LISTED).alias("parts"))
    part = F.pmod(F.xxhash64(*rest), F.col("parts"))
    listed = targets.join(sizes, "target_mz").groupBy("target_mz", part.alias("part")).agg(F.collect_list(F.struct(*rest)).alias("those")).drop("part")
    listed = F.broadcast(listed) if targets.count() <= BROADCAST_ROWS else listed
    return found.join(listed, "target_mz").withColumn("own", F.explode("those")).select(*found.columns, "own.*")


def target_range_join(points: DataFrame, targets: DataFrame, tolerance: Tolerance, width: float | None = None) -> DataFrame:
    """points and targets (target_id, target_mz) where the point lies within the tolerance of the target: points against the distinct target_mz, and then all targets of those."""
    return with_targets(target_windows(points, targets, tolerance, width), targets)


def target_xic(metadata: DataFrame, points: DataFrame, targets: DataFrame, tolerance: Tolerance) -> DataFrame:
    """(target_id, spectrum_index, rt, intensity) wherever a target has signal.

    Sums are made for each distinct m/z and meet the metadata before the targets of that m/z, so that pairs of targets and
    spectra aren't shuffled; only those of an id that stands on several rows are, to be summed.
    """
    hits = target_windows(points, targets, tolerance).groupBy("target_mz", "spectrum_index").agg(F.sum("intensity").alias("intensity"))
    timed = lambda found: found.join(metadata.select("spectrum_index", "rt"), "spectrum_index")
    known = targets.filter("target_mz is not null").select("target_id", "target_mz")
    rows = known.withColumn("rows", F.count("*").over(Window.partitionBy("target_id")))
    once, often = rows.filter("rows = 1").drop("rows"), rows.filter("rows > 1").drop("rows")
    spread = timed(hits).repartition(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few rows may make many pairs
    out = with_targets(spread, once).select("target_id", "spectrum_index", "rt", "intensity")
    if often.isEmpty():
        return out
    summed = with_targets(hits, often).groupBy("target_id", "spectrum_index").agg(F.sum("intensity").alias("intensity"))
    return out.unionByName(timed(summed).select("target_id", "spectrum_index", "rt", "intensity"))


def count_per_level(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy(F.coalesce("ms_level", F.lit(0)).alias("ms_level")).agg(F.count("*").alias("spectra"))


def ranges(metadata: DataFrame, points: DataFrame) -> DataFrame:
    """Ranges of time, m/z and intensity and the number of points: of each level, and of all (ms_level null)."""
    per = points.groupBy("spectrum_index").agg(
        F.min(finite("mz")).alias("mz_min"), F.max(finite("mz")).alias("mz_max"), F.min(finite("intensity")).alias("i_min"), F.max(finite("intensity")).alias("i_max"), F.count("*").alias("n")
    )
    joined = metadata.select("spectrum_index", F.coalesce("ms_level", F.lit(0)).alias("ms_level"), finite("rt").alias("rt")).join(per, "spectrum_index", "left")
    return joined.rollup("ms_level").agg(
        F.count("spectrum_index").alias("spectra"), F.min("rt").alias("rt_min"), F.max("rt").alias("rt_max"), F.min("mz_min").alias("mz_min"), F.max("mz_max").alias("mz_max"), F.min("i_min").alias("intensity_min"), F.max("i_max").alias("intensity_max"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("points")
    )


def continuity_per_level(metadata: DataFrame, column: str = "continuity") -> DataFrame:
    """(ms_level, continuity): that of all spectra of a level, UNKNOWN if they differ."""
    return metadata.groupBy("ms_level").agg(F.when(F.min(column) == F.max(column), F.min(column)).otherwise("UNKNOWN").alias("continuity"))


def charge_histogram(metadata: DataFrame, charge: Column) -> DataFrame:
    label = F.when(charge.isNull(), "unknown").otherwise(F.concat(F.lit("charge "), charge.cast("string")))
    return metadata.filter(is_msn("ms_level")).groupBy(label.alias("charge")).agg(F.count("*").alias("spectra"))


def activation_histogram(metadata: DataFrame, params: Column) -> DataFrame:
    """(method, spectra): the dissociation methods of the first precursors of MSn spectra."""
    methods = metadata.filter(is_msn("ms_level")).select(F.explode(activation_methods(params)).alias("p"))
    return methods.groupBy(F.coalesce("p.name", "p.accession").alias("method")).agg(F.count("*").alias("spectra"))


def chromatograms_per_type(chromatograms: DataFrame, points: DataFrame, kind: str = "type") -> DataFrame:
    """(type, chromatograms, points)."""
    per = points.groupBy("chromatogram_index").agg(F.count("*").alias("n"))
    return chromatograms.join(per, "chromatogram_index", "left").groupBy(F.coalesce(kind, F.lit("unknown")).alias("type")).agg(F.count("*").alias("chromatograms"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("points"))


def quantiles(values: DataFrame, column: str, at: tuple[float, ...], parts: int | None = None) -> DataFrame:
    """One row, q0, q1 ...: exact quantiles of the finite values, by linear interpolation; null if there are none.

    Values are counted first. The counts are summed by part of the axis (cut at approximate quantiles), and only the parts in
    which a wanted rank lies are sorted, so that no task holds the axis and no rank depends on where the cuts lie.
    """
    parts = parts or int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = values.select(finite(column).alias("v")).filter("v is not null")
    cuts = sorted(set(v.stat.approxQuantile("v", [k / parts for k in range(1, parts)], min(0.01, 0.1 / parts)))) if parts > 1 else []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("v"))) if cuts else F.lit(0)
    counts = v.groupBy("v").agg(F.count("*").alias("n")).withColumn("part", part)
    all_parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a part
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = counts.groupBy("part").agg(F.sum("n").alias("held"))
    held = held.select("part", "held", (F.sum("held").over(so_far) - F.col("held")).alias("before"), F.sum("held").over(all_parts).alias("total"))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("total") - 1) * F.lit(float(q))).alias("at")) for i, q in enumerate(at)])
    wanted = held.select("part", "held", "before", F.explode(asked).alias("w")).select("part", "held", "before", "w.i", "w.at")
    wanted = wanted.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).filter("rank >= before AND rank < before + held")
    few = F.broadcast(wanted.select("part", "before").distinct())  # two parts a quantile at most
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(few, "part").withColumn("upto", F.col("before") + F.sum("n").over(inside)).drop("before")
    found = ranked.join(F.broadcast(wanted.select("part", "i", "at", "rank")), "part").filter("rank >= upto - n AND rank < upto")
    ends = found.groupBy("i", "at").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    each = ends.select("i", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("q"))
    return each.agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(at))])


def five_numbers(values: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """One row: n, mean, min, q1, median, q3, max of the finite values; quartiles exact, by linear interpolation, or approximate."""
    v = finite(column)
    names, at = ("q1", "median", "q3"), (0.25, 0.5, 0.75)
    near = [F.percentile_approx(v, q).alias(x) for q, x in zip(at, names)] if approximate else []
    out = values.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), *near)
    if not approximate:
        exact = quantiles(values, column, at).toDF(*names)
        both = out.unionByName(exact, allowMissingColumns=True)  # two rows, each null where the other is not
        out = both.agg(*[F.max(x).alias(x) for x in both.columns])
    return out.select("n", "mean", "min", *names, "max")


def count_in_box(metadata: DataFrame, points: DataFrame, rt: tuple[float, float], mz: tuple[float, float], levels: list[int] | None = None) -> DataFrame:
    """One row: peaks whose spectrum lies in a time range and m/z in a range, bounds inclusive."""
    spectra = metadata.filter(F.col("rt").between(*rt))
    spectra = spectra.filter(F.col("ms_level").isin(*levels)) if levels else spectra
    return points.filter(F.col("mz").between(*mz)).join(spectra.select("spectrum_index"), "spectrum_index", "left_semi").agg(F.count("*").alias("peaks"))


def closest_points(points: DataFrame, target: float, tolerance: Tolerance) -> DataFrame:
    """(spectrum_index, mz, intensity): of each spectrum the point closest to the target, the lower m/z of two as close."""
    lo, hi = tolerance.limits(target)
    near = points.filter(F.col("mz").between(lo, hi)).groupBy("spectrum_index").agg(F.min(F.struct(F.abs(F.col("mz") - target).alias("off"), "mz", "intensity")).alias("s"))
    return near.select("spectrum_index", "s.mz", "s.intensity")


def duplicate_indices(metadata: DataFrame) -> DataFrame:
    """Indices that several spectra have; none in a sound run."""
    return metadata.groupBy("spectrum_index").agg(F.count("*").alias("n")).filter("n > 1")
