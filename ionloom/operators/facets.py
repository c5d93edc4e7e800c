"""Joins of the metadata facets. Facet rows are not aligned: they belong to a spectrum by source_index and keep their own order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(facet: DataFrame, value: Column, name: str, order: str = "row_no", key: str = "source_index") -> DataFrame:
    """(spectrum_index, name): the facet's values of a spectrum as an array in row order; rows without a key are placeholders."""
    rows = facet.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("spectrum_index"))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))  # a spectrum's own few rows
    return rows.agg(listed.alias("l")).select("spectrum_index", F.transform("l", lambda x: x["v"]).alias(name))


def facet_join(spectra: DataFrame, **facets: DataFrame) -> DataFrame:
    """Spectra with the array of each gathered facet, empty where they have none; facet rows of no spectrum fall away.

    Merged by the key and never broadcast: of a wide member's few columns Spark guesses a small part of the file, however many rows it has.
    """
    out = spectra
    for name, facet in facets.items():
        out = out.join(facet.hint("merge"), "spectrum_index", "left")
        kind = out.schema[name].dataType.simpleString()
        out = out.withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def precursors_with_ions(precursors: DataFrame, ions: DataFrame, no_precursor: Column) -> DataFrame:
    """(spectrum_index, precursors): all ions of a spectrum go to its first precursor; ions alone make a precursor of nulls.

    precursors: (spectrum_index, precursors array); ions: (spectrum_index, ions array, those without m/z dropped, and any
    spectrum with ion rows kept even if none is left).
    """
    both = precursors.join(ions, "spectrum_index", "full_outer")
    kind = ions.schema["ions"].dataType.simpleString()
    none = F.array().cast(kind)
    given = F.transform("precursors", lambda p, i: F.struct(p.alias("precursor"), F.when(i == 0, F.coalesce("ions", none)).otherwise(none).alias("ions")))
    made = F.array(F.struct(no_precursor.alias("precursor"), F.coalesce("ions", none).alias("ions")))
    return both.select("spectrum_index", F.when(F.size("precursors") > 0, given).otherwise(made).alias("precursors"))


def payload(descriptions: DataFrame, profile: DataFrame, centroids: DataFrame) -> DataFrame:
    """Descriptions with mz and intensity: of the profile if there is one, else of the centroids, else empty.

    profile and centroids: (spectrum_index, mz array, intensity array).
    """
    p = profile.select("spectrum_index", F.struct("mz", "intensity").alias("profile"))
    c = centroids.select("spectrum_index", F.struct("mz", "intensity").alias("centroids"))
    empty = F.array().cast("array<double>")
    out = descriptions.join(p, "spectrum_index", "left").join(c, "spectrum_index", "left").withColumn("of", F.coalesce("profile", "centroids"))
    return out.withColumn("mz", F.coalesce("of.mz", empty)).withColumn("intensity", F.coalesce("of.intensity", empty)).drop("of", "profile", "centroids")


def points_to_arrays(points: DataFrame, order, axis: str = "mz", key: str = "spectrum_index") -> DataFrame:
    """(key, axis array, intensity array) in order; a null on the axis stays null, a null intensity is 0."""
    order = [order] if isinstance(order, str) else list(order)
    row = F.struct(*order, F.col(axis).cast("double").alias("axis_value"), F.coalesce(F.col("intensity").cast("double"), F.lit(0.0)).alias("signal"))
    listed = points.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("l"))
    return listed.select(key, F.transform("l", lambda x: x["axis_value"]).alias(axis), F.transform("l", lambda x: x["signal"]).alias("intensity"))


def with_arrays(entities: DataFrame, points: DataFrame, order, axis: str, key: str) -> DataFrame:
    """Chromatograms or other entities with their arrays, empty where there are no points; of duplicates the last row wins."""
    empty = F.array().cast("array<double>")
    out = entities.join(points_to_arrays(points, order, axis, key), key, "left")
    return out.withColumn(axis, F.coalesce(axis, empty)).withColumn("intensity", F.coalesce("intensity", empty))
