"""Chunked signals to points: delta, absolute and Numpress chunks of spectra, delta chunks of chromatograms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs

#: Fixed value: part of the encoding's accession that marks chunks of absolute values.
ABSOLUTE = "1003088"


def start_rule(values: Column, intensity: Column, index: Column) -> Column:
    """Whether a chunk's start is its first point: one more intensity than values says so, as many says not, else it is an error."""
    extra = F.size(intensity) - F.size(values)
    said = F.concat(F.lit("chunk of spectrum "), index.cast("string"), F.lit(" has arrays that don't fit"))
    return F.when(extra == 1, True).when(extra == 0, False).otherwise(F.raise_error(said).cast("boolean"))


def running_sums(start: pa.Array, values: pa.Array) -> pa.Array:
    """For each row the list start, start + v0, start + v0 + v1, ...: summed in that order, a null leaving the sum as it is and itself null."""
    held = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(held + 1)])
    first, flat = ends[:-1], values.flatten()
    steps, known = np.zeros(int(ends[-1])), np.zeros(int(ends[-1]), bool)
    others = np.ones(len(steps), bool)
    others[first] = False
    for at, column in ((first, start), (np.flatnonzero(others), flat)):
        known[at] = column.is_valid().to_numpy(zero_copy_only=False)
        steps[at] = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        np.cumsum(steps[a:b], out=steps[a:b])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(steps, mask=~known))


def _summed(start: str, values: str) -> Column:
    return F.arrow_udf(running_sums, "array<double>")(start, values)


def delta_points(chunks: DataFrame, key: str = "spectrum_index", chunk: str = "chunk_no") -> DataFrame:
    """(key, chunk, pos, mz, intensity) of chunks (key, chunk, mz_chunk_start, mz_chunk_values, chunk_encoding, intensity).

    Delta chunks hold distances from one point to the next, summed from the start on in order; a null leaves a gap and the sum
    as it is. Each chunk decides for itself whether its start is a point. A null intensity is 0. Nothing is shuffled.
    """
    start, values = F.col("mz_chunk_start").cast("double"), F.col("mz_chunk_values").cast("array<double>")
    full = chunks.select(key, chunk, start.alias("s"), values.alias("v"), F.col("intensity").alias("i"), "chunk_encoding", start_rule(F.col("mz_chunk_values"), F.col("intensity"), F.col(key)).alias("starts"))
    absolute = F.coalesce(F.contains("chunk_encoding", F.lit(ABSOLUTE)), F.lit(False))
    told = full.select(key, chunk, "i", "starts", F.when(absolute, F.concat(F.array("s"), F.col("v"))).otherwise(_summed("s", "v")).alias("all"))
    own = F.when(F.col("starts"), F.col("all")).otherwise(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))))
    return told.select(key, chunk, "i", F.posexplode(own).alias("pos", "mz")).select(key, chunk, "pos", "mz", F.coalesce(F.get("i", F.col("pos")).cast("double"), F.lit(0.0)).alias("intensity"))


def chromatogram_points(chunks: DataFrame, key: str = "chromatogram_index", chunk: str = "chunk_no") -> DataFrame:
    """(key, chunk, pos, time, intensity): the start is always a point, a null distance is 0, a missing intensity 0; no start, no points. Nothing is shuffled."""
    distances = F.coalesce(F.transform(F.col("time_chunk_values").cast("array<double>"), lambda v: F.coalesce(v, F.lit(0.0))), F.array().cast("array<double>"))
    rows = chunks.filter("time_chunk_start is not null").select(key, chunk, F.col("intensity").alias("i"), F.col("time_chunk_start").cast("double").alias("s"), distances.alias("v"))
    told = rows.select(key, chunk, "i", _summed("s", "v").alias("all"))
    return told.select(key, chunk, "i", F.posexplode("all").alias("pos", "time")).select(key, chunk, "pos", "time", F.coalesce(F.get("i", F.col("pos")).cast("double"), F.lit(0.0)).alias("intensity"))


def numpress_points(chunks: DataFrame, key: str = "spectrum_index", chunk: str = "chunk_no") -> DataFrame:
    """(key, chunk, pos, mz, intensity) of chunks with mz_numpress_linear_bytes.

    Intensities come from SLOF bytes, else PIC bytes, else the plain list; a chunk without m/z bytes or intensities is
    skipped; lengths that differ are an error. Absent columns count as null.
    """
    have = set(chunks.columns)
    slof = codecs.decoder(codecs.SLOF)("intensity_numpress_slof_bytes") if "intensity_numpress_slof_bytes" in have else F.lit(None)
    pic = codecs.decoder(codecs.PIC)("intensity_numpress_pic_bytes") if "intensity_numpress_pic_bytes" in have else F.lit(None)
    plain = F.col("intensity").cast("array<double>") if "intensity" in have else F.lit(None)
    coded = chunks.filter("mz_numpress_linear_bytes is not null").select(key, chunk, codecs.decoder(codecs.LINEAR)("mz_numpress_linear_bytes").alias("mz"), slof.alias("s"), pic.alias("p"), plain.alias("q"))
    coded = coded.select(key, chunk, "mz", F.coalesce(F.col("s").cast("array<double>"), F.col("p").cast("array<double>"), F.col("q").cast("array<double>")).alias("i")).filter("i is not null")
    fits = F.when(F.size("mz") == F.size("i"), F.arrays_zip("mz", "i")).otherwise(F.raise_error(F.lit("m/z and intensity of a chunk differ in length")))
    return coded.select(key, chunk, F.posexplode(fits).alias("pos", "z")).select(key, chunk, "pos", F.col("z.mz").alias("mz"), F.col("z.i").alias("intensity"))


def numpress_chunks(points: DataFrame, order, intensity: str = "slof", size: int = 500, key: str = "spectrum_index") -> DataFrame:
    """Points to Numpress chunks of so many points each, in order within the spectrum."""
    if intensity not in ("slof", "pic"):
        raise ValueError("intensity is slof or pic")
    placed = points.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    row = F.struct("place", F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("double").alias("intensity"))
    chunks = placed.groupBy(key, F.floor(F.col("place") / size).alias("chunk_no")).agg(F.array_sort(F.collect_list(row)).alias("r"))  # size rows at most
    term = codecs.SLOF if intensity == "slof" else codecs.PIC
    mz, i = F.transform("r", lambda x: x["mz"]), F.transform("r", lambda x: x["intensity"])
    return chunks.select(key, "chunk_no", F.get(mz, 0).alias("mz_chunk_start"), F.element_at(mz, -1).alias("mz_chunk_end"), F.lit(codecs.LINEAR).alias("chunk_encoding"), codecs.encoder(codecs.LINEAR, 100_000.0)(mz).alias("mz_numpress_linear_bytes"), codecs.encoder(term)(i).alias(f"intensity_numpress_{intensity}_bytes"))
