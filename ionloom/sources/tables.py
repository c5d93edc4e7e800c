"""The members of a run as plain tables with BIGINT keys, whatever physical types and layouts they have.

Every field is optional and found by name; floats, doubles and integers stand for each other; NaN becomes NULL. The order of a
file's rows is kept in row_no, which the signal files need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import chunks, facets
from .storage import dealt

# The format's column names.
LEVEL, POLARITY, REPRESENTATION = "MS_1000511_ms_level", "MS_1000465_scan_polarity", "MS_1000525_spectrum_representation"
N_POINTS, N_PEAKS = "MS_1003060_number_of_data_points", "MS_1003059_number_of_peaks"
START_TIME, INJECTION = "MS_1000016_scan_start_time_unit_UO_0000031", "MS_1000927_ion_injection_time_unit_UO_0000028"
FILTER, PRESET = "MS_1000512_filter_string", "MS_1000616_preset_scan_configuration"
WINDOW_LOW, WINDOW_HIGH = "MS_1000501_scan_window_lower_limit_unit_MS_1000040", "MS_1000500_scan_window_upper_limit_unit_MS_1000040"
ISOLATION = ("MS_1000827_isolation_window_target_mz", "MS_1000828_isolation_window_lower_offset", "MS_1000829_isolation_window_upper_offset")
ION_MZ, ION_CHARGE, ION_INTENSITY = "MS_1000744_selected_ion_mz_unit_MS_1000040", "MS_1000041_charge_state", "MS_1000042_intensity_unit_MS_1000131"
MOBILITY, MOBILITY_TYPE, X, Y = "ion_mobility_value", "ion_mobility_type", "IMS_1000050_position_x", "IMS_1000051_position_y"
CHROMATOGRAM_TYPE, LAMBDA_MAX = "MS_1000626_chromatogram_type", "MS_1003812_lambda_max_unit_UO:0000018"
#: The types of a description's scans and precursors.
SCANS = f"array<struct<start_time: double, injection_time: double, filter_string: string, preset_scan_configuration: int, instrument_configuration_ref: int, spectrum_reference: string, windows: array<struct<lower: double, upper: double>>, params: array<{C.PARAM}>>>"
PRECURSORS = f"array<struct<precursor: struct<precursor_index: bigint, precursor_id: string, isolation_window: struct<target_mz: double, lower_offset: double, upper_offset: double>, activation: array<{C.PARAM}>>, ions: array<struct<mz: double, charge: int, intensity: double, params: array<{C.PARAM}>>>>>"
#: Keys are unsigned in the format; one above this has its high bit set.
TOP_KEY = 2**63 - 1


def read(spark: SparkSession, path: str) -> DataFrame:
    """A member with row_no, the place of a row: (file, row). Part files of one member are read in the order of their names."""
    df = spark.read.parquet(path)
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("row_no"))


def find(df: DataFrame, path: str) -> T.DataType | None:
    """The type of a nested field, or None if there is no such field."""
    at: T.DataType = df.schema
    for name in path.split("."):
        if not isinstance(at, T.StructType) or name not in at.fieldNames():
            return None
        at = at[name].dataType
    return at


def quoted(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def optional(df: DataFrame, path: str, kind: str) -> Column:
    """A field cast to the kind, NULL where it is absent; numbers that aren't finite are NULL."""
    have = find(df, path)
    if have is None:
        return F.lit(None).cast(kind)
    c = quoted(path)
    if isinstance(have, (T.FloatType, T.DoubleType)):
        c = C.finite(c)
    return c.try_cast(kind) if kind in ("int", "bigint") else c.cast(kind)


def key(df: DataFrame, path: str) -> Column:
    """An unsigned key as BIGINT; one that doesn't fit, or is negative, is an error."""
    if find(df, path) is None:
        return F.lit(None).cast("bigint")
    c = quoted(path).cast("decimal(20,0)")
    return F.when(c.isNull() | ((c >= 0) & (c <= F.lit(str(TOP_KEY)).cast("decimal(20,0)"))), c.cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"{path} is out of range: "), c.cast("string"))).cast("bigint"))


def params(df: DataFrame, path: str) -> Column:
    """A list of parameters in one shape, elements that are null left out; empty where the field is absent."""
    have = find(df, path)
    if not isinstance(have, T.ArrayType) or not isinstance(have.elementType, T.StructType):
        return F.array().cast(f"array<{C.PARAM}>")
    inner = have.elementType
    arms = inner["value"].dataType if "value" in inner.fieldNames() and isinstance(inner["value"].dataType, T.StructType) else T.StructType()

    def shaped(p: Column) -> Column:
        text = lambda name: (p[name] if name in inner.fieldNames() else F.lit(None)).cast("string").alias(name)
        arm = lambda name, kind: (p["value"][name] if name in arms.fieldNames() else F.lit(None)).cast(kind).alias(name)
        value = F.struct(arm("integer", "bigint"), arm("float", "double"), arm("string", "string"), arm("boolean", "boolean"))
        return F.struct(text("name"), text("accession"), value.alias("value"), text("unit"))

    return F.coalesce(F.transform(F.filter(quoted(path), lambda p: p.isNotNull()), shaped), F.array().cast(f"array<{C.PARAM}>"))


def models(df: DataFrame) -> DataFrame:
    """(spectrum_index, mz_delta_model) of the metadata member."""
    if find(df, "spectrum.mz_delta_model") is None:
        return df.sparkSession.createDataFrame([], "spectrum_index bigint, mz_delta_model array<double>")
    own = df.filter("spectrum is not null").select(key(df, "spectrum.index").alias("spectrum_index"), quoted("spectrum.mz_delta_model").cast("array<double>").alias("mz_delta_model"))
    return own.filter("spectrum_index is not null")


def spectra(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Spectrum descriptions with their scans and precursors, from the packed and unaligned metadata member of so many rows."""
    o = lambda path, kind: optional(df, path, kind)
    has = lambda name: df.filter(F.col(name).isNotNull()) if find(df, name) is not None else df.limit(0)
    model = find(df, "spectrum.mz_delta_model")
    own = has("spectrum").select(
        key(df, "spectrum.index").alias("spectrum_index"), o("spectrum.id", "string").alias("id"), F.coalesce(o(f"spectrum.{LEVEL}", "int"), F.lit(0)).alias("ms_level"),
        o("spectrum.time", "double").alias("rt"), C.polarity(o(f"spectrum.{POLARITY}", "int")).alias("polarity"), C.continuity(o(f"spectrum.{REPRESENTATION}", "string")).alias("continuity"),
        F.coalesce(o(f"spectrum.{N_POINTS}", "bigint"), F.lit(0)).alias("declared_points"), F.coalesce(o(f"spectrum.{N_PEAKS}", "bigint"), F.lit(0)).alias("declared_peaks"),
        (quoted("spectrum.mz_delta_model").cast("array<double>") if model is not None else F.lit(None).cast("array<double>")).alias("mz_delta_model"), params(df, "spectrum.parameters").alias("params"),
    ).filter("spectrum_index is not null")
    own = dealt(own, rows, "spectrum_index")

    windows = find(df, "scan.scan_windows")
    limits = C.scan_windows(quoted("scan.scan_windows"), WINDOW_LOW, WINDOW_HIGH) if isinstance(windows, T.ArrayType) else F.array().cast("array<struct<lower: double, upper: double>>")
    scan = F.struct(
        o(f"scan.{START_TIME}", "double").alias("start_time"), o(f"scan.{INJECTION}", "double").alias("injection_time"), o(f"scan.{FILTER}", "string").alias("filter_string"), o(f"scan.{PRESET}", "int").alias("preset_scan_configuration"),
        o("scan.instrument_configuration_ref", "int").alias("instrument_configuration_ref"), o("scan.spectrum_reference", "string").alias("spectrum_reference"), limits.alias("windows"),
        C.with_typed_columns(params(df, "scan.parameters"), o(f"scan.{MOBILITY}", "double"), o(f"scan.{MOBILITY_TYPE}", "string"), o(f"scan.{X}", "int"), o(f"scan.{Y}", "int")).alias("params"),
    )
    precursor = F.struct(
        o("precursor.precursor_index", "bigint").alias("precursor_index"), o("precursor.precursor_id", "string").alias("precursor_id"),
        F.struct(*[o(f"precursor.isolation_window.{n}", "double").alias(a) for n, a in zip(ISOLATION, ("target_mz", "lower_offset", "upper_offset"))]).alias("isolation_window"), params(df, "precursor.activation.parameters").alias("activation"),
    )
    ion = F.struct(o(f"selected_ion.{ION_MZ}", "double").alias("mz"), o(f"selected_ion.{ION_CHARGE}", "int").alias("charge"), o(f"selected_ion.{ION_INTENSITY}", "double").alias("intensity"), params(df, "selected_ion.parameters").alias("params"))

    def facet(name: str, value: Column, out: str) -> DataFrame:
        shown = has(name).select(key(df, f"{name}.source_index").alias("source_index"), "row_no", value.alias("v")).filter("source_index is not null")
        return facets.gathered(dealt(shown, rows, "source_index"), F.col("v"), out)

    ions = facet("selected_ion", ion, "ions").withColumn("ions", F.filter("ions", lambda i: i["mz"].isNotNull()))
    kind = find(df.select(precursor.alias("p")), "p")
    both = facets.precursors_with_ions(facet("precursor", precursor, "precursors"), ions, F.lit(None).cast(kind))
    return facets.facet_join(own, scans=facet("scan", scan, "scans"), precursors=both)


def signal_points(df: DataFrame, index: str = "spectrum_index") -> DataFrame:
    """(spectrum_index, ordinal, mz, intensity) of a signal member, point and chunk rows alike; a null m/z stays null.

    A chunk row counts as Numpress if it has the linear bytes, else as delta or absolute chunk. A row of neither layout, or
    without an index, is an error.
    """
    parts = []
    have_point, have_chunk = find(df, "point") is not None, find(df, "chunk") is not None
    if not have_point and not have_chunk:
        raise ValueError("the member has neither points nor chunks")
    at = lambda pos: F.struct(F.col("row_no"), pos.cast("int").alias("pos")).alias("ordinal")
    needed = lambda c, what: F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{what} without {index}")).cast("bigint"))
    if have_point:
        rows = df.filter("point is not null") if have_chunk else df
        parts.append(rows.select(needed(key(df, f"point.{index}"), "point").alias(index), at(F.lit(0)), optional(df, "point.mz", "double").alias("mz"), F.coalesce(optional(df, "point.intensity", "double"), F.lit(0.0)).alias("intensity")))
    if have_chunk:
        rows = df.filter("chunk is not null" + (" and point is null" if have_point else ""))
        bytes_there = find(df, "chunk.mz_numpress_linear_bytes") is not None
        base = rows.select(needed(key(df, f"chunk.{index}"), "chunk").alias(index), F.col("row_no").alias("chunk_no"), "chunk")
        plain = base.filter("chunk.mz_numpress_linear_bytes is null") if bytes_there else base
        if find(df, "chunk.mz_chunk_values") is not None:
            values = plain.filter("chunk.mz_chunk_values is not null").select(index, "chunk_no", F.col("chunk.mz_chunk_start").cast("double").alias("mz_chunk_start"), F.col("chunk.mz_chunk_values").cast("array<double>").alias("mz_chunk_values"), optional(df, "chunk.chunk_encoding", "string").alias("chunk_encoding"), F.col("chunk.intensity").cast("array<double>").alias("intensity"))
            parts.append(chunks.delta_points(values, index).select(index, F.struct(F.col("chunk_no").alias("row_no"), F.col("pos").cast("int").alias("pos")).alias("ordinal"), "mz", "intensity"))
        if bytes_there:
            coded = base.filter("chunk.mz_numpress_linear_bytes is not null").select(index, "chunk_no", *[F.col(f"chunk.{c}") for c in ("mz_numpress_linear_bytes", "intensity_numpress_slof_bytes", "intensity_numpress_pic_bytes", "intensity") if find(df, f"chunk.{c}") is not None])
            parts.append(chunks.numpress_points(coded, index).select(index, F.struct(F.col("chunk_no").alias("row_no"), F.col("pos").cast("int").alias("pos")).alias("ordinal"), "mz", "intensity"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def axis_points(df: DataFrame, index: str, axis: str) -> DataFrame:
    """(index, ordinal, axis, intensity) of a chromatogram or wavelength member: points, or delta chunks along the axis."""
    if find(df, "point") is not None:
        rows = df.filter("point is not null")
        return rows.select(key(df, f"point.{index}").alias(index), F.struct("row_no", F.lit(0).alias("pos")).alias("ordinal"), optional(df, f"point.{axis}", "double").alias(axis), F.coalesce(optional(df, "point.intensity", "double"), F.lit(0.0)).alias("intensity")).filter(f"{index} is not null")
    rows = df.filter("chunk is not null").select(key(df, f"chunk.{index}").alias(index), F.col("row_no").alias("chunk_no"), F.col(f"chunk.{axis}_chunk_start").alias("time_chunk_start"), F.col(f"chunk.{axis}_chunk_values").alias("time_chunk_values"), F.col("chunk.intensity").cast("array<double>").alias("intensity"))
    p = chunks.chromatogram_points(rows, index)
    return p.select(index, F.struct(F.col("chunk_no").alias("row_no"), F.col("pos").cast("int").alias("pos")).alias("ordinal"), F.col("time").alias(axis), "intensity")


def _last(df: DataFrame, index: str) -> DataFrame:
    """Of rows with one index the last; null indices are placeholders."""
    rest = [c for c in df.columns if c not in (index, "row_no")]
    last = df.filter(F.col(index).isNotNull()).groupBy(index).agg(F.max(F.struct("row_no", *rest)).alias("s"))
    return last.select(index, *[F.col(f"s.{c}").alias(c) for c in rest])


def chromatograms(df: DataFrame) -> DataFrame:
    rows = df.filter("chromatogram is not null").select(key(df, "chromatogram.index").alias("chromatogram_index"), "row_no", optional(df, "chromatogram.id", "string").alias("id"), optional(df, f"chromatogram.{CHROMATOGRAM_TYPE}", "string").alias("type"))
    return _last(rows, "chromatogram_index")


def wavelength_spectra(df: DataFrame) -> DataFrame:
    rows = df.filter("spectrum is not null").select(key(df, "spectrum.index").alias("wavelength_spectrum_index"), "row_no", optional(df, "spectrum.id", "string").alias("id"), optional(df, "spectrum.time", "double").alias("time"), F.coalesce(optional(df, f"spectrum.{LAMBDA_MAX}", "double"), optional(df, "spectrum.lambda_max", "double")).alias("lambda_max"))
    return _last(rows, "wavelength_spectrum_index")


def footer_bytes(spark: SparkSession, path: str) -> bytes:
    """The end of a Parquet file, from its footer on, behind the magic bytes: enough to read its metadata, and no data.

    Two short reads through Spark's file systems, whatever the file's size.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = store.getFileStatus(where).getLen()
    stream = store.open(where)
    try:

        def last(n: int) -> bytes:
            stream.seek(size - n)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

        return b"PAR1" + last(int.from_bytes(last(8)[:4], "little") + 8)
    finally:
        stream.close()
