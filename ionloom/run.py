"""A run as lazy tables: open it, look things up, summarise it."""

from __future__ import annotations

import io

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import peaks as P
from .operators import analytics, facets, gaps, lookups
from .sources import manifest as M
from .sources import tables
from .sources.archive import located, safe_member
from .sources.groups import for_keys, for_mz, group_index, read_groups
from .sources.storage import dealt


class Run:
    """One run. Every table is lazy; nothing is read but the manifest until a table is used."""

    def __init__(self, spark: SparkSession, path: str, reconstruct: bool = True):
        self.spark, self.path, self.reconstruct = spark, path, reconstruct
        self.place = located(spark, path)
        try:
            self.manifest = M.Manifest.parse(self.place.manifest_text(spark))
            if self.manifest.find(M.SPECTRA) is None:
                raise M.RunError("the run has no spectrum metadata")
        except Exception:
            self.close()
            raise

    def close(self) -> None:
        """Removes what was staged; tables of such an archive can't be used any more then."""
        self.place.remove()

    def __enter__(self) -> Run:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def member(self, role: tuple[str, str]) -> DataFrame | None:
        """A member's rows with row_no, their place; None if the run hasn't got it."""
        name = self.manifest.find(role)
        if name is None:
            return None
        name = safe_member(name)
        if name in self.place.members:
            return read_groups(self.spark, self.place.members[name])
        if self.place.members:
            raise M.RunError(f"the archive has no member {name!r}")
        return tables.read(self.spark, f"{self.place.folder}/{name}")

    def values(self, role: tuple[str, str], keys: tuple[int, int] | None = None, mz: tuple[float, float] | None = None, rows: bool = False) -> int:
        """About how many values, or rows, needed() gives: from footers; where tasks can't open the member, all its rows."""
        name = self.manifest.find(role)
        where = None if name is None else self.place.direct(safe_member(name))
        if where is None:
            return 0 if name is None else self.member(role).count()
        groups = group_index(where)
        groups = groups if keys is None else for_keys(groups, *keys)
        groups = groups if mz is None else for_mz(groups, *mz)
        return sum(g.rows if rows else g.values for g in groups)

    def needed(self, role: tuple[str, str], keys: tuple[int, int] | None = None, mz: tuple[float, float] | None = None) -> DataFrame | None:
        """The rows of the row groups of a signal member that may hold spectra with these indices, or points with this m/z, both ends inclusive.

        All rows where tasks can't open the member by themselves. What isn't asked for must still be filtered.
        """
        name = self.manifest.find(role)
        where = None if name is None else self.place.direct(safe_member(name))
        if where is None or (keys is None and mz is None):
            return self.member(role)
        every = group_index(where)
        groups = every if keys is None else for_keys(every, *keys)
        groups = groups if mz is None else for_mz(groups, *mz)
        return read_groups(self.spark, where, groups) if len(groups) < len(every) else self.member(role)

    # ---- metadata ----

    @property
    def is_imaging(self) -> bool:
        return self.manifest.is_imaging

    def scan_settings(self) -> DataFrame:
        """(id, max_x, max_y, pixel_x, pixel_y, params)."""
        schema = f"id string, params array<{C.PARAM}>"
        rows = [(s["id"], [tuple(v if k != "value" else tuple(v.values()) for k, v in p.items()) for p in s["parameters"]]) for s in self.manifest.scan_settings]
        number = C.setting_number
        # The imaging vocabulary's pixel counts and sizes.
        return self.spark.createDataFrame(rows, schema).select("id", number("params", "IMS:1000042", "int").alias("max_x"), number("params", "IMS:1000043", "int").alias("max_y"), number("params", "IMS:1000046", "double").alias("pixel_x"), number("params", "IMS:1000047", "double").alias("pixel_y"), "params")

    def metadata(self) -> DataFrame:
        """One row a spectrum: description, scans, precursors with their ions, parameters."""
        return tables.spectra(self.member(M.SPECTRA), self.values(M.SPECTRA, rows=True))

    def footer(self) -> dict[str, str]:
        """Key-value pairs of the metadata member's Parquet footer."""
        name = safe_member(self.manifest.find(M.SPECTRA))
        if (where := self.place.direct(name)) is not None:
            with where.open() as f:
                pairs = f.metadata.metadata
        else:
            pairs = pq.read_metadata(io.BytesIO(tables.footer_bytes(self.spark, f"{self.place.folder}/{name}"))).metadata
        return {k.decode(): v.decode() for k, v in (pairs or {}).items()}

    def file_metadata(self) -> dict:
        return M.file_metadata(self.footer())

    def size(self) -> int:
        return self.metadata().count()

    def contains(self, index: int) -> bool:
        return not lookups.by_index(self.metadata(), index).isEmpty()

    # ---- signals ----

    def _points(self, role: tuple[str, str], keys: tuple[int, int] | None = None, mz: tuple[float, float] | None = None) -> DataFrame:
        df = self.needed(role, keys, mz)
        if df is None:
            return self.spark.createDataFrame([], "spectrum_index bigint, ordinal struct<row_no: struct<file: string, row: bigint>, pos: int>, mz double, intensity double")
        points = tables.signal_points(df)
        points = points if keys is None else points.filter(F.col("spectrum_index").between(*keys))
        points = gaps.reconstruct(points, tables.models(self.member(M.SPECTRA)), ["ordinal"], fill=self.reconstruct, size=self.values(role, keys, mz))
        return points if mz is None else points.filter(F.col("mz").between(*mz))

    def profile_points(self) -> DataFrame:
        """(spectrum_index, ordinal, mz, intensity), gaps filled or dropped."""
        return self._points(M.SIGNALS)

    def peak_points(self) -> DataFrame:
        return self._points(M.PEAKS)

    def points(self, keys: tuple[int, int] | None = None, mz: tuple[float, float] | None = None) -> DataFrame:
        """The points of each spectrum's payload: of its profile, or of its peaks if it has no profile.

        keys and mz are ranges of indices and m/z, both ends inclusive; only row groups that may hold such points are read.
        """
        profile, peaks = self._points(M.SIGNALS, keys, mz), self._points(M.PEAKS, keys, mz)
        if self.manifest.find(M.SIGNALS) is None or self.manifest.find(M.PEAKS) is None:
            return profile.unionByName(peaks)
        has = tables.signal_points(self.needed(M.SIGNALS, keys)).select("spectrum_index").distinct()  # whatever its m/z
        return profile.unionByName(peaks.join(has.hint("merge"), "spectrum_index", "left_anti"))

    def spectra(self, index: int | None = None, ordinal: int | None = None, native_id: str | None = None, scan: int | None = None, nearest_time: float | None = None) -> DataFrame:
        """Spectra with mz, intensity and peaks arrays: all, or the one that is asked for. Only its signal is read."""
        metadata = self.metadata()
        if index is not None:
            metadata = lookups.by_index(metadata, index)
        elif ordinal is not None:
            metadata = lookups.by_ordinal(metadata, ordinal)
        elif native_id is not None:
            metadata = metadata.join(lookups.index_of_ids(metadata.filter(F.col("id") == native_id)).select("spectrum_index"), "spectrum_index", "left_semi")
        elif scan is not None:
            metadata = metadata.join(lookups.index_of_scans(metadata).filter(F.col("scan") == scan).select("spectrum_index"), "spectrum_index", "left_semi")
        elif nearest_time is not None:
            metadata = metadata.join(lookups.nearest_time(metadata, nearest_time).select("spectrum_index"), "spectrum_index", "left_semi")
        keys = None if index is None else (index, index)
        if any(x is not None for x in (ordinal, native_id, scan, nearest_time)):
            found = metadata.select("spectrum_index").first()
            keys = (found[0], found[0]) if found else (0, -1)  # no key is between these
        profile = facets.points_to_arrays(self._points(M.SIGNALS, keys), "ordinal")
        centroids = facets.points_to_arrays(self._points(M.PEAKS, keys), "ordinal")
        listed = centroids.select("spectrum_index", P.normalised_peaks("mz", "intensity").alias("peaks"))
        as_arrays = listed.select("spectrum_index", F.transform("peaks", lambda p: p["mz"]).alias("mz"), F.transform("peaks", lambda p: p["intensity"]).alias("intensity"))
        out = facets.payload(metadata, profile, as_arrays).join(listed, "spectrum_index", "left")
        kind = out.schema["peaks"].dataType.simpleString()
        return out.withColumn("peaks", F.coalesce("peaks", F.array().cast(kind))).withColumn("mz", P.checked_lengths("mz", "intensity", "m/z and intensity"))

    # ---- chromatograms and wavelength spectra ----

    def chromatogram_points(self) -> DataFrame:
        df = self.member(M.CHROMATOGRAM_SIGNALS)
        if df is None:
            return self.spark.createDataFrame([], "chromatogram_index bigint, ordinal int, time double, intensity double")
        return tables.axis_points(df, "chromatogram_index", "time")

    def chromatograms(self) -> DataFrame:
        """(chromatogram_index, id, type, time, intensity); empty unless the run has both members."""
        df = self.member(M.CHROMATOGRAMS)
        if df is None or self.manifest.find(M.CHROMATOGRAM_SIGNALS) is None:
            return self.spark.createDataFrame([], "chromatogram_index bigint, id string, type string, time array<double>, intensity array<double>")
        return facets.with_arrays(tables.chromatograms(df), dealt(self.chromatogram_points(), self.values(M.CHROMATOGRAM_SIGNALS), "chromatogram_index"), "ordinal", "time", "chromatogram_index")

    def wavelength_points(self) -> DataFrame:
        df = self.member(M.WAVELENGTH_SIGNALS)
        if df is None:
            return self.spark.createDataFrame([], "wavelength_spectrum_index bigint, ordinal int, wavelength double, intensity double")
        return tables.axis_points(df, "wavelength_spectrum_index", "wavelength")

    def wavelength_spectra(self) -> DataFrame:
        df = self.member(M.WAVELENGTHS)
        if df is None or self.manifest.find(M.WAVELENGTH_SIGNALS) is None:
            return self.spark.createDataFrame([], "wavelength_spectrum_index bigint, id string, time double, lambda_max double, wavelength array<double>, intensity array<double>")
        return facets.with_arrays(tables.wavelength_spectra(df), dealt(self.wavelength_points(), self.values(M.WAVELENGTH_SIGNALS), "wavelength_spectrum_index"), "ordinal", "wavelength", "wavelength_spectrum_index")

    # ---- checks, stores ----

    def validate(self) -> None:
        """Raises RunError for indices that occur twice, and for signal files whose spectra are not in one piece each."""
        if not analytics.duplicate_indices(self.metadata()).isEmpty():
            raise M.RunError("spectrum indices occur more than once")
        for role in (M.SIGNALS, M.PEAKS):
            if (df := self.member(role)) is not None:
                rows = tables.signal_points(df)
                # A spectrum in one piece covers as many file rows as lie between its first and last.
                per = rows.select("spectrum_index", F.col("ordinal.row_no.file").alias("file"), F.col("ordinal.row_no.row").alias("row")).distinct()
                split = per.groupBy("file", "spectrum_index").agg((F.max("row") - F.min("row") + 1 - F.count("*")).alias("holes")).filter("holes <> 0")
                if not split.isEmpty():
                    raise M.RunError("a signal file holds a spectrum in several pieces")

    def store(self, path: str) -> None:
        """The run's long tables as Parquet with BIGINT keys, ranged and sorted by spectrum, so that filters on it skip row groups."""
        self.metadata().repartitionByRange("spectrum_index").sortWithinPartitions("spectrum_index").write.parquet(f"{path}/spectra")
        for name, points in (("profile", self.profile_points()), ("peaks", self.peak_points())):
            w = Window.partitionBy("spectrum_index").orderBy("ordinal")
            flat = points.withColumn("ordinal", F.row_number().over(w) - 1)
            flat.repartitionByRange("spectrum_index", "ordinal").sortWithinPartitions("spectrum_index", "ordinal").write.parquet(f"{path}/{name}")

    # ---- reports ----

    def xic(self, mz: float, tolerance: C.Tolerance, levels: list[int] | None = (1,), rt_min: float | None = None, rt_max: float | None = None) -> DataFrame:
        """As analytics.xic(). Row groups outside the m/z window, and outside the indices of the time range, aren't read."""
        keep = C.spectrum_filter(list(levels) if levels else None, rt_min, rt_max)
        metadata, keys = self.metadata(), None
        if rt_min is not None or rt_max is not None:
            low, high = metadata.filter(keep).agg(F.min("spectrum_index"), F.max("spectrum_index")).first()
            keys = (0, -1) if low is None else (low, high)
        return analytics.xic(metadata, self.points(keys, tolerance.limits(mz)), mz, tolerance, keep)

    def report(self) -> dict[str, DataFrame]:
        """The parts of a summary, each a small table."""
        metadata, points = self.metadata(), self.points()
        first = C.primary("precursors")
        ms1 = points.join(metadata.filter("ms_level = 1").select("spectrum_index").hint("merge"), "spectrum_index", "left_semi")
        found = self.chromatograms()
        return {
            "levels": analytics.count_per_level(metadata),
            "ranges": analytics.ranges(metadata, points),
            "continuity": analytics.continuity_per_level(metadata),
            "charges": analytics.charge_histogram(metadata, C.primary(first["ions"])["charge"]),
            "activation": analytics.activation_histogram(metadata, first["precursor"]["activation"]),
            "ms1_intensity": analytics.five_numbers(ms1, "intensity"),
            "chromatograms": found.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("chromatograms"), F.sum(F.size("time")).alias("points")).withColumn("name", C.chromatogram_type_name("type")),
        }


def open_run(spark: SparkSession, path: str, reconstruct: bool = True) -> Run:
    """A run in a folder, in any store that Spark reads, or in a local ZIP archive."""
    return Run(spark, path, reconstruct)
