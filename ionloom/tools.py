"""The tools over runs: info, file info, extraction, DTA conversion and extracted-ion chromatograms."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import lookups
from .run import Run
from .sources import sinks
from .sources.manifest import ARCHIVE_SUFFIX


def info(run: Run, first: int = 5) -> dict[str, DataFrame]:
    """Counts by level, chromatograms, the number of wavelength spectra and the first spectra."""
    metadata = run.metadata()
    return {
        "levels": metadata.groupBy("ms_level").agg(F.count("*").alias("spectra")),
        "chromatograms": run.chromatograms().select("chromatogram_index", "id", "type", F.size("time").alias("points")),
        "wavelength_spectra": run.wavelength_spectra().agg(F.count("*").alias("spectra")),
        "first": lookups.first_spectra(metadata, first).select("spectrum_index", "id", "ms_level", "rt", "polarity", "continuity"),
    }


def extract(run: Run, path: str, levels: list[int] | None = None, rt_min: float | None = None, rt_max: float | None = None, keep_metadata: bool = False) -> None:
    """Spectra that pass the filter, with their own indices, to a run of their own: an archive if the path ends in its suffix."""
    kept = run.metadata().filter(C.spectrum_filter(levels, rt_min, rt_max))
    points = run.points().join(kept.select("spectrum_index").hint("merge"), "spectrum_index", "left_semi")
    sinks.write_run(kept, points, path, container="zip" if path.endswith(ARCHIVE_SUFFIX) else "dir", about=run.file_metadata() if keep_metadata else None)


def to_dta(run: Run, path: str, levels: list[int] | None = None, rt_min: float | None = None, rt_max: float | None = None, charge: int = 2) -> None:
    base = os.path.basename(run.path.rstrip("/"))
    sinks.write_dta(sinks.dta_texts(run.spectra(), base, charge, C.spectrum_filter(levels, rt_min, rt_max)), path)


def to_xic_csv(run: Run, path: str, mz: float, tolerance: C.Tolerance, levels: list[int] | None = (1,), rt_min: float | None = None, rt_max: float | None = None) -> None:
    sinks.write_xic_csv(run.xic(mz, tolerance, levels, rt_min, rt_max), path)
