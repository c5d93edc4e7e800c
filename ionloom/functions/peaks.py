"""Column expressions over the peak arrays of one spectrum: array<struct<mz, intensity, index>> in ascending m/z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import Tolerance, _col, finite


def normalised_peaks(mz: Column | str, intensity: Column | str) -> Column:
    """Peaks of two arrays of equal length: those without a finite m/z go, the rest by m/z; index is the place before sorting."""
    mz, intensity = _col(mz), _col(intensity)
    pairs = F.transform(mz, lambda m, i: F.struct(m.cast("double").alias("mz"), i.cast("int").alias("index"), F.get(intensity, i).cast("double").alias("intensity")))
    kept = F.array_sort(F.filter(pairs, lambda p: finite(p["mz"]).isNotNull()))
    return F.transform(kept, lambda p: F.struct(p["mz"], p["intensity"], p["index"]))


def checked_lengths(a: Column | str, b: Column | str, what: str) -> Column:
    """a, or an error if its length isn't that of b."""
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), a).otherwise(F.raise_error(F.lit(f"{what} arrays differ in length")))


def find_peaks_between(peaks: Column | str, lo, hi) -> Column:
    """The peaks from lo to hi, both inclusive, in m/z order."""
    lo, hi = (F.lit(x) if isinstance(x, (int, float)) else x for x in (lo, hi))
    return F.filter(_col(peaks), lambda p: (p["mz"] >= lo) & (p["mz"] <= hi))


def find_peaks(peaks: Column | str, target, tolerance: Tolerance) -> Column:
    """The peaks within the tolerance of the target, in m/z order."""
    bounds = tolerance.bounds(target)
    return find_peaks_between(peaks, bounds["lo"], bounds["hi"])


def find_peak(peaks: Column | str, target, tolerance: Tolerance) -> Column:
    """The peak closest to the target within the tolerance, the lower m/z of two equally close; NULL if none is."""
    at = F.lit(target) if isinstance(target, (int, float)) else _col(target)
    near = F.transform(find_peaks(peaks, target, tolerance), lambda p: F.struct(F.abs(p["mz"] - at).alias("off"), p["mz"].alias("mz"), p["index"].alias("index"), p["intensity"].alias("intensity")))
    best = F.array_min(near)
    return F.when(best.isNotNull(), F.struct(best["mz"], best["intensity"], best["index"]))
