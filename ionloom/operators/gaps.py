"""Reconstruction of null-marked m/z: linear and polynomial gap filling, or dropping.

Without models, the anchor on the left comes from a window that runs ahead, the one on the right from a window that runs back:
both grow by a row at a time, so that a spectrum costs its length. They share one exchange, and the first its sort with the places.
Points are dealt to as many tasks as keep the rows that one sorts bounded. With models, each m/z follows from
the one before, and one pass in Arrow batches carries it. A spectrum is the unit of work; a run has many, so hot keys don't
arise from the format.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.storage import dealt

KEYS = ("spectrum_index",)


def _anchors(points: DataFrame, keys, order) -> DataFrame:
    """Adds place, and the nearest known value and its place on the left (lv, lp) and on the right (rv, rp)."""
    ahead = Window.partitionBy(*keys).orderBy(*order)
    placed = dealt(points, points.count(), *keys).withColumn("place", F.row_number().over(ahead))
    grown = lambda *by: Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("mz").isNotNull(), F.struct(F.col("mz").alias("v"), F.col("place").alias("p")))
    placed = placed.withColumn("left", F.last(known, ignorenulls=True).over(grown(*order)))  # rows lie in the order of their places
    # By place, which has no ties, so that the way back is the way ahead reversed.
    placed = placed.withColumn("right", F.last(known, ignorenulls=True).over(grown(F.desc("place"))))
    return placed.select("*", F.col("left.v").alias("lv"), F.col("left.p").alias("lp"), F.col("right.v").alias("rv"), F.col("right.p").alias("rp")).drop("left", "right")


def _straight() -> Column:
    between = F.col("lv") + (F.col("rv") - F.col("lv")) * (F.col("place") - F.col("lp")) / (F.col("rp") - F.col("lp"))
    return F.coalesce("mz", F.when(F.col("lv").isNotNull() & F.col("rv").isNotNull(), between), "lv", "rv")


def step(x: float, model: list[float]) -> float:
    """The model's polynomial at x, by rising powers."""
    total, power = 0.0, 1.0
    for b in model:
        total += b * power
        power *= x
    return total


def walked(x: float, n: int, model: list[float], sign: int = 1) -> list[float]:
    """n steps on from x, ahead or back."""
    out = []
    for _ in range(n):
        x = x + sign * step(x, model)
        out.append(x)
    return out


def filled(mz: np.ndarray, known: np.ndarray, left: float | None, model: list[float] | None, ended: bool) -> tuple[int, float | None]:
    """Fills one spectrum's m/z in place, as far as they are told: (rows told, the last m/z, known or filled).

    left: the m/z before the first row, None if there is none. Unless ``ended``, the spectrum goes on, and a run of gaps at the
    end may have to wait for the next known m/z.
    """
    n = len(mz)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], known, [True]]).astype(np.int8)))
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()):
        low, high = (float(mz[a - 1]) if a else left), (float(mz[b]) if b < n else None)
        if high is None and not ended and (low is None or model is None):
            return a, low
        if low is None and high is None:
            return n, None
        if model is not None:
            mz[a:b] = walked(low, b - a, model) if low is not None else walked(high, b - a, model, -1)[::-1]
        elif low is None or high is None:
            mz[a:b] = high if low is None else low
        else:
            mz[a:b] = low + (high - low) * np.arange(1.0, b - a + 1) / (b - a + 1)
        known[a:b] = True
    return n, float(mz[-1]) if n else left


def _changed(column: pa.ChunkedArray) -> np.ndarray:
    """Whether a row's value differs from the one before it."""
    if column.null_count:
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values, values[1:])], bool)
    values = column.to_numpy()
    return np.asarray(values[1:] != values[:-1], bool)


def _fill(n_keys: int):
    """Over batches (keys, kind, model, mz, others) sorted by spectrum: rows of kind 0 bring a spectrum's model, the others come out as (keys, mz, others).

    What goes on from batch to batch is the spectrum at hand, its model and last m/z, and the rows of a run of gaps whose end hasn't come yet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model, left, waiting = None, None, None, None

        def worked(t: pa.Table, last: bool) -> tuple[pa.Table, pa.Table]:
            nonlocal at, model, left
            n = told = t.num_rows
            keys, kind, models, column = t.select(range(n_keys)), t.column(n_keys).to_numpy(), t.column(n_keys + 1), t.column(n_keys + 2)
            mz, known = pc.fill_null(column, 0.0).to_numpy().copy(), pc.is_valid(column).to_numpy().copy()
            starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([_changed(c) for c in keys.columns])])
            open_ones = np.add.reduceat(~known & (kind != 0), starts, dtype=np.int64) > 0
            open_ones[-1] = True  # goes on, perhaps
            for a, b in zip(starts[open_ones].tolist(), np.r_[starts[1:], n][open_ones].tolist()):  # whole spectra without gaps stay as they are
                own = tuple(c[a].as_py() for c in keys.columns)
                if own != at:
                    at, model, left = own, None, None
                while a < b and kind[a] == 0:
                    given = models[a].as_py() or []
                    model, a = given if given and None not in given else None, a + 1
                done, left = filled(mz[a:b], known[a:b], left, model, last or b < n)
                told = a + done if b == n else told
            whole = t.set_column(n_keys + 2, "mz", pa.array(mz, mask=~known)).filter(pa.array((kind != 0) & (np.arange(n) < told)))
            return whole.drop_columns(t.column_names[n_keys : n_keys + 2]), t.slice(told)

        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch])
                out, waiting = worked(t if waiting is None else pa.concat_tables([waiting, t]), False)
                yield from out.to_batches()
        if waiting is not None and waiting.num_rows:
            yield from worked(waiting, True)[0].to_batches()

    return run


def linear_fill(points: DataFrame, order, keys=KEYS) -> DataFrame:
    """Null m/z on the straight line between its known neighbours, level before the first and after the last; all null: as they are."""
    return _anchors(points, keys, order).withColumn("mz", _straight()).drop("place", "lv", "lp", "rv", "rp")


def poly_fill(points: DataFrame, models: DataFrame, order, keys=KEYS) -> DataFrame:
    """As reconstruct()."""
    return reconstruct(points, models, order, keys)


def drop_gaps(points: DataFrame) -> DataFrame:
    return points.filter(F.col("mz").isNotNull())


def reconstruct(points: DataFrame, models: DataFrame | None, order, keys=KEYS, fill: bool = True, size: int | None = None) -> DataFrame:
    """Null m/z by the spectrum's own polynomial (models: keys, mz_delta_model), by a straight line without one; or dropped.

    The polynomial gives the distance from one m/z to the next: interior and trailing runs walk ahead from the left anchor,
    a leading run walks back from the first. One pass over the sorted points fills every gap from the one before, so that a run
    costs its length; only a run whose end must be known waits for it. size: about how many points there are, else they are counted.
    """
    if not fill:
        return drop_gaps(points)
    if models is None:
        return linear_fill(points, order, keys)
    rest = [c for c in points.columns if c not in (*keys, "mz")]
    nothing = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in rest]
    own = models.filter(F.size("mz_delta_model") > 0).select(*keys, F.lit(0).alias("kind"), F.col("mz_delta_model").cast("array<double>").alias("model"), F.lit(None).cast("double").alias("mz"), *nothing)
    rows = points.select(*keys, F.lit(1).alias("kind"), F.lit(None).cast("array<double>").alias("model"), F.col("mz").cast("double").alias("mz"), *rest)
    both = dealt(own.union(rows), points.count() if size is None else size, *keys).sortWithinPartitions(*keys, "kind", *order)
    out = T.StructType([T.StructField(c, both.schema[c].dataType) for c in (*keys, "mz", *rest)])
    return both.mapInArrow(_fill(len(keys)), out).select(*points.columns)
