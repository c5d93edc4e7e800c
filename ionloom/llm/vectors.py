"""What the vector operators share: vectors as whole numbers, in numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Components are below this in size, so that sums of squares stay exact.
LARGEST = float(1 << 17)


def whole(vector: Column, row_id: Column) -> Column:
    """The vector as array<int>, each component floor(SCALE * x); null for a null vector or one with a component that is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = F.forall(x, lambda v: F.abs(v) < LARGEST)
    said = F.concat(F.lit("a component is too large for exact sums, vector "), F.coalesce(row_id.cast("string"), F.lit("?")))
    codes = F.transform(x, lambda v: F.floor(v * SCALE).cast("int"))
    return F.when(sound & fits, codes).when(sound, F.raise_error(said).cast("array<int>"))


def of_one_length(rows: DataFrame, codes: str = "q") -> int:
    """The length that all the vectors have, 0 for none; different lengths are an error."""
    low, high = rows.agg(F.min(F.size(codes)), F.max(F.size(codes))).first()
    if low != high:
        raise ValueError(f"vectors have {low} to {high} components")
    return low or 0


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """An Arrow column of equally long lists, none of them null, as a matrix of int64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
