"""Hard-negative mining by distributed radix selection.

Every anchor is scored against all rows, in blocks of anchors: a block's vectors and what is known of its windows go to the
tasks, which score their rows in numpy and count. A window is an anchor's rows of its own label, or, for an anchor and one of
its positives, the rows of other labels whose score lies in the positive's range. To find a window's kth row, each task counts
its rows by the leading digit of their distance from the window's upper end; the sums tell the bucket of the kth row, and the
next digit is counted in that bucket alone, down to the exact score. Where more rows have that score than are wanted, the
digits of their ids are searched in the same way. Only then are rows gathered, at most k a window. A task reports no bucket
behind the one in which its own rows reach k, since the kth of all can't lie there: k rows a window and task at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, shared_dir, table, written
from .vectors import matrix, of_one_length, whole

POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Bits of a digit, anchors of a block, and rows scored at once.
DIGIT, ANCHORS, ROWS = 8, 1024, 2048
_NONE = np.iinfo(np.int64).max


@dataclass
class Anchors:
    """A block of anchors, and the windows on their scores: low and top are (anchors x windows), both inclusive."""

    q: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    low: np.ndarray
    top: np.ndarray
    same: bool
    first_id: int

    def candidates(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(cell, distance, row) of the rows of a batch (vec_id, label, q) inside the windows; a cell is anchor * windows + window."""
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        q = matrix(batch.column(2), self.q.shape[1]).astype(self.q.dtype)
        for a in range(0, len(ids), ROWS):
            some = slice(a, a + ROWS)
            scores = self.q @ q[some].T  # whole numbers, exact in this type
            alike = self.labels[:, None] == labels[None, some]
            mask = alike & (self.ids[:, None] != ids[None, some]) if self.same else ~alike
            for p in range(self.low.shape[1]):
                anchor, row = np.nonzero(mask & (scores >= self.low[:, p, None]) & (scores <= self.top[:, p, None]))
                yield anchor * self.low.shape[1] + p, self.top[anchor, p] - scores[anchor, row].astype(np.int64), row + a


def _kth_buckets(rows: DataFrame, block: Anchors, prefix: np.ndarray, left: np.ndarray, shift: int, ties_at: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(cell, digit, before, n): the bucket that holds the row number ``left`` of those with the prefix, how many come before it, and how many it has.

    The digit is one of the distance, or, with ties_at, of the id among rows at that distance. Cells with too few rows are in no row.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(left), 1 << DIGIT), np.int64)
        flat = counts.ravel()
        for batch in batches:
            for cell, off, row in block.candidates(batch):
                value = off
                if ties_at is not None:
                    tied = off == ties_at[cell]
                    cell, value = cell[tied], batch.column(0).to_numpy()[row[tied]] - block.first_id
                here = (value >> (shift + DIGIT) == prefix[cell]) & (left[cell] > 0)
                np.add.at(flat, (cell[here] << DIGIT) | ((value[here] >> shift) & ((1 << DIGIT) - 1)), 1)
        reached = counts.cumsum(1) - counts >= left[:, None]
        cell, digit = np.nonzero((counts > 0) & ~reached)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(digit), pa.array(counts[cell, digit]), pa.array(left[cell])], names=["cell", "digit", "n", "left"])

    each = rows.select("vec_id", "label", "q").mapInArrow(counted, "cell long, digit long, n long, left long")
    total = each.groupBy("cell", "digit", "left").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("cell").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = total.withColumn("before", upto - F.col("n")).filter("before < left AND before + n >= left").select("cell", "digit", "before", "n")
    got = np.array([tuple(r) for r in found.collect()], np.int64).reshape(-1, 4)  # one row a cell
    return tuple(got.T)


def _radix(rows: DataFrame, block: Anchors, left: np.ndarray, bits: int, ties_at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, left, n) of each cell's kth row: its value, or _NONE where there are fewer rows; which of the n rows of that value it is."""
    prefix, left, n = np.zeros(len(left), np.int64), left.copy(), np.zeros(len(left), np.int64)
    for shift in reversed(range(0, max(bits, 1), DIGIT)):
        cell, digit, before, held = _kth_buckets(rows, block, prefix, left, shift, ties_at)
        known = np.zeros(len(left), bool)
        known[cell] = True
        left[~known] = 0
        prefix[cell] = prefix[cell] << DIGIT | digit
        left[cell] -= before
        n[cell] = held
        if not len(cell):
            break
    return np.where(left > 0, prefix, _NONE), left, n


def first_rows(rows: DataFrame, block: Anchors, k: int, id_bits: int) -> DataFrame:
    """(cell, rank, vec_id, score): the first k rows of each window, higher scores first, smaller ids first among equals."""
    wanted = np.where(block.low <= block.top, k, 0).ravel()
    span = int((block.top - block.low).max(initial=0))
    cut, left, n = _radix(rows, block, wanted, span.bit_length())
    tied = np.where(n > left, left, 0)
    cut_id = np.full(len(cut), _NONE)
    if tied.any():
        cut_id = np.where(tied > 0, _radix(rows, block, tied, id_bits, cut)[0], _NONE)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tops = batch.column(0).to_numpy(), block.top.ravel()
            for cell, off, row in block.candidates(batch):
                keep = (off < cut[cell]) | ((off == cut[cell]) & (ids[row] - block.first_id <= cut_id[cell]))
                cell, off, row = cell[keep], off[keep], row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids[row]), pa.array(tops[cell] - off)], names=["cell", "vec_id", "score"])

    few = rows.select("vec_id", "label", "q").mapInArrow(gathered, "cell long, vec_id long, score long")
    order = Window.partitionBy("cell").orderBy(F.desc("score"), "vec_id")  # k rows, and copies of the last
    return few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("cell", "rank", "vec_id", "score")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = ANCHORS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides; scores are inner products of components floor(256 * x). An anchor's
    positives are its first rows of the same label, and a positive's negatives the first rows of other labels with a score
    between ``low`` and ``high`` percent of the positive's. Higher scores come first, then smaller ids. Rows with a null id,
    label or vector, or a component that is null or not finite, take no part. Rows alike in id, label and vector are one; an
    anchor's other rows are those with another id. Anchors without positives and positives without negatives are in no row;
    an empty table gives none. Other columns are ignored. Vectors of different lengths, or too long for exact scores, are an error.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        q = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole(F.col(vector), F.col(vec_id)).alias("q"))
        rows = written(q.filter("vec_id is not null and label is not null and q is not null").distinct(), "scored-rows")
        length = of_one_length(rows)
        norm = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
        first_id, last_id, longest = rows.agg(F.min("vec_id"), F.max("vec_id"), F.max(norm)).first()
        if (longest or 0) >= 1 << 53:
            raise ValueError("vectors are too long for exact scores")
        kind = np.float32 if (longest or 0) < 1 << 24 else np.float64  # no partial sum is above the longest norm
        anchors = rows.filter(F.col("vec_id") % every == 0)
        blocks = -(-anchors.count() // block_rows)
        anchors = written(anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(max(blocks, 1)))), "anchors")
        out = f"{shared_dir(spark)}/ionloom-negatives-{uuid.uuid4().hex}"
        kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        spark.createDataFrame([], kinds).write.parquet(out)
        for b in range(blocks):
            _mined(rows, anchors.filter(F.col("block") == b), (length, kind, first_id, last_id, longest), positives, negatives, (low, high)).write.mode("append").parquet(out)
    return spark.read.schema(kinds).parquet(out)


def _mined(rows: DataFrame, anchors: DataFrame, about: tuple, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    """What hard_negatives() returns, for one block of anchors; the block and its positives pass through the driver."""
    length, kind, first_id, last_id, longest = about
    own = anchors.select("vec_id", "label", "q").collect()
    ids, labels = (np.array([r[c] for r in own], np.int64) for c in ("vec_id", "label"))
    vectors = np.array([r.q for r in own], kind).reshape(len(own), length)
    id_bits = (last_id - first_id).bit_length()
    all_scores = np.full((len(own), 1), longest, np.int64)
    block = Anchors(vectors, ids, labels, -all_scores, all_scores, True, first_id)
    near = first_rows(rows, block, positives, id_bits).collect()  # so many positives an anchor at most
    low, top = np.ones((len(own), positives), np.int64), np.zeros((len(own), positives), np.int64)
    for r in near:
        low[r.cell, r["rank"] - 1], top[r.cell, r["rank"] - 1] = -(-share[0] * r.score // 100), share[1] * r.score // 100
    found = first_rows(rows, Anchors(vectors, ids, labels, low, top, False, first_id), negatives, id_bits)
    spark = rows.sparkSession
    kinds = "cell long, anchor_id long, positive_id long, positive_score long"
    of = spark.createDataFrame([(r.cell * positives + r["rank"] - 1, int(ids[r.cell]), r.vec_id, r.score) for r in near], kinds)
    out = found.join(F.broadcast(of), "cell")  # the block's positives
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


OP12_SQL = """
WITH kept AS MATERIALIZED (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM kept a JOIN kept r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, row_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) QUALIFY rank <= 10
"""
