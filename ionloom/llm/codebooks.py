"""Vector code compression: product codes by weighted Lloyd over the distinct integer parts.

A vector is cut into equal consecutive parts. Equal parts at one position are one row with a weight, so that a round of Lloyd
costs the distinct parts and a vector that is there a million times costs as much as one. Each round finds the nearest entry of
every distinct part in numpy, sums parts by entry inside the task first, and moves the entries to the floor of their mean. The
codebooks hold positions x entries x width numbers, whatever the input: they alone come to the driver. In the end each
distinct part's code and error are joined back to the vectors that hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_VALUES, join_one, scratch, small, table, written
from .vectors import matrix, of_one_length, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows of parts whose distances are held at once.
BLOCK = 16_384


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the index of its nearest entry, the lowest of ties, and the squared distance; exact, in int64."""
    code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    norms = (entries * entries).sum(1)
    for a in range(0, len(parts), BLOCK):
        p = parts[a : a + BLOCK]
        off = norms - 2 * sum(p[:, j, None] * entries[None, :, j] for j in range(p.shape[1]))
        code[a : a + BLOCK] = best = off.argmin(1)
        error[a : a + BLOCK] = off[np.arange(len(p)), best] + (p * p).sum(1)
    return code, error


def moved(sums: np.ndarray, counts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Entries at the floor of the mean of their parts; unused ones where they were."""
    used = counts > 0
    out = entries.copy()
    out[used] = sums[used] // counts[used][:, None]
    return out


def _by_position(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(position, rows, parts, codes, errors) for each position in a batch of (position, part, ...)."""
    at, parts = batch.column(0).to_numpy(), matrix(batch.column(1), books.shape[2])
    for position in np.unique(at):
        rows = np.flatnonzero(at == position)
        yield int(position), rows, parts[rows], *nearest(parts[rows], books[position])


def _sums(distinct: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the weighted sum of its parts and their weight, summed in the tasks first."""
    n_parts, n_entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            weight = batch.column(2).to_numpy()
            for position, rows, parts, code, _ in _by_position(batch, books):
                np.add.at(sums[position], code, parts * weight[rows][:, None])
                np.add.at(counts[position], code, weight[rows])
        at, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(entry), pa.array(counts[at, entry]), pa.array(list(sums[at, entry]), pa.list_(pa.int64()))], names=["position", "entry", "n", "s"])

    each = distinct.mapInArrow(summed, "position long, entry long, n long, s array<long>")
    total = each.groupBy("position", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", j)).alias(f"s{j}") for j in range(width)])
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for r in total.collect():  # n_parts * n_entries rows at most
        counts[r.position, r.entry] = r.n
        sums[r.position, r.entry] = [r[f"s{j}"] for j in range(width)]
    return sums, counts


def _coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """distinct (position, part, n) with code and error."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for _, rows, _, code, error in _by_position(batch, books):
                codes[rows], errors[rows] = code, error
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes), pa.array(errors)], names=["position", "part", "n", "code", "error"])

    return distinct.mapInArrow(told, "position int, part array<int>, n long, code long, error long")


def _first_books(kept: DataFrame, n_parts: int, n_entries: int, width: int) -> np.ndarray:
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(n_entries).select("q").collect()  # n_entries rows
    q = np.array([r.q for r in first], np.int64).reshape(len(first), n_parts, width)
    return np.ascontiguousarray(q.transpose(1, 0, 2))


def books_hash(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _labelled(rows: DataFrame) -> DataFrame:
    """rows with label_error, the error summed over the rows of one label; null is a label, too."""
    rows = rows.withColumn("of_label", F.struct("label"))
    per = written(rows.groupBy("of_label").agg(F.sum("error").alias("label_error")), "label-errors")
    few = small(per)
    out = rows.join(few, "of_label") if per.count() <= BROADCAST_VALUES else join_one(rows, per, "of_label")
    return out.drop("of_label")


def compress(vectors: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector that is kept: vec_id, code, error, label_error, codebooks_sha256, label.

    Vectors that are null, or have a component that is null or not finite, are left out. code: the entries of the parts in
    order, two hexadecimal digits each; error: squared distances summed over parts; label_error: summed over all rows of the
    label, null labels together. Each position's codebook begins as that part of the first vectors by id (a null id last, equal
    ids by their components); with fewer vectors than entries it has as many entries as there are. Of entries as near the
    lowest is taken, and entries without parts stay. Repeated rows count each for itself and are all returned; empty vectors
    have empty parts and no error; an empty table gives no rows. Other columns are ignored. Vectors of different lengths, a
    length that the parts don't divide, or components of 2^17 or more are an error.
    """
    if not 0 < n_entries <= 256:
        raise ValueError("two hexadecimal digits tell 256 entries at most")
    spark = vectors.sparkSession
    with scratch(spark):
        q = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole(F.col(vector), F.col(vec_id)).alias("q")).filter("q is not null")
        kept = written(q.withColumn("row", F.monotonically_increasing_id()), "kept-vectors")
        length = of_one_length(kept)
        if length % n_parts:
            raise ValueError(f"{length} components can't be cut into {n_parts} equal parts")
        width = length // n_parts
        books = _first_books(kept, n_parts, n_entries, width)
        cut = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n_parts - 1)), lambda k: F.slice("q", k * width + 1, width) if width else F.slice("q", 1, 0)))
        parts = kept.select("row", cut.alias("position", "part"))
        distinct = written(parts.groupBy("position", "part").agg(F.count("*").alias("n")), "distinct-parts")
        for _ in range(rounds if books.size else 0):
            books = moved(*_sums(distinct, books), books)
        if books.size:
            coded = written(_coded(distinct, books), "coded-parts")
        else:
            coded = distinct.select("*", F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("error"))
        # Parts that more rows hold than a mean partition has are fewer than partitions: theirs are broadcast, all others shuffled.
        most = max(kept.count() * n_parts // int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        hot = F.broadcast(coded.filter(F.col("n") > most).select("position", "part", F.struct("code", "error").alias("found")))
        marked = parts.join(hot, ["position", "part"], "left")
        rest = marked.filter("found is null").drop("found").join(coded.filter(F.col("n") <= most), ["position", "part"]).select("row", "position", "code", "error")
        told = marked.filter("found is not null").select("row", "position", "found.code", "found.error").union(rest)
        hexes = F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda x: F.lower(F.lpad(F.hex(x["code"]), 2, "0")))
        rows = told.groupBy("row").agg(F.array_join(hexes, "").alias("code"), F.sum("error").alias("error"))  # n_parts rows a group
        named = written(kept.select("row", "vec_id", "label").join(rows, "row"), "vector-codes", outer=True)
        out = written(_labelled(named), "compressed", outer=True)
        return out.select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"), "label")


def op11_compress_codes(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, q) AS r, vec_id, label, q FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT r, p, q[p * 4 + 1] AS a, q[p * 4 + 2] AS b, q[p * 4 + 3] AS c, q[p * 4 + 4] AS d FROM kept, range(16) AS t(p)),
rows AS MATERIALIZED (SELECT p, a, b, c, d, count(*) AS n FROM parts GROUP BY ALL),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, a, b, c, d FROM parts WHERE r <= 64),
near0 AS MATERIALIZED (SELECT w.p, w.a, w.b, w.c, w.d, w.n, min({'o': (w.a - k.a)**2 + (w.b - k.b)**2 + (w.c - k.c)**2 + (w.d - k.d)**2, 'e': k.e}) AS s FROM rows w JOIN book0 k USING (p) GROUP BY ALL),
mean0 AS (SELECT p, s.e AS e, CAST(floor(sum(a * n) / sum(n)) AS BIGINT) AS a, CAST(floor(sum(b * n) / sum(n)) AS BIGINT) AS b, CAST(floor(sum(c * n) / sum(n)) AS BIGINT) AS c, CAST(floor(sum(d * n) / sum(n)) AS BIGINT) AS d FROM near0 GROUP BY ALL),
book1 AS MATERIALIZED (SELECT p, e, coalesce(m.a, k.a) AS a, coalesce(m.b, k.b) AS b, coalesce(m.c, k.c) AS c, coalesce(m.d, k.d) AS d FROM book0 k LEFT JOIN mean0 m USING (p, e)),
near1 AS MATERIALIZED (SELECT w.p, w.a, w.b, w.c, w.d, w.n, min({'o': (w.a - k.a)**2 + (w.b - k.b)**2 + (w.c - k.c)**2 + (w.d - k.d)**2, 'e': k.e}) AS s FROM rows w JOIN book1 k USING (p) GROUP BY ALL),
mean1 AS (SELECT p, s.e AS e, CAST(floor(sum(a * n) / sum(n)) AS BIGINT) AS a, CAST(floor(sum(b * n) / sum(n)) AS BIGINT) AS b, CAST(floor(sum(c * n) / sum(n)) AS BIGINT) AS c, CAST(floor(sum(d * n) / sum(n)) AS BIGINT) AS d FROM near1 GROUP BY ALL),
book2 AS MATERIALIZED (SELECT p, e, coalesce(m.a, k.a) AS a, coalesce(m.b, k.b) AS b, coalesce(m.c, k.c) AS c, coalesce(m.d, k.d) AS d FROM book1 k LEFT JOIN mean1 m USING (p, e)),
near2 AS MATERIALIZED (SELECT w.p, w.a, w.b, w.c, w.d, min({'o': (w.a - k.a)**2 + (w.b - k.b)**2 + (w.c - k.c)**2 + (w.d - k.d)**2, 'e': k.e}) AS s FROM rows w JOIN book2 k USING (p) GROUP BY ALL),
hashed AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2),
coded AS (SELECT r, string_agg(printf('%02x', s.e), '' ORDER BY p) AS code, CAST(sum(s.o) AS BIGINT) AS error FROM parts JOIN near2 USING (p, a, b, c, d) GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label FROM kept JOIN coded USING (r), hashed
"""
