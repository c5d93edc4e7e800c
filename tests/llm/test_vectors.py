"""Code compression and hard negatives against plain Python, on awkward tables too."""

import hashlib
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ionloom.llm import codebooks, negatives

SMALL = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def floors(v):
    return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]


def some_vectors(seed, n, dims=32, copies=0, levels=3):
    """Coarse vectors, so that there are ties; and copies of the first."""
    r = random.Random(seed)
    rows = [(i, [r.randint(-levels, levels) / 8 for _ in range(dims)], r.choice([0, 1, 2, None])) for i in range(n)]
    return rows + [(n + i, rows[0][1], 1) for i in range(copies)]


def odd_rows(dims):
    nan, inf = float("nan"), float("inf")
    return [(None, [0.25] * dims, 1), (500, None, 1), (501, [nan] * dims, 1), (502, [inf] + [0.0] * (dims - 1), 1), (503, [None] + [0.0] * (dims - 1), 0), (3, [0.5] * dims, 2), (3, [0.5] * dims, 2)]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted(((i, lab, q) for i, v, lab in rows if (q := floors(v)) is not None), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // parts
    cut = lambda q, p: q[p * width : (p + 1) * width]
    books = [[cut(q, p) for _, _, q in kept[:entries]] for p in range(parts)]
    best = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, _, q in kept:
                held.setdefault(best(cut(q, p), p)[1], []).append(cut(q, p))
            for k, xs in held.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, lab, q in kept:
        found = [best(cut(q, p), p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found), lab))
    total = {lab: sum(r[2] for r in out if r[3] == lab) for lab in {r[3] for r in out}}
    return sorted(((i, c, e, total[lab], sha) for i, c, e, lab in out), key=repr)


def codes(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("n,copies", [(40, 0), (150, 120)])
def test_codes_against_plain_lloyd(spark, n, copies):
    rows = some_vectors(n, n, copies=copies) + odd_rows(32)
    df = spark.createDataFrame(rows, KIND).select("*", *[F.lit("clash").alias(c) for c in ("row", "q", "position", "part", "code", "error", "n")])
    assert codes(codebooks.compress(df)) == plain_codes(rows)


def test_codes_of_few_entries_and_odd_shapes(spark):
    rows = some_vectors(5, 60, dims=8)
    assert codes(codebooks.compress(spark.createDataFrame(rows, KIND), n_parts=4, n_entries=5, rounds=3)) == plain_codes(rows, 4, 5, 3)
    assert codebooks.compress(spark.createDataFrame([], KIND)).count() == 0
    empty = codebooks.compress(spark.createDataFrame([(1, [], 0), (2, [], None)], KIND)).collect()
    assert [r.error for r in empty] == [0, 0]
    with pytest.raises(ValueError, match="components"):
        codebooks.compress(spark.createDataFrame([(1, [0.0] * 16, 0), (2, [0.0] * 32, 0)], KIND))
    with pytest.raises(ValueError, match="equal parts"):
        codebooks.compress(spark.createDataFrame([(1, [0.0] * 10, 0)], KIND))


def plain_negatives(rows, every=100, positives=5, negatives=10):
    kept = sorted({(i, lab, tuple(q)) for i, v, lab in rows if i is not None and lab is not None and (q := floors(v)) is not None})
    out = []
    for i, lab, q in kept:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, o)), j, l2) for j, l2, o in kept if j != i)
        every_other = sorted((-sum(a * b for a, b in zip(q, o)), j) for j, l2, o in kept if l2 != lab)
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            fits = [(t, k) for t, k in every_other if 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("levels,copies,block", [(3, 0, 1024), (1, 400, 3), (60, 0, 2)])
def test_negatives_against_brute_force(spark, levels, copies, block):
    rows = some_vectors(levels, 700, dims=16, copies=copies, levels=levels) + odd_rows(16)
    rows = [(i and i * 10, v, lab) for i, v, lab in rows]
    df = spark.createDataFrame(rows, KIND).select("*", *[F.lit("clash").alias(c) for c in ("cell", "rank", "score", "q", "block", "digit")]).repartition(5)
    got = mined(negatives.hard_negatives(df, every=1000, block_rows=block))
    assert got == plain_negatives(rows, every=1000) and len(got) > 50


def test_negatives_of_little(spark):
    of = lambda rows: mined(negatives.hard_negatives(spark.createDataFrame(rows, KIND)))
    assert of([]) == [] and of([(0, [1.0], 1)]) == [] and of([(0, [1.0], 1), (1, [0.5], 2)]) == []
    assert of([(0, [1.0], 1), (1, [1.0], 1), (-5, [0.5], 2), (2, [0.5], 2), (3, [0.95], 2), (4, [-1.0], 2)]) == [(0, 1, 1, -5, 65536, 32768), (0, 1, 2, 2, 65536, 32768)]


@pytest.mark.parametrize("name", ["op11_compress_codes", "op12_hard_negatives"])
def test_queries_agree_with_sql(spark, name):
    from ionloom.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    df = QUERIES[name](spark, SMALL)
    want = con.execute(f"select {', '.join(df.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want
