"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams are hashed into a fixed number of features. Their document frequencies are counted over every learnable
document. The weights are learnt by follow-the-regularised-leader with an elastic-net penalty, which leaves most of them at
nought, from a bounded sample of each language; a part of the sample is kept back to fit the temperature of the scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table

#: Features, and the lengths of the n-grams hashed into them.
FEATURES, LENGTHS = 1 << 16, (1, 2, 3)
#: Documents the weights are learnt from: so many of a language, and so many of all together.
SAMPLE_OF_EACH, SAMPLE = 800, 6_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.5
UNKNOWN = "und"


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and how often it has each; letters are lowered and white space is one space."""
    codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams, found = codes * np.uint64(0x9E3779B97F4A7C15), []
    for n in range(1, max(LENGTHS) + 1):
        if n > 1:
            if len(codes) < n:
                break
            grams = (grams[:-1] ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) + codes[n - 1 :] * np.uint64(0x94D049BB133111EB)
        if n in LENGTHS:
            found.append((grams >> np.uint64(48)).astype(np.int64) % FEATURES)
    counts = np.bincount(np.concatenate(found), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(at, counts) @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*counted(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def follow_leader(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], rng: np.random.Generator) -> None:
    """Learns model.weights from (features, counts, language), one document at a time."""
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)

    def weights(at: np.ndarray) -> np.ndarray:
        small = np.abs(z[at]) <= L1
        return np.where(small, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            at, counts, language = rows[r]
            x, w = model.vector(at, counts), weights(at)
            p = softmax(x @ w)
            p[language] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    model.weights = weights(np.arange(len(z)))


def fit_temperature(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """The temperature with the least log loss on rows kept back, by golden-section search over its logarithm."""
    if not rows:
        return 1.0
    logits = np.stack([model.logits(at, counts) for at, counts, _ in rows])
    right = np.array([r[2] for r in rows])

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(right)), right]))

    low, high, part = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - part * (high - low), low + part * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(learn: DataFrame) -> Model:
    """From (text, lang), both not null: frequencies from every row, weights from the bounded sample."""
    spark = learn.sparkSession

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, rows = np.zeros(FEATURES, np.int64), 0
        for batch in pieces(batches, 0):
            for t in batch.column(0).to_pylist():
                if any(map(str.isalpha, t)):
                    have[counted(t)[0]] += 1
                    rows += 1
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[have[at], rows])], names=["feature", "n"])

    sums = learn.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    seen = dict(zip(sums.column(0).to_pylist(), sums.column(1).to_pylist()))
    total = seen.pop(-1, 0)
    idf = np.zeros(FEATURES)
    idf[list(seen)] = np.log((1 + total) / (1 + np.array(list(seen.values()), float))) + 1

    each = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    languages = list(each)
    model = Model(languages, idf, np.zeros((FEATURES, len(languages))))
    if len(languages) < 2:
        return model
    wanted = min(SAMPLE_OF_EACH, SAMPLE // len(languages) + 1)
    share = F.create_map(*[F.lit(x) for lang, n in each.items() for x in (lang, min(1.0, wanted / n))])[F.col("lang")]
    place = F.create_map(*[F.lit(x) for i, lang in enumerate(languages) for x in (lang, i)])[F.col("lang")]
    drawn = learn.filter(F.pmod(F.xxhash64("text", "draw"), F.lit(1_000_000)) < share * 1_000_000).select("text", place.alias("lang"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            rows = [(*counted(t), lang) for t, lang in zip(*(c.to_pylist() for c in batch.columns)) if any(map(str.isalpha, t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.int32())], names=["at", "counts", "lang"])

    got = drawn.mapInArrow(vectors, "at array<int>, counts array<int>, lang int").toArrow().combine_chunks()
    rows = [(got["at"][i].values.to_numpy(), got["counts"][i].values.to_numpy(), got["lang"][i].as_py()) for i in range(got.num_rows)]
    rows.sort(key=lambda r: (r[2], len(r[0]), r[0].tobytes(), r[1].tobytes()))
    rng = np.random.default_rng(9)
    back = rng.random(len(rows)) < 0.2
    follow_leader(model, [r for r, kept in zip(rows, back) if not kept], rng)
    model.temperature = fit_temperature(model, [r for r, kept in zip(rows, back) if kept])
    return model


def identify(docs: DataFrame, learn: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the columns in ``keep``, lang_pred, score.

    ``learn`` has text, lang and draw (any column that tells rows apart; it only decides the sample). Rows with a null text
    or language teach nothing. A text that is null or has no letter is ``und`` with score 0, as is every text when nothing
    can be learnt; with one language, every other text is that, with score 1. Repeated rows get the same answer; other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(learn.filter("text is not null and lang is not null").select("text", "lang", "draw")))
    out = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).cast("string").alias("text"))
    head = [f for f in out.schema.fields if f.name != "text"]

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(head)):
            found = [model.value.predict(t) for t in batch.column(len(head)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(head)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*(f.name for f in head), "lang_pred", "score"])

    return out.mapInArrow(predicted, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head) + ", lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    learn = docs.filter("not held_out").select("text", "lang", F.col("doc_id").alias("draw"))
    return identify(docs, learn, keep=("held_out",))
