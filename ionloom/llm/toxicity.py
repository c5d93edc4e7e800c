"""Toxicity by compression distance: windows of a text are compressed against an ordinary and a toxic zstandard dictionary.

Both dictionaries are trained by zstandard. The ordinary one is trained on windows of texts that are labelled as not toxic. The
toxic one holds what is trained on toxic texts, and behind it the same ordinary content: at the same distance from what is
compressed, so that an ordinary window takes as many bytes with either. Runs of words that are ordinary one by one are found
better where they stand nearest; the other order is tried, too, and the fit takes the better one. Most of a toxic text is ordinary too, and a dictionary
trained on all of it tells little (figures in the README). So it is trained on what toxic texts have of the segments (words,
their beginnings and runs of up to three) by which the labels tell them from others: whole words, and nothing that stands
around them. The trainer has room for all of them, and leaves out some; these are added. Each window that is compared stands
between a fixed lead and tail that both dictionaries hold: blocks are then never stored raw, and the compressor looks for
matches up to the window's end.

Segments are ranked by how the labels tell them apart, and no size of the sample is needed for one to count: how many are
taken, how far the lengths must differ, and on how many windows, is fitted on labelled texts that the dictionaries of their
fold have not seen.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table
from .shingles import PLACES, WORDS, mixed, shingle_set

#: Words of a window, and the most bytes of one.
WINDOW, WINDOW_BYTES = 16, 400
#: Bytes of the ordinary dictionary, and of the toxic one for each segment; the compression level, and how many places are compared for a match (as a power of two).
ORDINARY_BYTES, SEGMENT_BYTES, LEVEL, SEARCHED = 16_384, 64, 6, 4
#: The trainer's k and d, for the toxic dictionary.
TRAINER = {"k": 16, "d": 6}
#: Labelled documents that are learnt from, of each label at most, and bytes of all their texts.
SAMPLE_OF_EACH, SAMPLE_BYTES = 2_000, 64_000_000
#: Words of a segment at most; bytes of a word's beginning at least; the numbers of segments that are tried; folds of the fit; windows that train the ordinary dictionary.
SEGMENT, STEM, TRIED, FOLDS, TRAINED_ON = 3, 5, (4, 6, 8, 10, 12, 15, 20, 28, 40, 56, 80, 110, 150, 200, 280, 400), 4, 40_000
#: How much commoner a segment is in toxic rows than in others, at least.
COMMONER = 2
#: Of a text's runs of words, the smallest hashes, by which edited copies are told.
SKETCH = 16
LEAD, TAIL = b" the lead that every window follows here, in both of the two ", b" and then the tail, in both"
#: The size for which compressors are set up, one for both dictionaries.
CONTENT_BYTES = ORDINARY_BYTES + SEGMENT_BYTES * TRIED[-1]
_EDGES = b".,;:!?\"'()[]{}#$%&*|"


def windows(text: str | None) -> list[bytes]:
    """A text, lowered, in runs of WINDOW words; a run of many bytes is cut."""
    words = (text or "").lower().encode("utf-8").split()
    out = []
    for i in range(0, len(words), WINDOW):
        run = b" ".join(words[i : i + WINDOW])
        out += [run] if len(run) <= WINDOW_BYTES else [run[j : j + WINDOW_BYTES] for j in range(0, len(run), WINDOW_BYTES)]
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    content = content + TAIL + LEAD
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plan = zstandard.ZstdCompressionParameters.from_level(LEVEL, search_log=SEARCHED, source_size=256, dict_size=CONTENT_BYTES, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held.precompute_compress(compression_params=plan)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=plan)


#: Words whose beginnings are remembered.
STEMS_KEPT = 10_000


class Stems(dict):
    """word -> its beginnings of STEM bytes and more, marked by a star, remembered while there is room."""

    def __missing__(self, word: bytes) -> list[bytes]:
        if len(self) >= STEMS_KEPT:
            self.clear()
        self[word] = found = [word[:i] + b"*" for i in range(STEM, min(len(word), 24))]
        return found


STEMS = Stems()


def _split(text: str) -> tuple[list[bytes], list[bytes]]:
    """The words of a text, lowered and without punctuation at their ends, and the distinct beginnings of them."""
    words = [w for w in (x.strip(_EDGES) for x in text.lower().encode("utf-8").split()) if w]
    return words, list({s for w in words for s in STEMS[w]})


def _hashes(words: list[bytes], stems: list[bytes]) -> np.ndarray:
    ids = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    runs = [sum((ids[j : len(ids) - n + 1 + j] * PLACES[j] for j in range(n)), np.zeros(1, np.uint64)) + np.uint64(n) for n in range(1, SEGMENT + 1) if len(ids) >= n]
    return mixed(np.concatenate([*runs, np.fromiter(map(WORDS.__getitem__, stems), np.uint64, len(stems))]))


def gram_hashes(text: str) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of 1 to SEGMENT words and of the beginnings of its words."""
    found = _hashes(*_split(text))
    found.sort()
    return found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found


def named_grams(text: str, wanted: np.ndarray) -> Iterator[tuple[int, tuple[bytes, ...]]]:
    """Those of a text's grams whose hashes are wanted, with their hashes."""
    words, stems = _split(text)
    hashes, at = _hashes(words, stems), 0
    for n in range(1, SEGMENT + 1):
        if len(words) >= n:
            for i in np.flatnonzero(np.isin(hashes[at : at + len(words) - n + 1], wanted)):
                yield int(hashes[at + i]), tuple(words[i : i + n])
            at += len(words) - n + 1
    for i in np.flatnonzero(np.isin(hashes[at:], wanted)):
        yield int(hashes[at + i]), (stems[i],)


def taught_once(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The rows without those that are copies, or edited ones, of a row before them with the same label.

    Else what a single text and its copies have in common would seem to mark a label, and in the copies to prove it.
    """
    kept, holders = [], {}
    for text, label in dict.fromkeys(rows):
        sketch = np.unique(shingle_set(text.encode("utf-8"), SEGMENT))[:SKETCH].tolist()
        met = Counter(i for h in sketch for i in holders.get((h, label), ()))
        if sketch and any(2 * n >= len(sketch) for n in met.values()):
            continue
        for h in sketch:
            holders.setdefault((h, label), []).append(len(kept))
        kept.append((text, label))
    return kept


def _fits(k: np.ndarray, n: int, p: np.ndarray) -> np.ndarray:
    """The log-likelihood of k of n at a probability p."""
    return k * np.log(np.where(k > 0, p, 1.0)) + (n - k) * np.log(np.where(n > k, 1 - p, 1.0))


def segments(rows: list[tuple[str, int]], fold: np.ndarray) -> list[list[bytes]]:
    """Of (text, toxic) rows, the segments of toxic ones, those whose presence stands out most first: for each fold from the other rows, and at last from all.

    The order is that of the log-likelihood ratio of what is at least COMMONER times as common in toxic rows. One that contains a segment before it is
    left out, and so are a beginning of one before it and one of a single toxic row.
    """
    toxic = [gram_hashes(t) if y else None for t, y in rows]
    known = np.concatenate([np.zeros(0, np.uint64), *(h for h in toxic if h is not None)])
    known.sort()
    known = known[1:][known[1:] == known[:-1]]  # what several toxic rows have
    known = known[np.r_[True, known[1:] != known[:-1]]] if len(known) else known
    count, size = np.zeros((2, FOLDS, len(known)), np.int32), np.zeros((2, FOLDS), int)
    for i, ((t, y), f) in enumerate(zip(rows, fold)):
        h = gram_hashes(t) if toxic[i] is None else toxic[i]
        at = np.searchsorted(known, h)
        at = at[at < len(known)]
        size[y, f] += 1
        count[y, f, at[known[at] == h[: len(at)]]] += 1
        toxic[i] = None
    tops = []
    for left_out in [*range(FOLDS), None]:
        keep = [f for f in range(FOLDS) if f != left_out]
        (j, k), (no, nt) = count[:, keep].sum(axis=1), size[:, keep].sum(axis=1).tolist()
        if not (no and nt):
            tops.append({})
            continue
        both = (k + j) / (nt + no)
        ratio = np.where((k > 1) & (k * no > COMMONER * j * nt), _fits(k, nt, k / nt) + _fits(j, no, j / no) - _fits(k, nt, both) - _fits(j, no, both), 0.0)
        best = np.argsort(-ratio, kind="stable")[: 8 * TRIED[-1]]
        tops.append({h: r for h, r in zip(known[best].tolist(), ratio[best].tolist()) if r > 0})
    wanted, names = np.array(sorted(set().union(*tops)), np.uint64), {}
    for t, y in rows:
        if y:
            names.update(named_grams(t, wanted))
    out = []
    for top in tops:
        taken: dict[tuple[bytes, ...], None] = {}
        stemmed: set[bytes] = set()
        for w in sorted((names[h] for h in top), key=lambda w, r={names[h]: r for h, r in top.items()}: (-r[w], -len(w), w[0].endswith(b"*"), -len(w[0]), w)):
            parts = {w[i : i + m] for m in range(1, len(w)) for i in range(len(w) - m + 1)} | {(s,) for x in w for s in STEMS[x.rstrip(b"*")]}
            if not parts & taken.keys() and not (w[0].endswith(b"*") and w[0] in stemmed):
                taken[w] = None
                stemmed.update([w[0].rstrip(b"*") + b"*", *STEMS[w[0].rstrip(b"*")]])
        out.append([b" " + (x[:-1] if (x := b" ".join(w)).endswith(b"*") else x + b" ") for w in list(taken)[: TRIED[-1]]])
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def lengths(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return compressor(self.ordinary), compressor(self.toxic)

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights, -50, 50))))


def lengths_of(cut: list[bytes], by: zstandard.ZstdCompressor) -> np.ndarray:
    """The compressed lengths of windows."""
    return np.array([len(by.compress(LEAD + w + TAIL)) for w in cut], np.int64)


def features_of(gains: np.ndarray) -> np.ndarray:
    """What the windows' gains say of a text: the two largest, how many exceed what ordinary ones reach, and all of it a window."""
    top = np.sort(np.r_[gains, 0, 0])[::-1] if len(gains) < 2 else -np.partition(-gains, 1)
    high, excess = (gains >= 4).sum(), np.maximum(0, gains - 1).sum()
    return np.array([1.0, np.clip(top[0], 0, 12), np.clip(top[1], 0, 12), math.log1p(high), math.log1p(len(gains)), 10 * excess / max(1, len(gains))])


def features(text: str | None, by: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> np.ndarray:
    cut = windows(text)
    return features_of(lengths_of(cut, by[0]) - lengths_of(cut, by[1]))


def calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic fit by Newton's method; w: the rows' weights."""
    beta, keep = np.zeros(x.shape[1]), np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (w * (y - p)) - keep @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def ordinary_content(texts: list[str]) -> bytes:
    """The content of a zstandard dictionary trained on the windows of texts."""
    plain = [w for t in texts for w in windows(t)]
    plain = plain[:: max(1, len(plain) // TRAINED_ON)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, plain).as_bytes()[-ORDINARY_BYTES:]
    except zstandard.ZstdError:  # too little text to train on
        return b" ".join(plain)[-ORDINARY_BYTES:]


def segments_in(texts: list[str], found: list[bytes]) -> list[tuple[int, bytes]]:
    """What texts have of the segments, each with the segment's place among them: runs of words, and the whole word for a beginning."""
    begins, runs = {}, {}
    for i, w in reversed(list(enumerate(found))):
        if w.endswith(b" "):
            first, *rest = w.split()
            runs.setdefault(first, []).append((i, rest, w))
        else:
            begins[w[1:] + b"*"] = i
    marked: dict[bytes, int | None] = {}
    out = []
    for t in texts:
        words = _split(t)[0]
        for at, w in enumerate(words):
            if w not in marked:
                marked[w] = min((begins[s] for s in STEMS[w] if s in begins), default=None)
            if marked[w] is not None:
                out.append((marked[w], b" " + w + b" "))
            out += [(i, run) for i, rest, run in runs.get(w, ()) if words[at + 1 : at + 1 + len(rest)] == rest]
    return out


def toxic_content(ordinary: bytes, found: list[bytes], seen: list[tuple[int, bytes]], n: int, last: bool = False) -> bytes:
    """What a dictionary trained on what texts have of the first n segments holds, and the ordinary content behind it, or before it.

    Segments that the trainer left out, as it does with short ones and where texts are few, are added.
    """
    found, size = found[:n], SEGMENT_BYTES * min(n, len(found))
    try:
        # The trained content is the end of what comes, behind the tables.
        body = zstandard.train_dictionary(256 + size, [w for i, w in seen if i < n and len(w) >= 8], **TRAINER).as_bytes()[-size:] if size else b""
    except zstandard.ZstdError:
        body = b""
    added = b"".join(w for w in reversed(found) if w not in body)
    return ordinary + body + added if last else added + body + ordinary


def _error(x: np.ndarray) -> float:
    """The standard error of a sum over rows."""
    return float(x.std() * math.sqrt(len(x)))


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """From (text, toxic) rows, in an order that says nothing; share: of toxic ones among all labelled documents."""
    rows = taught_once(rows)
    y = np.array([label for _, label in rows], int)
    if len(set(y.tolist())) < 2:
        content = ordinary_content([t for t, label in rows if not label])
        return Model(content, content, np.array([3.0 if y.any() else -3.0, 0, 0, 0, 0, 0]))
    fold = np.where(y == 1, np.cumsum(y) - 1, np.cumsum(1 - y) - 1) % FOLDS
    found = segments(rows, fold)
    seen = [segments_in([t for (t, label), f in zip(rows, fold) if label and f != k], s) for k, s in zip([*range(FOLDS), None], found)]
    contents = [ordinary_content([t for (t, label), f in zip(rows, fold) if not label and f != left_out]) for left_out in [*range(FOLDS), None]]
    w = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    tried, cuts = [], [windows(t) for t, _ in rows]
    plain = [compressor(c) for c in contents]
    plain = [lengths_of(cut, plain[f]) for cut, f in zip(cuts, fold)]

    def attempt(n: int, last: bool) -> None:
        toxic = [compressor(toxic_content(c, s, x, n, last)) for c, s, x in zip(contents, found, seen)]
        x = np.stack([features_of(p - lengths_of(cut, toxic[f])) for cut, p, f in zip(cuts, plain, fold)])
        weights = calibrated(x, y, w)
        logit = np.clip(x @ weights, -30, 30)
        tried.append((w * (y * logit - np.log1p(np.exp(logit))), n, last, weights))

    for n in TRIED:
        attempt(n, False)
        best = max(tried, key=lambda t: t[0].sum())
        if n >= max(map(len, found)) or (best[0] - tried[-1][0]).sum() > 3 * _error(best[0] - tried[-1][0]):
            break
    attempt(best[1], True)
    _, n, last, weights = max(tried, key=lambda t: t[0].sum())
    return Model(contents[-1], toxic_content(contents[-1], found[-1], seen[-1], n, last), weights)


def learnt(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_OF_EACH, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """docs (doc_id, text) and labels (doc_id, toxic 0 or 1) to a model, from a sample drawn by a hash of the id.

    The sample is bounded: so many documents of each label, and no more bytes of texts. Of an id with several labels the
    highest counts, for every text of that id; rows without id, text or label teach nothing, and repeated rows teach once.
    Without labels, or with one label only, every text gets the same verdict. Either table may be empty.
    """
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model(b"", b"", np.array([-3.0, 0, 0, 0, 0, 0]))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000
    limit = F.when(F.col("toxic") == 1, per_label / max(1, counts.get(1, 0))).otherwise(per_label / max(1, counts.get(0, 0)))
    drawn = F.broadcast(labels.withColumn("draw", draw / limit).filter("draw < 1"))  # 2 * per_label rows at most, but for chance
    texts = docs.filter("text is not null").join(drawn, "doc_id").select("doc_id", "text", "toxic", "draw")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = texts.filter(F.col("draw") < min(1.0, sample_bytes / max(1, size))).select("doc_id", "text", "toxic")
    share = counts.get(1, 0) / sum(counts.values())

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(t, int(y)) for _, t, y in rows], share))], pa.binary())], names=["model"])

    # The sample is bounded, so one task holds it; the driver gets the model only.
    got = sample.repartition(1).mapInArrow(fitted, "model binary").first()
    return fit([], share) if got is None else pickle.loads(got.model)


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the columns in ``keep``, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts have no window and get the score of a text without any gain. Every word of a long text is in a
    window. Repeated rows get the same score; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    out = docs.select(F.col(doc_id).alias("doc_id"), *keep, F.col(text).cast("string").alias("text"))
    head = [f for f in out.schema.fields if f.name != "text" or f.name in keep][: 1 + len(keep)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value.lengths()
        for batch in pieces(batches, len(head)):
            scores = [shared.value.score(features(t, by)) for t in batch.column(len(head)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(head)], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[*(f.name for f in head), "score", "predicted"])

    return out.mapInArrow(scored, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head) + ", score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model does not predict to be toxic, with all their columns; null and empty texts stay.

    A row is judged by its text alone, so repeated rows go or stay together, whatever their ids. An empty table stays empty.
    """
    spark = docs.sparkSession
    shared, place = spark.sparkContext.broadcast(model), docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = shared.value.lengths()
        for batch in pieces(batches, place):
            texts = batch.column(place).to_pylist()
            yield batch.filter(pa.array([not t or shared.value.score(features(t, by)) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    return score_toxicity(docs, learnt(docs.select("doc_id", "text"), labels), keep=("held_out",))
