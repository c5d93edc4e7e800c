"""Document fingerprints by I-Match with randomised lexicons.

The lexicon holds the terms whose inverse document frequency, over all documents, lies in a band: neither so common that
every text has them nor so rare that a slip makes one. Several random subsets of the lexicon are drawn, of several sizes;
a text's fingerprint is, for each subset, the hash of the sorted distinct terms that it has of it. Two texts are as alike as
the share of subsets on which they agree. The small subsets still agree when much of a text has changed.
"""

from __future__ import annotations

import hashlib
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table
from .shingles import WORDS, mixed

#: The band: the share of all documents that have a term. At most (distinct terms of a mean text) / LEAST terms are in it.
LEAST, MOST = 0.0005, 0.1
#: The subsets' sizes, as shares of the lexicon, and how many subsets have each.
SUBSETS = ((1 / 4, 2), (1 / 16, 6), (1 / 32, 6), (1 / 64, 6), (1 / 128, 6), (1 / 256, 6), (1 / 512, 6), (1 / 1024, 6), (1 / 4096, 4))
#: Distinct terms a task counts before it passes them on.
COUNTED = 400_000
LOWEST = -(2**63)
#: ASCII capitals to small letters, ASCII punctuation to spaces.
_PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def distinct_terms(text: bytes) -> set[bytes]:
    return set(text.translate(_PLAIN).split())


def term_hashes(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct terms of a text."""
    terms = distinct_terms(text)
    return np.sort(np.fromiter(map(WORDS.__getitem__, terms), np.uint64, len(terms)))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> np.ndarray:
    """Sorted hashes of the terms in the band, from counts over all rows of docs (text: binary).

    The terms in the band number at most the mean count of distinct terms of a text over ``least``, however large docs is;
    so the array that comes to the driver is bounded.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed_on() -> pa.RecordBatch:
            terms = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in seen), np.uint64, len(seen))
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        seen: Counter[bytes] = Counter()
        for batch in pieces(batches, 0):
            for t in batch.column(0).to_pylist():
                seen.update(distinct_terms(t or b""))
            if len(seen) > COUNTED:
                yield passed_on()
                seen.clear()
        yield passed_on()

    total = docs.count()
    found = docs.select("text").mapInArrow(counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    kept = found.filter((F.col("n") >= least * total) & (F.col("n") <= max(1.0, most * total))).select("term").toArrow()
    return np.sort(kept.column(0).to_numpy().view(np.uint64))


def picked(terms: np.ndarray) -> np.ndarray:
    """Whether each term (row) is in each subset (column)."""
    shares = [share for share, n in SUBSETS for _ in range(n)]
    return np.stack([mixed(terms + np.uint64(1_000_003 * (j + 1))) < np.uint64(int(share * 2**64)) for j, share in enumerate(shares)], axis=1)


class Fingerprints:
    """Fingerprints of texts over one lexicon."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.picks = picked(terms)

    def of(self, text: bytes) -> list[str]:
        """A hash for each subset, "" for one of which the text has no term.

        A text without a term in the lexicon is told by all its terms, with the same subsets, and one without any term
        in a subset by its whole hash.
        """
        terms = term_hashes(text)
        at = np.searchsorted(self.terms, terms)
        known = at < len(self.terms)
        known[known] = self.terms[at[known]] == terms[known]
        if known.any():
            terms, picks = terms[known], self.picks[at[known]]
        else:
            picks = picked(terms)
        subset, term = np.nonzero(picks.T)
        if not len(term):
            return ["t" + xxhash.xxh3_64_hexdigest(text)]
        held = terms[term].tobytes()
        ends = (np.searchsorted(subset, np.arange(picks.shape[1] + 1)) * 8).tolist()
        return [xxhash.xxh3_64_hexdigest(held[a:b])[:8] if a < b else "" for a, b in zip(ends, ends[1:])]


def likeness(a: list[str], b: list[str]) -> float:
    """The share of subsets on which two fingerprints agree, of those of which either text has a term; 1 for equal ones."""
    if a == b:
        return 1.0
    if len(a) != len(b):
        return 0.0
    either = sum(bool(x or y) for x, y in zip(a, b))
    return sum(bool(x) and x == y for x, y in zip(a, b)) / either if either else 0.0


def with_next(docs: DataFrame, partitions: int) -> DataFrame:
    """(part, tail, doc_id, order_id, packed text), dealt so that each part holds a run of descending ids and, as tail, the row after it.

    Ids cut the table into as many parts; a part's first id is also sent to the part before it, and the greatest to the last.
    """
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"))
    cuts, top = ids.agg(F.percentile_approx("k", [i / partitions for i in range(1, partitions)], 10_000), F.max("k")).first()
    tops = np.array(sorted({*(cuts or []), *([top] if top is not None else [])}), np.int64)  # of each part, its greatest id

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, 1):
            keys = np.array([LOWEST if k is None else k for k in batch.column(0).to_pylist()], np.int64)
            # tops[i - 1] < key <= tops[i]; parts count from the greatest ids on
            place = np.searchsorted(tops, keys, side="left")
            part = len(tops) - 1 - place
            starts_part = tops[place] == keys
            texts = pa.array([press.compress(t or b"") for t in batch.column(1).to_pylist()], pa.binary())
            before = np.where(part == 0, len(tops) - 1, part - 1)[starts_part]
            again = pa.array(np.flatnonzero(starts_part))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.zeros(len(keys), bool)), batch.column(0), pa.array(keys), texts], names=["part", "tail", "doc_id", "k", "packed"])
            yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array(np.ones(len(before), bool)), batch.column(0).take(again), pa.array(keys[starts_part]), texts.take(again)], names=["part", "tail", "doc_id", "k", "packed"])

    rows = docs.mapInArrow(packed, "part int, tail boolean, doc_id long, k long, packed binary")
    return rows.repartition(partitions, "part").sortWithinPartitions("part", "tail", F.desc("k"), "packed")


def fingerprints(docs: DataFrame, least: float = LEAST, most: float = MOST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next row in
    descending id; after the last comes the first, so a single row is its own next. Null texts count as empty, null ids as
    the smallest; rows with one id follow each other in the order of their packed texts. Equal texts have equal
    fingerprints; a text without a term in the band is told by all its terms. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    terms = spark.sparkContext.broadcast(lexicon(docs, least, most))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, press, last = Fingerprints(terms.value), zstandard.ZstdDecompressor(), None
        for batch in pieces(batches, 4):
            out = []
            for part, tail, key, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if tail and (last is None or last[0] != part):
                    continue  # only the first row of the next part counts
                raw = press.decompress(packed)
                own = (part, key, raw.decode("utf-8"), prints.of(raw))
                if last is not None and last[0] == part:
                    out.append(compared(last, own, prints))
                last = None if tail else own
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def compared(row: tuple, after: tuple, prints: Fingerprints) -> tuple:
        _, key, words, own = row
        half = len(words) // 2
        edited = (words[: len(words) - half] + after[2][:half]).encode("utf-8")
        theirs = prints.of(edited)
        return key, len(words), hashlib.sha256(edited).hexdigest(), ".".join(own), ".".join(theirs), likeness(own, theirs), likeness(own, after[3])

    partitions = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return with_next(docs, partitions).mapInArrow(told, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_imatch_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
