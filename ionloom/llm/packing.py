"""Packing documents into sequences of so many tokens: bulk-synchronous best fit.

Documents become token ids, by the vocabulary's own library, and pieces of a sequence's length at most. Pieces are packed in
waves, the longest first: a wave holds the lengths above half of its top, the last one the rest. In a wave, pieces and the gaps
of open sequences are range-sorted together by size, and a sweep finds for every piece the smallest gap that holds it. In that
order a piece's successor is the first gap behind it. Pieces above half a sequence have one each, and as many as the tokens
fill are open from the start. Pieces with one successor conflict: they are ranked, and each takes the
next gap that no earlier piece takes, so piece i takes gap i + max over k <= i of (gaps before piece k - k). That takes running
counts and a running maximum inside a range, and as many numbers a range to link the ranges: nothing passes through one task.
A gap that holds several pieces of the wave stands for as many. Then gaps shrink by what they took, and the sweep is repeated;
when few pieces find a gap, new sequences are opened for the rest of the wave.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, scratch, table, written
from .tokens import byte_symbols

CAPACITY, END = 4096, 1
#: Pieces of the last wave are no longer than this part of a sequence; the share of a wave's pieces that a sweep must place to be repeated before sequences are opened.
SMALLEST, WORTH = 1 / 32, 0.2
#: Words whose ids a worker remembers, twice as many in all, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 250_000, 40
#: Separators that Python splits at and vocabularies don't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """word -> its ids as little-endian bytes. For vocabularies that drop white space, a text's ids are those of its words in a row.

    The library's model tells the ids of each run of characters. What comes before it, composing, lower case and the cut into
    runs, is done here by the vocabulary's own settings, since that is most of the library's time; words with a mark that may
    begin a special token, and vocabularies with other settings, go through the library as a whole.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model, self.former = self.library.model, {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps, cuts = _steps(spec.get("normalizer"), "normalizers"), _steps(spec.get("pre_tokenizer"), "pretokenizers")
        known = [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
        known = known and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " " and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
        known = known and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and spec["model"]["type"] == "BPE"
        self.cut = regex.compile(cuts[0]["pattern"]["Regex"]) if known else None
        self.marks = {t["content"][0] for t in spec.get("added_tokens", [])}
        self.symbols = byte_symbols()

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids_of(self, word: str) -> bytes:
        """The ids of a word that isn't remembered."""
        if self.cut is None or not self.marks.isdisjoint(word):
            return self.encode(word)
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        word = word.lower() if "Σ" not in word else "".join(map(str.lower, word))  # no final form
        found = []
        for run in [word] if word.isalpha() else self.cut.findall(word):
            found += [t.id for t in self.model.tokenize(run if run.isascii() else "".join([self.symbols[b] for b in run.encode()]))]
        return array("I", found).tobytes()

    def __missing__(self, word: str) -> bytes:
        found = self.former.get(word)
        if found is None:
            found = self.ids_of(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:  # what was met lately stays for one more turn
                self.former = dict(self)
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        return self.encode(text) if _ODD_SPACE.search(text) else b"".join(map(self.__getitem__, text.split()))


def _steps(spec: dict | None, name: str) -> list[dict]:
    return [] if spec is None else spec[name] if spec["type"] == "Sequence" else [spec]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each vocabulary in each Python worker; it must drop white space."""
    if path not in _WORDS:
        found = WordIds(path)
        if found.encode("a  b\n") != found.encode("a") + found.encode("b"):
            raise ValueError(f"{path} keeps white space")
        _WORDS[path] = found
    return _WORDS[path]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, in pieces of ``capacity`` ids, the last one shorter."""
    path, last = vocabulary or default_vocabulary(), np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in pieces(batches, 1):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ids = words.ids(t or "") + last
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (size, gap, id, ...) -> (part, gap, id, size, at, ahead): of a gap its rank in the range; of a piece its rank, and the most gaps that stand before it or an earlier piece, less that one's rank."""
    part, gaps, items, most = TaskContext.get().partitionId(), 0, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        gap = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        gaps_before, items_before = gaps + gap.cumsum() - gap, items + (1 - gap).cumsum() - (1 - gap)
        off = np.where(gap == 1, np.iinfo(np.int64).min, gaps_before - items_before)
        ahead = np.maximum.accumulate(off if most is None else np.maximum(off, most))
        gaps, items, most = gaps + int(gap.sum()), items + int((1 - gap).sum()), ahead[-1]
        at = np.where(gap == 1, gaps_before, items_before)
        named = pa.array(ahead, mask=(ahead == np.iinfo(np.int64).min))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gap), part)), pa.array(gap), batch.column(2), batch.column(0), pa.array(at), named], names=["part", "gap", "id", "size", "at", "ahead"])


def sweep(left: DataFrame, slots: DataFrame) -> DataFrame:
    """left (id, size) and slots (id, size, room) -> (id, size, bin): each piece with the slot it takes, or null; ascending best fit.

    Smaller pieces come first, and of slots of one size those with less room. A slot takes one piece at most.
    """
    rows = left.select("size", F.lit(0).alias("gap"), "id", F.lit(0).cast("long").alias("room")).union(slots.select("size", F.lit(1).alias("gap"), "id", "room"))
    order = ["size", "gap", "room", "id"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_swept, "part long, gap long, id long, size long, at long, ahead long")
    ranged = written(ranged, "sweep")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    parts = ranged.groupBy("part").agg(F.sum("gap").alias("gaps"), F.sum(1 - F.col("gap")).alias("items"), F.max("ahead").alias("ahead"))
    parts = parts.select("part", "ahead", F.coalesce(F.sum("gaps").over(before), F.lit(0)).alias("gaps"), F.coalesce(F.sum("items").over(before), F.lit(0)).alias("items"))
    parts = parts.select("part", "gaps", "items", F.max(F.col("ahead") + F.col("gaps") - F.col("items")).over(before).alias("earlier"))
    placed = ranged.join(F.broadcast(parts), "part")
    taken = F.col("items") + F.col("at") + F.greatest(F.col("earlier"), F.col("ahead") + F.col("gaps") - F.col("items"))
    of_piece = placed.filter("gap = 0").select("id", "size", taken.alias("slot"))
    of_slot = placed.filter("gap = 1").select((F.col("gaps") + F.col("at")).alias("slot"), F.col("id").alias("bin"))
    return written(of_piece.join(of_slot, "slot", "left").select("id", "size", "bin"), "placed")


def _slots(open_bins: DataFrame, low: int, high: int, n: int) -> DataFrame | None:
    """The slots that a wave's n pieces (over low, up to high) may take: a bin's room in pieces of the wave; bins with the least room first, where it doesn't matter."""
    rooms = sorted((r.room, r["count"]) for r in open_bins.filter(F.col("room") > low).groupBy("room").count().collect())  # capacity rows at most
    if not rooms:
        return None
    enough, most = 0, rooms[-1][0]
    for room, count in rooms:
        enough += room // high * count
        if enough >= n:
            most = room
            break
    few = open_bins.filter((F.col("room") > low) & (F.col("room") <= most))
    times = F.greatest(F.lit(1), F.floor(F.col("room") / high)).cast("int")
    return few.select("id", F.least("room", F.lit(high)).cast("long").alias("size"), "room", F.explode(F.array_repeat(F.lit(0), times))).select("id", "size", "room")


def packed_bins(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (id, size; unique ids from 0 on, sizes from 1 to capacity; cheap to read) -> (id, bin): no bin holds more than the capacity."""
    spark = items.sparkSession
    n_large, total = items.agg(F.count(F.when(F.col("size") > capacity // 2, 1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # No two pieces above half a sequence share one: each has its own. As many as all tokens fill are needed in any case.
    large = items.filter(F.col("size") > capacity // 2)
    out = large.select("id", F.col("id").alias("bin"))
    opened = max(0, -(-total // capacity) - n_large)
    empty = lambda a, b: spark.range(a, b).select((-1 - F.col("id")).alias("id"), F.lit(capacity).cast("long").alias("room"))
    bins = large.select("id", (capacity - F.col("size")).alias("room")).filter("room > 0").union(empty(0, opened))
    high = capacity // 2
    while high:
        low = high // 2 if high > SMALLEST * capacity else 0
        left = items.filter((F.col("size") > low) & (F.col("size") <= high))
        n, total = left.agg(F.count("*"), F.sum("size")).first()
        worth = True
        while n:
            slots = _slots(bins, low, high, n) if worth else None
            if slots is None:
                new = math.ceil(n / max(1, capacity * n // total))
                bins, opened, worth = bins.union(empty(opened, opened + new)), opened + new, True
                continue
            found = sweep(left, slots)
            placed = found.filter("bin is not null")
            took = placed.groupBy(F.col("bin").alias("id")).agg(F.sum("size").alias("took"))
            room = (F.col("room") - F.coalesce("took", F.lit(0))).alias("room")
            bins = written(bins.join(took, "id", "left").select("id", room).filter("room > 0"), "bins")
            out, left, before = out.union(placed.select("id", "bin")), found.filter("bin is null").select("id", "size"), n
            n, total = left.agg(F.count("*"), F.sum("size")).first()
            worth = before - n >= WORTH * before
        high = low
    return out


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A row's ids are its text's and the end id; a null or empty text has the end id alone. Rows longer than a sequence are cut
    into pieces of its length, the last one shorter; no others are. ids_crc32 is that of the ids as unsigned 32-bit
    little-endian numbers. In a sequence the pieces lie end to end from 0 on, the longest first. Repeated rows and null ids are
    packed each for itself; an empty table gives no rows; other columns are ignored. ``vocabulary`` is a file that every
    executor can read, of a tokenizer that drops white space.
    """
    with scratch(docs.sparkSession):
        cut = written(token_pieces(docs, vocabulary, capacity, end, doc_id, text).withColumn("id", F.monotonically_increasing_id()), "pieces")
        bins = packed_bins(cut.select("id", F.col("length").alias("size")), capacity)
        inside = Window.partitionBy("bin").orderBy(F.desc("length"), "id").rowsBetween(Window.unboundedPreceding, -1)  # capacity rows at most
        offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
        out = cut.join(bins, "id").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), offset)
        return written(out, "packed", outer=True)


def op13_pack_sequences(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
