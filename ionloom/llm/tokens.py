"""Token counts by byte-pair merging: a heap of adjacent pairs over a linked list of symbols.

No identifiers are emitted: a text has as many tokens as it has initial symbols (bytes) less the merges made, and one more
for each special string inside it, as the vocabulary's library counts by default.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table

#: Fixed value: the split of byte-level vocabularies before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose count a worker remembers, and the longest that it does.
REMEMBERED, REMEMBERED_CHARS = 400_000, 40
OVER = 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairMerger(dict):
    """word -> its number of tokens; a dict, so that words seen before cost one lookup."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is no byte-level BPE vocabulary")
        self.prefix = bool(spec["pre_tokenizer"].get("add_prefix_space"))
        ids = spec["model"]["vocab"]
        self.first = [ids[s] for s in byte_symbols()]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(SPLIT)
        self.runs = regex.compile(r" \s|\s ")
        self.chunks = SpacedChunks(self)

    def merges(self, word: str) -> tuple[int, int]:
        """Initial symbols and merges of one word."""
        symbols = [self.first[b] for b in word.encode("utf-8")]
        n, ranks = len(symbols), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, symbols[i], symbols[i + 1], found[1]) for i in range(n - 1) if (found := ranks.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        made = 0
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            made += 1
            if k < n:
                before[k] = i
                if found := ranks.get((merged, symbols[k])):
                    heapq.heappush(heap, (found[0], i, merged, symbols[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((symbols[h], merged))):
                heapq.heappush(heap, (found[0], h, symbols[h], merged, found[1]))
        return n, made

    def __missing__(self, word: str) -> int:
        n, made = self.merges(word)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n - made
        return n - made

    def count(self, text: str) -> int:
        total = 0
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        for part in parts:
            if self.prefix and part and not part[0].isspace():
                part = " " + part
            if self.runs.search(part):
                total += sum(map(self.__getitem__, self.split.findall(part)))
            else:
                # A space between two other characters always begins a word, so the pieces between spaces count by themselves.
                head, *pieces = part.split(" ")
                total += sum(map(self.__getitem__, self.split.findall(head))) + sum(map(self.chunks.__getitem__, pieces))
        return total + len(parts) - 1


class SpacedChunks(dict):
    """piece between spaces -> tokens of a space and that piece."""

    def __init__(self, words: PairMerger):
        super().__init__()
        self.words = words

    def __missing__(self, piece: str) -> int:
        n = sum(map(self.words.__getitem__, self.words.split.findall(" " + piece)))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


_MERGERS: dict[str, PairMerger] = {}


def merger(path: str) -> PairMerger:
    """One merger for each vocabulary in each Python worker."""
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, over: int = OVER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > over).

    Null and empty texts have 0 of both. Repeated rows and null ids are kept as they come; other columns are ignored; an
    empty table gives no rows. ``vocabulary`` is a byte-level BPE file that every executor can read. Narrow: no shuffle.
    """
    path = vocabulary or default_vocabulary()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merger(path)
        for batch in pieces(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [bpe.count(t) for t in texts]
            sizes = [len(t) if t.isascii() else len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > over for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
