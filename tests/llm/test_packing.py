"""Packing: pieces as the vocabulary's library makes them, sequences without gaps, and few of them."""

import bisect
import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import packing

SMALL = "/root/testdata/sf0.001"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(packing.default_vocabulary())


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def plain_pieces(library, rows, capacity):
    out = []
    for i, text in rows:
        ids = ids_of(library, text)
        out += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=repr)


def sequences(rows, capacity):
    """How many there are; each must be gapless from 0 and no longer than the capacity."""
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def best_fit_decreasing(sizes, capacity):
    gaps, n = [], 0
    for size in sorted(sizes, reverse=True):
        i = bisect.bisect_left(gaps, size)
        n += i == len(gaps)
        left = (gaps.pop(i) if i < len(gaps) else capacity) - size
        if left:
            bisect.insort(gaps, left)
    return n


def test_words_as_the_library(library):
    r = random.Random(3)
    parts = ["<|endoftext|>", "<|end", " ", "  ", "\n", "'s", "'LL", "é", "é", "́", "ß", "İ", "Σ", "ΑΣ", "日本", "🙂", "\x1c", "\x85", "\xa0", "　", "​", "abc", "123", "!!", "\t", "don't", "<|startoftext|>"]
    words = packing.word_ids(packing.default_vocabulary())
    for _ in range(100):
        texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(15)]
        for text, got in zip(texts, map(words.ids, texts)):
            assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    with pytest.raises(ValueError, match="white space"):
        packing.word_ids(packing.default_vocabulary().replace("word_bpe_49k", "byte_bpe_50k"))


def test_the_whole_table(spark, library):
    rows = packing.op13_pack_sequences(spark, SMALL).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == plain_pieces(library, docs, 4096)
    assert sequences(rows, 4096) <= 1.02 * best_fit_decreasing([r.length for r in rows], 4096) + 1


def test_awkward_documents(spark, library):
    r = random.Random(4)
    rows = [(1, None), (2, ""), (1, None), (None, "one two"), (3, "word " * 1000), (4, "x" * 5000), (5, " \t\n ")] + [(9, "the same text")] * 40 + [(100 + i, "w " * r.randrange(70)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in ("id", "size", "bin", "gap", "part", "length", "slot", "room")]).repartition(3)
    got = packing.pack(df, capacity=64).collect()
    assert sorted(((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got), key=repr) == plain_pieces(library, rows, 64)
    assert sequences(got, 64) <= 1.05 * best_fit_decreasing([x.length for x in got], 64) + 1
    assert packing.pack(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sweep_takes_the_smallest_gap_left(spark, seed):
    r = random.Random(seed)
    items = [(i, r.randint(1, 60)) for i in range(300)]
    slots = [(i, size, size + r.randint(0, 3)) for i, size in enumerate(r.randint(1, 60) for _ in range(r.choice([50, 300])))]
    got = packing.sweep(spark.createDataFrame(items, "id long, size long"), spark.createDataFrame(slots, "id long, size long, room long")).collect()
    size_of = {i: s for i, s, _ in slots}
    taken = [x.bin for x in got if x.bin is not None]
    assert len(got) == 300 and len(set(taken)) == len(taken) and all(x.size <= size_of[x.bin] for x in got if x.bin is not None)
    free, want = sorted(s for _, s, _ in slots), []
    for size in sorted(s for _, s in items):
        i = bisect.bisect_left(free, size)
        if i < len(free):
            want.append((size, free.pop(i)))
    assert sorted((x.size, size_of[x.bin]) for x in got if x.bin is not None) == sorted(want)
