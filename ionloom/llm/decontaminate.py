"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks and verified exactly.

Words are runs of letters and digits, lowered; a shingle is five of them (a shorter item is one shingle of all its words). For
an item of n words, the windows of n words of a text are told by the 64-bit SimHash of their shingles.

A window can reach the similarity with an item only if enough of its shingles are an item's, of some item of its size. These
shingles, the hits, are found first; windows with too few are left out, and of the others only hits are counted, since no
other shingle can be shared. A window's SimHash follows from running sums over the hits, one at either end, so that no window
is ever copied out. A fingerprint is cut into BLOCKS blocks; two that lie within the radius differ in at most
RADIUS // BLOCKS bits of one of them, and an item stands in the index under every value so near to its own: an equi-join on
the blocks finds them all. Candidates are then compared exactly, by the Jaccard similarity of their shingles weighted by how
often they occur.

All of it is built from DataFrame functions. Texts are told apart by a key, so that copies of a text are searched once.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, small, table, text_key, written

WIDTH, SIMILARITY = 5, 0.8
#: Bits in which a window and an item may differ. Of a window's hits at least 8 in 9 are the item's, so some 7 bits differ at
#: the similarity of 0.8, with a standard deviation of 2.5.
RADIUS, BLOCKS = 14, 5


def computed(value: Column) -> Column:
    """value, computed once for each row: the optimizer would else repeat a costly column wherever a filter or a lambda names it."""
    return F.explode_outer(F.array(value))


def with_words(df: DataFrame) -> DataFrame:
    """Adds h, the hashes of the words of ``text`` in order."""
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), "")
    return df.withColumn("h", F.transform(words, lambda w: F.xxhash64(w)))


def shingles(width: int) -> Column:
    """The shingles of so many words, as hashes, from h; empty if there are fewer words."""
    one = lambda i: F.xxhash64(*[F.get("h", i + j) for j in range(width)])
    return F.when(F.size("h") >= width, F.transform(F.sequence(F.lit(0), F.size("h") - width), one)).otherwise(F.array().cast("array<bigint>"))


def of_width(widths: list[int]) -> Column:
    """The shingles of h that are as wide as the row's ``width`` says."""
    return reduce(lambda c, w: c.when(F.col("width") == w, shingles(w)), widths, F.when(F.lit(False), shingles(1)))


def lanes(x: str) -> list[Column]:
    """The bits of a hash, two to a long: bit k below and bit k + 32 above, so that sums over hashes count each bit."""
    ones = F.lit((1 << 32) | 1)
    return [F.shiftrightunsigned(x, k).bitwiseAND(ones).alias(f"s{k}") for k in range(32)]


def simhash(m: str) -> Column:
    """The SimHash from the sums of lanes over m hashes: a bit is set if more than half of them have it."""
    bit = lambda count, b: F.shiftleft((count * 2 > F.col(m)).cast("long"), b)
    low = reduce(add, [bit(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), k) for k in range(32)])
    high = reduce(add, [bit(F.shiftrightunsigned(F.col(f"s{k}"), 32), k) for k in range(32)])
    return low.bitwiseOR(F.shiftleft(high, 32))


def _masks(bits: int, most: int) -> list[int]:
    """All values of so many bits of which at most so many are set."""
    found = {0}
    for _ in range(most):
        found |= {v | 1 << i for v in found for i in range(bits)}
    return sorted(found)


def _placed(place: int):
    return lambda value: F.struct(F.lit(place).alias("place"), value.alias("value"))


def blocks(near: int = 0, radius: int = RADIUS, n: int = BLOCKS) -> Column:
    """The blocks (place, value) of the column ``simhash``, and with ``near`` also the values that differ in so many bits."""
    at, out = 0, []
    for i in range(n):
        bits = 64 // n + (i < 64 % n)
        value = F.shiftrightunsigned("simhash", at).bitwiseAND(F.lit((1 << bits) - 1))
        masks = F.array(*[F.lit(m).cast("bigint") for m in _masks(bits, near)])
        values = F.transform(masks, value.bitwiseXOR)
        out.append(F.transform(values, _placed(i)))
        at += bits
    return F.explode(F.concat(*out))


def weighted_similarity(a: str, b: str, m: str) -> Column:
    """Sum of the smaller over sum of the larger counts of each shingle, of two arrays that stand for m shingles each.

    a may leave out shingles that b has not.
    """
    again = lambda g: F.filter(F.sort_array(g), lambda x, i: (i > 0) & (x == F.get(F.sort_array(g), i - 1)))
    times = lambda g, x: F.size(F.filter(g, lambda y: y == x))
    # Most windows have no shingle twice; what is there again is counted by itself.
    rest = F.aggregate(F.array_intersect(again(a), again(b)), F.lit(0), lambda acc, x: acc + F.least(times(again(a), x), times(again(b), x)))
    repeats = (F.size(F.array_distinct(a)) < F.size(a)) & (F.size(F.array_distinct(b)) < F.size(b))
    both = F.size(F.array_intersect(a, b)) + F.when(repeats, rest).otherwise(0)
    return both / (2 * F.col(m) - both)


def _items(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Each item text once, whatever ids it has: (key, n, width, m, g), its words, the width and number of its shingles, and these; (key, item_id), the ids of each; and the widths there are."""
    named = items.select(F.col(item_id).alias("item_id"), text_key(text).alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null")
    once = with_words(named.groupBy("key").agg(F.first("text").alias("text"))).filter("size(h) > 0").withColumn("n", F.size("h")).withColumn("width", F.least("n", F.lit(WIDTH)))
    widths = sorted(r.width for r in once.select("width").distinct().collect())  # five at most
    once = once.withColumn("g", of_width(widths)).withColumn("m", F.size("g"))
    return written(once.select("key", "n", "width", "m", "g"), "items"), written(named.select("key", "item_id").distinct(), "item-ids"), widths


def _hits(texts: DataFrame, items: DataFrame, widths: list[int], similarity: float) -> DataFrame:
    """(tid, n, m, need, last, at, x): where texts have a shingle of an item of n words.

    need: how many hits a window must have to reach the similarity; last: where a text's last window begins.
    """
    known = written(items.select("width", "n", F.explode("g").alias("x")).distinct(), "item-shingles")
    hashed = with_words(texts).select("tid", computed(F.col("h")).alias("h"))
    each = F.explode(F.array(*[F.struct(F.lit(w).alias("width"), shingles(w).alias("g")) for w in widths or [WIDTH]]))
    placed = hashed.select("tid", F.size("h").alias("words"), each.alias("s")).select("tid", "words", "s.width", F.posexplode("s.g").alias("at", "x"))
    m = F.col("n") - F.col("width") + 1
    hits = placed.join(small(known), ["width", "x"]).filter("n <= words").select("tid", "n", m.alias("m"), (F.col("words") - F.col("n")).alias("last"), "at", "x")
    need = F.ceil(F.lit(similarity) * 2 * F.col("m") / (1 + similarity) - 1e-9).cast("int")
    return written(hits.withColumn("need", need).distinct(), "hits")


def _windows(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, n, start, m, held, before, simhash) of the windows with enough hits: held, their hits, which follow ``before`` others; and (tid, n, xs), the hits of a text in order."""
    keys = ["tid", "n"]
    rows = hits.groupBy(*keys, "m", "need", "last").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("l"))
    rows = written(rows.filter("size(l) >= need").select(*keys, "m", "need", "last", F.transform("l", lambda h: h["at"]).alias("ats"), F.transform("l", lambda h: h["x"]).alias("xs")), "hit-lists")
    # A window has enough hits if it begins where the hits i to i + need - 1 are all inside, for some i.
    i = lambda k: F.get("ats", k)
    reach = F.transform(F.sequence(F.lit(0), F.size("ats") - F.col("need")), lambda k: F.struct(F.greatest(F.lit(0), i(k + F.col("need") - 1) - F.col("m") + 1).alias("a"), F.least(i(k), F.col("last")).alias("b")))
    spans = rows.select(*keys, "m", F.explode(F.filter(reach, lambda r: r["a"] <= r["b"])).alias("r"))
    starts = written(spans.select(*keys, "m", F.explode(F.sequence("r.a", "r.b")).alias("start")).distinct(), "starts")
    # Running sums: a row before the first place of a window, and one behind its last.
    ends = starts.select(*keys, "m", "start", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(0).alias("kind")), F.struct((F.col("start") + F.col("m") - 1).alias("at"), F.lit(2).alias("kind")))).alias("e"))
    held = rows.select(*keys, F.explode(F.arrays_zip("ats", "xs")).alias("h"))
    held = held.join(starts.select(*keys).distinct(), keys, "left_semi")
    marks = held.select(*keys, F.lit(None).cast("int").alias("m"), F.lit(None).cast("int").alias("start"), F.col("h.ats").alias("at"), F.lit(1).alias("kind"), F.col("h.xs").alias("x"))
    marks = marks.union(ends.select(*keys, "m", "start", "e.at", "e.kind", F.lit(None).cast("bigint")))
    run = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"s{k}") for k, c in enumerate(lanes("x"))]
    run_up = marks.select(*keys, "m", "start", "kind", F.count("x").over(run).alias("c"), *sums).filter("kind <> 1")
    sign = F.when(F.col("kind") == 2, 1).otherwise(-1)
    apart = [F.sum(sign * F.col(f"s{k}")).alias(f"s{k}") for k in range(32)]
    told = run_up.groupBy(*keys, "start", "m").agg(F.sum(sign * F.col("c")).cast("int").alias("held"), F.min("c").cast("int").alias("before"), *apart)
    return told.select(*keys, "start", "m", "held", "before", simhash("held").alias("simhash")), rows.select(*keys, "xs")


def leaking_texts(texts: DataFrame, items: DataFrame, similarity: float = SIMILARITY, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """texts (tid, text; null texts left out) -> tid, item_id, start_word, n_words, similarity: the best window of each text and item."""
    with scratch(texts.sparkSession):
        items, ids, widths = _items(items, item_id, text)
        windows, lists = _windows(_hits(texts, items, widths, similarity))

        one = items.select("key", "n", "m", F.explode("g").alias("x"))
        own = one.groupBy("key", "n", "m").agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate(lanes("x"))]).withColumn("simhash", simhash("m"))
        index = written(own.select("key", "n", F.col("simhash").alias("theirs"), blocks(RADIUS // BLOCKS).alias("b")).select("key", "n", "theirs", "b.*"), "item-blocks")
        near = windows.withColumn("b", blocks()).select(*windows.columns, "b.*").join(small(index), ["n", "place", "value"])
        near = near.filter(F.bit_count(F.col("simhash").bitwiseXOR(F.col("theirs"))) <= RADIUS)
        near = written(near.select("tid", "n", "start", "m", "held", "before", "key").distinct(), "near")

        theirs = items.select("key", F.col("n").alias("n_words"), F.col("g").alias("theirs"))
        pairs = near.join(small(theirs, F.size("theirs")), "key")
        pairs = pairs.filter("n = n_words").join(lists, ["tid", "n"])
        pairs = pairs.select("tid", "key", "n", "start", "m", "theirs", computed(F.slice("xs", F.col("before") + 1, F.col("held"))).alias("g"))
        found = pairs.select("tid", "key", "n", "start", computed(weighted_similarity("g", "theirs", "m")).alias("similarity")).filter(F.col("similarity") >= similarity)
        best = found.join(small(ids), "key").groupBy("tid", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n")).alias("best"))
        return written(best.select("tid", "item_id", (-F.col("best.back")).alias("start_word"), F.col("best.n").alias("n_words"), "best.similarity"), "leaks", outer=True)


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each document and item of which the document holds a window: doc_id, item_id, start_word, n_words, similarity.

    The window reported is the most similar one, the first of equals; start_word counts the document's words from 0. Null
    and empty texts, and items without words, are in no row; a document shorter than an item can't hold its window. Repeated
    rows with one id and text give one row for each item, and so do several texts of one id whose best windows agree; repeated
    items count once, items of several texts under one id give the best window of any, and a text under several ids gives a row
    for each, a null id included. Null document ids are as good as others. Other columns
    are ignored; either table may be empty.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("tid"), F.col(text).cast("string").alias("text")).filter("text is not null")
    best = leaking_texts(texts.select("tid", "text"), items, similarity, item_id, text)
    return texts.select("doc_id", "tid").join(small(best), "tid").select("doc_id", "item_id", "start_word", "n_words", "similarity").distinct()


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
