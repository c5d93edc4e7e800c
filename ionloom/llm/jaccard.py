"""Similarity join of documents on the Jaccard similarity of their word shingles, by PartEnum signatures.

Sets are put into bands of like size. Two sets that reach the similarity and lie in one band, or in neighbouring ones,
differ in at most k elements, k known from the band. The hashed domain of shingles is cut into n1 ranges and each of these
into n2; by counting, at least a few of the n1 ranges hold no more than k2 differences, and there some n2 - k2 of the n2 parts
agree entirely. So a set's signatures are, for every range, the hashes of what it holds in each choice of n2 - k2 parts, and
sets that link share a signature for certain: nothing is lost. Sets that share one are then compared exactly.

Texts with equal sets are one node. Of a group of nodes with one signature only a star (each with the smallest) is looked at
first; the links found give components, and then, wherever a signature is shared by different components, the pairs
across them. Pairs within a component can add nothing, so large groups of near copies don't cost the square of their size,
and every link between components is still found. Two nodes that were both compared with one centre share no more than the
smaller of their parts of it and the elements that both have beside it, which rules most pairs out without forming them.

A range that agrees in no choice of parts holds two differences at least, one that agrees in some holds one; so a pair with
few common signatures differs in more than a link may, and is never compared. The count is free: pairs are gathered from
the groups once for each signature they share.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_VALUES, join_one, pieces, scratch, table, text_key, written
from .shingles import PLACES, mixed, set_hash, shingle_set

WIDTH, SIMILARITY = 5, (80, 100)
#: Parts of a range, and how many of them may differ.
PARTS, MAY_DIFFER = 3, 1
#: Ranges beyond those that counting needs. A link then shares a few signatures, and not just one.
SPARE = 3
#: A band's largest size over its smallest; at least the inverse of the similarity.
BAND = 1.4
#: The low bits of a signature, which hold the number of its band.
BAND_BITS = np.uint64(63)
#: A star's pair is measured if it shares so much of what a link must share: measured pairs are what clusters decide by.
STAR_SHARE = 0.4
#: Nodes that a task remembers, so that copies that it meets again are passed over.
REMEMBERED = 50_000


class Bands:
    """Size bands and the signatures of a set in them, for one similarity."""

    def __init__(self, similarity: tuple[int, int]):
        self.num, self.den = similarity
        self.tops = [1]
        self.ratio = max(BAND, self.den / self.num)

    def top(self, i: int) -> int:
        while len(self.tops) <= i:
            self.tops.append(int((self.tops[-1] + 1) * self.ratio))
        return self.tops[i]

    def of(self, size: int) -> list[int]:
        """The bands whose signatures a set of this size needs: its own, and the next if a larger partner may lie there."""
        i = 0
        while self.top(i) < size:
            i += 1
        return [i, i + 1] if size * self.den // self.num > self.top(i) else [i]

    def differ(self, i: int) -> int:
        """Elements in which two sets that link and are no larger than the band's top can differ, at most."""
        return 2 * self.top(i) * (self.den - self.num) // (self.den + self.num)

    def ranges(self, i: int) -> int:
        """Ranges of the domain in a band: SPARE more than counting needs, so that so many more of them agree."""
        return -(-(self.differ(i) + 1) // (MAY_DIFFER + 1)) + SPARE

    def signatures(self, shingles: np.ndarray) -> list[np.ndarray]:
        out = []
        if not len(shingles):
            return out
        weight, high = mixed(shingles + PLACES[7]), shingles >> np.uint64(32)
        for i in self.of(len(shingles)):
            if (k := self.differ(i)) == 0:
                continue  # only equal sets link here, and those are one node
            ranges = self.ranges(i)
            part = ((high * np.uint64(ranges * PARTS)) >> np.uint64(32)).astype(np.int64)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            sums, full = np.zeros(ranges * PARTS, np.uint64), np.zeros(ranges * PARTS, bool)
            sums[part[starts]], full[part[starts]] = np.add.reduceat(weight, starts), True
            sums, full = sums.reshape(ranges, PARTS), full.reshape(ranges, PARTS)
            chosen = [list(c) for c in combinations(range(PARTS), PARTS - MAY_DIFFER)]
            held = np.stack([full[:, c].any(axis=1) for c in chosen], axis=1)
            names = np.stack([sums[:, c].sum(axis=1, dtype=np.uint64) + PLACES[9 + j : 10 + j] * np.uint64(i + 1) for j, c in enumerate(chosen)], axis=1) + PLACES[8:9] * np.arange(1, ranges + 1, dtype=np.uint64)[:, None]
            names = (mixed(names) & ~BAND_BITS) | np.uint64(i)
            # One range at most without elements in some choice: another agreeing range has elements, and that will do.
            out.append(names[held] if (~held).any(axis=1).sum() <= 1 else names.ravel())
        return out


class Seen(set):
    """What a task has met lately: forgets all when it is full. Whatever it forgets is only done again."""

    def new(self, x) -> bool:
        if x in self:
            return False
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(x)
        return True


def _set_rows(texts: DataFrame, width: int, similarity: tuple[int, int], seed: int) -> DataFrame:
    """(doc_id, tid, node, check, n_shingles, band); node and check, two names of the set, are null for a text without words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(similarity)
        for batch in pieces(batches, 2):
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            named = [pa.array([set_hash(s, k) if len(s) else None for s in sets], pa.int64()) for k in (seed, seed + 1)]
            size, band = pa.array(list(map(len, sets)), pa.int64()), pa.array([bands.of(len(s))[0] for s in sets], pa.int32())
            names = ["doc_id", "tid", "node", "check", "n_shingles", "band"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *named, size, band], names=names)

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(rows, f"doc_id {kind}, tid string, node long, check long, n_shingles long, band int")


def _signature_rows(texts: DataFrame, width: int, similarity: tuple[int, int], seed: int) -> DataFrame:
    """(signature, node), each node once for a run of batches at most."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(similarity), Seen()
        for batch in pieces(batches, 0):
            names, nodes, counts = [], [], []
            for t in batch.column(0).to_pylist():
                shingles = shingle_set(t, width)
                if len(shingles) and seen.new(node := set_hash(shingles, seed)):
                    found = bands.signatures(shingles)
                    names += found
                    nodes.append(node)
                    counts.append(sum(map(len, found)))
            if names:
                signature = pa.array(np.concatenate(names).view(np.int64))
                yield pa.RecordBatch.from_arrays([signature, pa.array(np.repeat(np.array(nodes, np.int64), counts))], names=["signature", "node"])

    return texts.select("text").mapInArrow(rows, "signature long, node long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and node, the distinct ones whose signature several nodes have. Holds one row between batches."""
    last, told = None, False  # the last row, and whether it has been passed on
    for batch in batches:
        s, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            s, n = np.r_[last[0], s], np.r_[last[1], n]
        if not len(s):
            continue
        new = np.r_[True, (s[1:] != s[:-1]) | (n[1:] != n[:-1])]
        s, n = s[new], n[new]
        like_next = np.r_[s[1:] == s[:-1], False]
        like_last = np.r_[False, s[1:] == s[:-1]]
        keep = like_next | like_last
        if last is not None and told:
            keep[0] = False
        told_last = bool(like_last[-1]) or (told and len(s) == 1)
        last, told = (s[-1:], n[-1:]), told_last
        yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(n[keep])], names=["signature", "node"])


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) -> (node, label), label being the smallest node of the component; nodes without edges are absent.

    Large star, then small star, again and again until nothing changes; each round is written to the shared folder.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("u"))
        small = small.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = written(small, name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b")).distinct())
        mark = now


class _Comparison:
    """Exact comparison of pairs of nodes; reads again the texts of the nodes that are in a pair, and only those."""

    def __init__(self, texts: DataFrame, nodes: DataFrame, width: int, similarity: tuple[int, int]):
        self.texts, self.nodes, self.width, (self.num, self.den) = texts, nodes, width, similarity
        bands = Bands(similarity)
        every = range(int(BAND_BITS) + 1)
        self.ranges = F.create_map(*[F.lit(x) for i in every for x in (i, bands.ranges(i))])
        self.tops = F.create_map(*[F.lit(x) for i in every for x in (i, bands.top(i))])

    def shares(self, n: str, band: Column) -> Column:
        """Signatures of a band that a set of n elements shares with any set that it links to in that band, at least."""
        other = F.least(F.floor(F.col(n) * self.den / self.num), self.tops[band].cast("bigint"))
        return 2 * self.ranges[band] - F.floor((F.col(n) + other) * (self.den - self.num) / (self.den + self.num)) - PARTS

    def promising(self, counts: DataFrame, share: float = 1.0) -> DataFrame:
        """From rows (a, b, band, common), common being the signatures of the band that a pair shares, the pairs that may be links by their sizes and by the count.

        share: of the signatures that a link must share at least; below 1 other pairs that are much alike come too.
        """
        a, b = (self.nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("band").alias(f"band_{x}")) for x in "ab")
        # Kept per pair and band: a pair's own band is that of its larger set.
        sized = counts.join(a, "a").join(b, "b").filter("band = greatest(band_a, band_b)")
        sized = sized.filter(F.least("n_a", "n_b") * self.den >= F.greatest("n_a", "n_b") * self.num)
        most = F.floor((F.col("n_a") + F.col("n_b")) * (self.den - self.num) / (self.den + self.num))
        return sized.filter(F.col("common") >= share * (2 * self.ranges[F.col("band")] - most - PARTS)).select("a", "b")

    def sets(self, pairs: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in the pairs."""
        width = self.width

        def set_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = Seen()
            for batch in pieces(batches, 1):
                nodes, sets = [], []
                for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if seen.new(node):
                        nodes.append(node)
                        sets.append(shingle_set(text, width).view(np.int64))
                lengths = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                arrays = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([*sets, np.array([], np.int64)])))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), arrays], names=["node", "shingles"])

        both = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # A node has one text by its key; a key has one text, so no other text is taken for it, whatever its id.
        needed = written(self.nodes.join(both, "node", "left_semi").select("node", "tid"), "needed")
        few = needed.count() <= BROADCAST_VALUES
        rows = self.texts.join(F.broadcast(needed) if few else needed, "tid").select("node", "text")
        return written(rows.mapInArrow(set_arrays, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(a, b, common, n_a, n_b, extra): elements the sets have in common, their sizes, and those of b that a lacks."""
        sets = self.sets(pairs)
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        extra = F.array_except("set_b", "set_a")
        joined = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), extra.alias("extra"))
        return joined.select("a", "b", (F.col("n_b") - F.size("extra")).alias("common"), "n_a", "n_b", "extra")

    def linked(self, common: str, n_a: str, n_b: str) -> Column:
        """Whether so many common elements make a link of sets of these sizes."""
        return F.expr(f"({common}) * {self.num + self.den} >= ({n_a} + {n_b}) * {self.num}")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets reach the similarity."""
        return self.measured(pairs).filter(self.linked("common", "n_a", "n_b")).select("a", "b")


def _across_clusters(known: DataFrame, compare: _Comparison) -> DataFrame:
    """Pairs (a, b) with different labels that may be links, of nodes compared with one centre before.

    known: (c, node, common, n, extra, label), the centre itself among them. What two nodes share lies within the centre, and
    there is no more of it than the smaller of their two common parts, or among the elements both have beside it, which an
    equi-join counts. Nodes that fall short of the centre on their own seldom reach each other, so few pairs are left.
    """
    labels = known.groupBy("c").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least")).filter("low <> high")
    known = written(known.join(labels, "c").drop("low", "high"), "known")
    side = lambda df, x: df.select(*[F.col(c).alias(c if c in ("c", "e") else f"{c}_{x}") for c in df.columns])
    differ = "label_x <> label_y AND node_x < node_y"

    beside = known.select("c", "node", "common", "n", "label", F.explode("extra").alias("e"))
    shared = beside.groupBy("c", "e").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("c", "e")
    beside = written(beside.join(shared, ["c", "e"]), "beside")
    by_extra = side(beside, "x").join(side(beside, "y"), ["c", "e"]).filter(differ)
    by_extra = by_extra.groupBy("c", "node_x", "node_y", "common_x", "common_y", "n_x", "n_y").agg(F.count("*").alias("more")).filter(compare.linked("least(common_x, common_y) + more", "n_x", "n_y"))

    # Without a common extra: only nodes that, with what they share with the centre, could reach the smallest of the cluster.
    able = known.filter(compare.linked("common", "n", "least")).select("c", "node", "common", "n", "label")
    within = side(able, "x").join(side(able, "y"), "c").filter(F.expr(differ) & compare.linked("least(common_x, common_y)", "n_x", "n_y"))
    return by_extra.select("node_x", "node_y").union(within.select("node_x", "node_y")).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def set_members(texts: DataFrame, width: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame, int]:
    """The rows by the set that they have, the sets (node, tid, n_shingles, band), and the seed of the sets' names.

    Two names of 64 bits each tell sets apart. Only one is used further on; should different sets share it, which corpora of
    billions of texts may well see, other names are taken.
    """
    seed = 0
    while True:
        members = written(_set_rows(texts, width, similarity, seed), "members")
        first = [F.min("tid").alias("tid"), F.max("n_shingles").alias("n_shingles"), F.max("band").alias("band")]
        nodes = members.filter("node is not null").groupBy("node").agg(*first, F.min("check").alias("low"), F.max("check").alias("high"))
        nodes = written(nodes, "nodes")
        if nodes.filter("low <> high").isEmpty():
            return members.drop("check"), nodes.drop("low", "high"), seed
        seed += 2


def classed_rows(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tid (the text's key), n_shingles, node (the set's name), label (the class's name).

    Rows with one label are linked, directly or over others. node and label are null for texts without words. Null ids are as
    good as others, and so are several texts with one id: rows are told apart by their texts.
    """
    with scratch(docs.sparkSession):
        return written(_labelled(docs, width, similarity, doc_id, text), "classes", outer=True)


def similar_classes(docs: DataFrame, width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), n_equal.

    Documents link when the similarity of their sets is at least ``similarity`` (as a fraction of whole numbers). n_equal is
    the number of rows with the same set. Null and empty texts have no shingles, link with nothing and are their own
    component. Repeated rows are in one component, and so is each text of an id that stands on several only with what that
    text links to. A null id links like any other, but is no component's smallest unless all are null. Other columns of docs
    are ignored; an empty table gives no rows. Shingles are compared by 64-bit hashes.
    """
    named = classed_rows(docs, width, similarity, doc_id, text)
    smallest = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    equal = named.filter("node is not null").groupBy("node").agg(F.count("*").alias("n_equal"))
    with scratch(docs.sparkSession):
        placed = written(join_one(named, smallest, "label"), "placed", outer=True)
    out = join_one(placed, equal, "node")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_equal", F.lit(1)).cast("long").alias("n_equal"))


def _labelled(docs: DataFrame, width: int, similarity: tuple[int, int], doc_id: str, text: str) -> DataFrame:
    """What classed_rows() gives, yet to be written."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("tid"), F.col(text).cast("string").cast("binary").alias("text"))
    members, nodes, seed = set_members(texts, width, similarity)
    dealt = _signature_rows(texts, width, similarity, seed).repartition("signature").sortWithinPartitions("signature", "node")
    groups = written(dealt.mapInArrow(_shared, "signature long, node long"), "groups")

    nodes = written(nodes.join(groups.select("node").distinct(), "node", "left_semi"), "nodes")
    compare = _Comparison(texts, nodes, width, similarity)

    # The centre of a group is its node with the most company in all groups: of edited copies, what they were copied from.
    sizes = groups.groupBy("signature").agg(F.count("*").alias("size"))
    company = groups.join(sizes, "signature").groupBy("node").agg(F.sum("size").alias("company"))
    ranked = groups.join(company, "node").select("signature", "node", F.struct("company", "node").alias("rank"))
    centers = ranked.groupBy("signature").agg(F.max("rank").alias("top")).select("signature", F.col("top.node").alias("a"))
    centers = written(centers, "centers")
    band = F.expr(f"cast(signature & {int(BAND_BITS)} as int)").alias("band")
    star = groups.join(centers, "signature").filter("a <> node").groupBy("a", F.col("node").alias("b"), band).agg(F.count("*").alias("common"))
    star = written(compare.measured(written(compare.promising(star, STAR_SHARE), "star")), "measured")
    links = written(star.filter(compare.linked("common", "n_a", "n_b")).select("a", "b"), "links")
    labels = written(connected(links), "labels")

    own = nodes.join(labels, "node", "left").select("node", F.col("n_shingles").cast("int").alias("n"), F.coalesce("label", "node").alias("label"))
    own = written(own, "own")
    placed = groups.join(own, "node").join(centers.withColumnRenamed("a", "c"), "signature")
    several = placed.groupBy("signature").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).filter("low <> high").select("signature", "size")
    met = star.select(F.col("a").alias("c"), F.col("b").alias("node"), F.lit(True).alias("met"))
    open_rows = placed.join(several, "signature").join(met, ["c", "node"], "left")
    open_rows = written(open_rows.select("signature", "size", "c", "node", "n", "label", (F.coalesce("met", F.lit(False)) | (F.col("node") == F.col("c"))).alias("met")), "open")

    # Members that were never compared with their centre meet others of their groups. A node that shares t signatures with
    # whatever it links to may leave out its t - 1 commonest: one of the others is still shared. Of a pair whose two have been
    # compared with one centre, in whatever group, the cluster decides.
    num, den = similarity
    by_size = Window.partitionBy("node", "band").orderBy(F.desc("size"), "signature")
    rare = open_rows.withColumn("band", band).withColumn("rank", F.row_number().over(by_size)).filter(F.col("rank") >= compare.shares("n", F.col("band")))
    compared = star.select(F.col("a").alias("c"), F.col("b").alias("node")).union(star.select("a", "a")).groupBy("node").agg(F.collect_set("c").alias("with"))
    rare = rare.select("signature", "node", "n", "label", "met").join(compared, "node", "left").withColumn("with", F.coalesce("with", F.array().cast("array<bigint>")))
    rare = written(rare, "rare")
    x, y = rare.filter("not met").alias("x"), rare.alias("y")
    strange = x.join(y, F.expr(f"x.signature = y.signature AND x.label <> y.label AND (y.met OR x.node < y.node) AND least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num} AND NOT arrays_overlap(x.with, y.with)"))
    strange = written(strange.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "strange")
    held = written(open_rows.groupBy("node", band).agg(F.collect_list("signature").alias("held")), "held")
    theirs = strange.join(held.select(F.col("node").alias("a"), "band", F.col("held").alias("held_a")), "a").join(held.select(F.col("node").alias("b"), "band", F.col("held").alias("held_b")), ["b", "band"])
    strange = compare.promising(theirs.select("a", "b", "band", F.size(F.array_intersect("held_a", "held_b")).alias("common")))
    hubs = open_rows.select("c").distinct()
    known = star.select(F.col("a").alias("c"), F.col("b").alias("node"), "common", "extra").union(hubs.join(own, F.col("c") == F.col("node")).select("c", "node", F.col("n").alias("common"), F.array().cast("array<bigint>")))
    known = known.join(hubs, "c", "left_semi").join(own, "node").select("c", "node", "common", "n", "extra", "label")
    across = written(strange.union(_across_clusters(known, compare)).distinct(), "across")
    more = written(compare.links(across), "links")
    if not more.isEmpty():
        labels = written(connected(links.union(more)), "labels")

    named = join_one(members, labels, "node").withColumn("label", F.coalesce("label", "node"))
    return named.select("doc_id", "tid", "n_shingles", "node", "label")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"), width=4, similarity=(85, 100))
