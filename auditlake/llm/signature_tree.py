"""Exact n-gram Jaccard self-join by prefix groups, searched with signature trees.

1. Each document becomes the set of the hashes of its distinct shingles; equal sets form a class.
2. Two sets with Jaccard similarity t or more share at least l shingles among the first |x| - ceil(t |x|) + l of each,
   in any order that is the same for all; the order is by hash, and l grows with the size.  Sets with fewer shared
   shingles than that go, twice over, and what is left is cut to its rarest shingles, by the same rule.
3. The classes that share a prefix shingle are a group; of groups with the same members one is kept.  In a group, a
   tree of nodes holds OR-combined bitmaps of shingles, the range of sizes and the collisions in the bitmaps; a dual
   traversal prunes pairs of nodes whose largest possible overlap is too small.  First small bitmaps alone are sent
   to the groups, then the sets of those that have a partner there; pairs that aren't connected yet are verified.  A
   group gives the edges of a spanning forest of its links, never all pairs.
4. Connected components over those edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, U64, Rolling, key_groups, lean, mix, row_key, signed, staged, tasks, text_buffer
from .components import components

#: Bytes of text hashed at once, unless one document has more.
BLOCK = 1 << 17
#: Percent of a set's size that is the number l of shingles to be shared.
SHARED_PERCENT = 8
#: Shingles of a group that one task holds; a larger group is dealt out as pairs of blocks.
BLOCK_SHINGLES = 1_000_000
#: Keys of sets that a task remembers, so as to send the prefix of copies once.
KEPT_KEYS = 100_000
#: log2 of the bits that say which documents' sets are needed.
INVOLVED_BITS = 26


def _word_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, some BLOCK bytes at once whatever the length of their text."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(int(np.searchsorted(ends, starts[a] + BLOCK, "right")), a + 1)
        out[a:b] = Rolling(block[starts[a] : ends[b - 1]]).span(starts[a:b] - starts[a], ends[a:b] - starts[a])
        a = b
    return out


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted hashes of distinct shingles) of each text, in order; a text of fewer words has one, of none none."""
    raw, at = text_buffer(column)
    i, n = 0, len(at) - 1
    none = np.zeros(0, np.uint64)
    while i < n:
        j = max(int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1, i + 1)
        block = raw[at[i] : at[j]]
        block = block + np.where((block >= 65) & (block <= 90), np.uint8(32), np.uint8(0))
        bounds = at[i : j + 1] - at[i]
        gap = np.ones(len(block) + 2, bool)
        gap[1:-1] = (block == 32) | ((block >= 9) & (block <= 13))
        edge = np.zeros(len(block) + 1, bool)
        edge[bounds] = True
        starts = np.flatnonzero(~gap[1:-1] & (gap[:-2] | edge[:-1]))
        ends = np.flatnonzero(~gap[1:-1] & (gap[2:] | edge[1:])) + 1
        word = _word_hashes(block, starts, ends)
        first = np.searchsorted(starts, bounds)
        code = np.zeros(max(len(word) - words + 1, 0), np.uint64)
        for k in range(words):
            code = code * U64(0x9E3779B97F4A7C15) + word[k : k + len(code)]
        code = mix(code)
        for row in range(i, j):
            a, b = first[row - i], first[row - i + 1]
            if b - a >= words:
                yield row, np.unique(code[a : b - words + 1])
            elif b > a:
                short = np.full(1, b - a, np.uint64)
                for w in range(a, b):
                    short = short * U64(0xD1342543DE82EF95) + word[w : w + 1]
                yield row, mix(short)
            else:
                yield row, none
        i = j


def _set_keys(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                keys = [(len(s), *(int(mix(s ^ U64(salt)).sum().view(np.int64)) for salt in (1, 2))) for _, s in shingle_sets(batch.column(1), words)]
            columns = [pa.array(c, pa.int64()) for c in zip(*keys, strict=True)] if keys else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "row_key", "n", "k", "k2"])

    return run


def to_share(n: int) -> int:
    """l for a set of n shingles."""
    return max(n * SHARED_PERCENT // 100, 1)


def _prefixes(words: int, percent: int):
    """Rows (token, k, n) of the prefixes of distinct sets; a set may come again after KEPT_KEYS others, or in another task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            tokens, keys, sizes = [], [], []
            if len(done) > KEPT_KEYS:
                done.clear()
            for _, s in shingle_sets(batch.column(0), words):
                if not len(s):
                    continue
                with np.errstate(over="ignore"):
                    k = int(mix(s ^ U64(1)).sum().view(np.int64))
                if k not in done:
                    done.add(k)
                    n = len(s)
                    tokens.append(s[: n - (percent * n + 99) // 100 + to_share(n)])
                    keys.append(k)
                    sizes.append(n)
            if tokens:
                each = np.fromiter(map(len, tokens), np.int64, len(tokens))
                flat = signed(np.concatenate(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(np.array(keys, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int64), each))], names=["token", "k", "n"])

    return run


def _peeled(shared: DataFrame, percent: int) -> DataFrame:
    """Rows (token, k, n) of sets that may have a partner, with the shingles of which partners share one."""
    need = F.greatest(F.floor(F.floor(F.col("n") * percent / 100) * SHARED_PERCENT / 100), F.lit(1))
    of_set, of_token = Window.partitionBy("k"), Window.partitionBy("token")
    for _ in range(2):
        shared = shared.withColumn("c", F.count(F.lit(1)).over(of_set)).where(F.col("c") >= need)
        shared = shared.withColumn("df", F.count(F.lit(1)).over(of_token)).where("df > 1")
    shared = shared.withColumn("c", F.count(F.lit(1)).over(of_set)).withColumn("rank", F.row_number().over(of_set.orderBy("df", "token")))
    shared = shared.where((F.col("c") >= need) & (F.col("rank") <= F.col("c") - need + 1))
    by_size = of_token.orderBy("n", "k")
    before, after = F.lag("n").over(by_size), F.lead("n").over(by_size)
    return shared.where("df > 0").withColumn("before", before).withColumn("after", after).where((100 * F.col("before") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("after"))).select("token", "k", "n")


def _needed_sets(words: int, involved: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(1).to_numpy(zero_copy_only=False) & ((1 << INVOLVED_BITS) - 1)
            keep = pa.array(np.flatnonzero((involved[slot >> 3] >> (slot & 7)) & 1))
            if len(keep):
                sets = [s for _, s in shingle_sets(batch.column(2).take(keep), words)]
                with np.errstate(over="ignore"):
                    keys = pa.array([int(mix(s ^ U64(1)).sum().view(np.int64)) for s in sets], pa.int64())
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), keys, *columns], names=["rep", "k", "n", "bits", "shingles"])

    return run


def bitmap(s: np.ndarray) -> np.ndarray:
    """Bits of hashed shingles, two for each or more: as 64-bit words, a power of two of them."""
    width = max(64, 1 << int(2 * len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(width // 8, np.uint8)
    slot = (s & U64(width - 1)).astype(np.int64)
    np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    return bits.view(np.uint64)


class SignatureTree:
    """A tree over sets sorted by size: leaves of a few sets, nodes with OR-combined bitmaps and ranges of sizes."""

    LEAF, FAN = 8, 8

    def __init__(self, bitmaps: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        bitmaps, sizes = bitmaps[self.order], sizes[self.order]
        # Shingles beyond one a bit: at most so many of an overlap don't show in the bitmaps.
        slack = sizes - np.bitwise_count(bitmaps).sum(1, dtype=np.int64)
        self.levels = [(bitmaps, sizes, sizes, slack)]
        fan = self.LEAF
        while len(self.levels[-1][0]) > 1:
            bits, low, high, slack = self.levels[-1]
            cuts = np.arange(0, len(bits), fan)
            self.levels.append((np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(slack, cuts)))
            fan = self.FAN

    def children(self, level: int, node: int) -> range:
        fan = self.LEAF if level == 1 else self.FAN
        return range(node * fan, min((node + 1) * fan, len(self.levels[level - 1][0])))

    def compatible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes may hold linked sets: by sizes, and by the largest possible overlap."""
        bits, low, high, slack = self.levels[level]
        possible = np.minimum(slack[a], slack[b]) + np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
        sized = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        return sized & ((100 + percent) * possible >= percent * (low[a] + low[b]))


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def leaf_pairs(tree: SignatureTree, percent: int, settled) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets, as indices, that a dual traversal can't prune; settled(i, j) tells which pairs needn't be looked at."""
    pairs = [(len(tree.levels) - 1, 0, 0)]
    while pairs:
        level, a, b = pairs.pop()
        left = np.array(tree.children(level, a))
        right = left if a == b else np.array(tree.children(level, b))
        i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        if a == b:
            keep = (i <= j) if level > 1 else (i < j)
            i, j = i[keep], j[keep]
        if level == 1 and len(i):
            keep = ~settled(tree.order[i], tree.order[j])
            i, j = i[keep], j[keep]
        if len(i):
            keep = tree.compatible(level - 1, i, j, percent)
            i, j = i[keep], j[keep]
        if level > 1:
            pairs.extend((level - 1, x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True))
        elif len(i):
            yield tree.order[i], tree.order[j]


def have_partners(bitmaps: list[np.ndarray], sizes: np.ndarray, percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Which sets may be linked with another one, by their bitmaps; with `side`, with one of another side."""
    found, widths = np.zeros(len(sizes), bool), np.array([len(b) for b in bitmaps])
    for width in np.unique(widths).tolist():
        # Linked sets have bitmaps of the same width, or one of twice the other's.
        some = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(some) < 2:
            continue
        bits = np.stack([bitmaps[i] if widths[i] == width else bitmaps[i][:width] | bitmaps[i][width:] for i in some])
        tree = SignatureTree(bits, sizes[some])

        def settled(i: np.ndarray, j: np.ndarray, some=some) -> np.ndarray:
            i, j = some[i], some[j]
            return (found[i] & found[j]) | (side[i] == side[j] if side is not None else False)

        for i, j in leaf_pairs(tree, percent, settled):
            found[some[i]] = found[some[j]] = True
    return found


def spanning_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between sets; with `side`, links within a side are left to other calls."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)

    def linked(i: int, j: int) -> bool:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return 100 * both >= percent * (sizes[i] + sizes[j] - both)

    if n == 2:
        return [(0, 1)] if (side is None or side[0] != side[1]) and 100 * sizes.min() >= percent * sizes.max() and linked(0, 1) else []
    every, index = np.unique(np.concatenate(sets), return_inverse=True)
    width = min(len(every), max(1 << 12, (32 << 23) // n))
    width = -(-width // 64) * 64
    exact = width >= len(every)
    bits = np.zeros((n, width // 8), np.uint8)
    owner, slot = np.repeat(np.arange(n), sizes), index % width
    np.bitwise_or.at(bits, (owner, slot >> 3), (1 << (slot & 7)).astype(np.uint8))
    forest, edges = Forest(n), []

    def settled(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        root = {x: forest.root(x) for x in {*i.tolist(), *j.tolist()}}
        same = np.array([root[x] == root[y] for x, y in zip(i.tolist(), j.tolist(), strict=True)], bool)
        return same | (side[i] == side[j] if side is not None else False)

    for i, j in leaf_pairs(SignatureTree(bits.view(np.uint64), sizes), percent, settled):
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if forest.root(x) != forest.root(y) and (exact or linked(x, y)) and forest.join(x, y):
                edges.append((x, y))
    return edges


def _candidates(percent: int):
    """Groups of rows (token, i, j, part, k, n, bits), sorted by the first three, to the rows that have a partner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, 3):
            if len(group) > 1:
                part, sizes = (group.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
                bitmaps = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(6)]
                across = group.column(1)[0].as_py() != group.column(2)[0].as_py()
                found = have_partners(bitmaps, sizes, percent, part if across else None)
                if found.any():
                    at = pa.array(np.flatnonzero(found))
                    yield pa.RecordBatch.from_arrays([group.column(k).take(at) for k in range(5)], names=["token", "i", "j", "part", "k"])

    return run


def _group_links(percent: int):
    """Groups of rows (token, i, j, part, k, shingles), sorted by the first three, to edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, 3):
            part = group.column(3).to_numpy(zero_copy_only=False)
            keys = group.column(4).to_numpy(zero_copy_only=False)
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(5)]
            across = group.column(1)[0].as_py() != group.column(2)[0].as_py()
            if len(sets) > 1 and (edges := spanning_links(sets, percent, part if across else None)):
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(keys[b])], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_shingles, class_id, component_id, root) for each row: links are 100 * intersection >= percent * union.

    class_id and component_id are the smallest ids of rows with the same set, and of rows reachable by links; `root` names
    the component without regard to ids, null where a row has no shingles.  Null or empty texts have no shingles and link
    with nothing, texts of fewer than `words` words have one (all their words), equal sets of any number are one class.
    Rows are told apart by row_key, the hash of id and text: rows that share an id but not the text are compared each for
    itself, a repeated row is a copy of itself, a null id is never the smallest unless there is no other.  Further columns
    are ignored, no rows give none.
    """
    spark = docs.sparkSession
    n_tasks = tasks(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("row_key"))
    keyed = staged(docs.mapInArrow(lean(_set_keys(words)), "doc_id long, row_key long, n long, k long, k2 long"), "sets", TEXT_ROWS)
    each = keyed.where("n > 0").groupBy("k", "k2", "n", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    classes = each.groupBy("k", "k2", "n").agg(F.min(F.struct("doc_id", "times")).alias("rep"), F.min("doc_id").alias("least"))
    classes = staged(classes.select("k", "k2", "n", F.col("rep.doc_id").alias("rep"), "rep.times", "least"), "classes")
    prefixes = docs.select("text").mapInArrow(lean(_prefixes(words, percent)), "token long, k long, n long").repartition("token")
    token = Window.partitionBy("token")
    shared = prefixes.withColumn("low", F.min("k").over(token)).withColumn("high", F.max("k").over(token)).where("low != high")
    shared = staged(shared.groupBy("token", "k", "n").agg(F.lit(1).alias("one")).select("token", "k", "n"), "shared", TEXT_ROWS)
    shared = staged(_peeled(shared, percent), "peeled")
    members = shared.groupBy("token").agg(F.sum(F.xxhash64("k").cast("decimal(38,0)")).alias("members"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"))
    kept = members.groupBy("members", "m", "shingles").agg(F.min("token").alias("token")).select("token", "shingles")
    # Blocks of a large group, by size; a group of one block has the single pair of blocks (0, 0).
    by_size = Window.partitionBy("token").orderBy("n", "k").rowsBetween(Window.unboundedPreceding, -1)
    group = shared.join(kept, "token").withColumn("part", F.floor(F.coalesce(F.sum("n").over(by_size), F.lit(0)) / BLOCK_SHINGLES))
    group = group.withColumn("other", F.explode(F.sequence(F.lit(0), F.floor(F.col("shingles") / BLOCK_SHINGLES))))
    group = group.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "k")
    group = staged(group.join(classes.select("k", "rep"), "k"), "groups")

    slot = F.xxhash64("rep").bitwiseAND(F.lit((1 << INVOLVED_BITS) - 1))
    # A set of bits of fixed size, 2**INVOLVED_BITS / 8 bytes, goes to the tasks.
    words_of = group.select(slot.alias("slot")).distinct().groupBy(F.shiftright("slot", 12).alias("page")).agg(F.bitmap_construct_agg(F.col("slot") % 4096).alias("bits"))
    bits = np.zeros(1 << (INVOLVED_BITS - 3), np.uint8)
    for r in words_of.select("page", F.substring("bits", 1, 512).alias("bits")).toLocalIterator():
        bits[r.page * 512 : (r.page + 1) * 512] = np.frombuffer(r.bits, np.uint8)
    spread = spark.sparkContext.broadcast(bits)
    needed = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("doc_id").alias("slot"), "text")
    needed = needed.mapInArrow(lean(lambda b: _needed_sets(words, spread.value)(b)), "rep long, k long, n long, bits binary, shingles binary")
    if (classes.agg(F.max("times")).first()[0] or 0) > 1:  # repeated rows bring a set once
        needed = needed.dropDuplicates(["rep", "k"])
    needed = staged(needed, "needed", TEXT_ROWS)
    place = ["token", "i", "j"]
    same = (F.col("g.k") == F.col("s.k")) & F.col("g.rep").eqNullSafe(F.col("s.rep"))
    rows = group.alias("g").join(needed.alias("s"), same).select(*(f"g.{c}" for c in place), "g.part", "g.k", "s.n", "s.bits")
    met = rows.repartition(n_tasks, *place).sortWithinPartitions(*place, "k").mapInArrow(lean(_candidates(percent)), "token long, i long, j long, part long, k long")
    met = staged(met, "candidates", TEXT_ROWS)
    members = met.groupBy(*place).agg(F.sum(F.xxhash64("k", "part").cast("decimal(38,0)")).alias("members"), F.count(F.lit(1)).alias("m"))
    kept = members.groupBy("members", "m").agg(F.min(F.struct(*place)).alias("at")).select("at.*")
    rows = met.join(kept, place).join(classes.select("k", "rep"), "k")
    rows = rows.alias("g").join(needed.alias("s"), same).select(*(f"g.{c}" for c in place), "g.part", "g.k", "s.shingles")
    rows = rows.repartition(n_tasks, *place).sortWithinPartitions(*place, "k")
    links = components(staged(rows.mapInArrow(lean(_group_links(percent)), "a long, b long"), "links", TEXT_ROWS))
    joined = classes.join(links.withColumnRenamed("id", "k"), "k", "left").withColumn("root", F.coalesce("component_id", "k")).drop("component_id")
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = joined.join(roots, "root").select("k", "k2", "n", F.col("least").alias("class_id"), "component_id", "root")
    found = keyed.join(of_class, ["k", "k2", "n"], "left")
    own = lambda c: F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col(c)).alias(c)
    return found.select("doc_id", "row_key", F.col("n").alias("n_shingles"), own("class_id"), own("component_id"), "root")
