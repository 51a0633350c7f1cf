"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

Filter directions are the products of short random codes: a vector is turned by a random rotation and cut in two
halves, each half has a code of random unit vectors, and any pair of codewords is a direction.  A vector is
list-decoded to all directions that exceed a threshold: codewords are sorted by their inner products, and sums that
can't reach the threshold are never formed.  Vectors that meet in a direction are compared exactly.

A pair is counted in its first common direction only.  A direction's vectors give link counts and a spanning forest,
never all pairs; one that holds very many is dealt out as pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key_groups, staged
from .components import components

#: Random rotations, each with a product code of its own.
ROTATIONS = 8
#: Directions that a vector exceeds, on average; and vectors that a direction holds, on average, where there are enough.
MEAN_FILTERS, MEAN_HELD = 32, 128
#: Vectors of a direction that one task compares with each other.
BLOCK = 2048


class ProductCode:
    """Directions for n vectors of `dims` dimensions: the number of codewords and the threshold follow from n."""

    def __init__(self, dims: int, n: int, seed: int = 11):
        share = min(0.02, MEAN_HELD / max(n, 1))
        rng = np.random.default_rng(seed)
        self.half = max(dims // 2, 1)
        self.words = max(2, math.ceil(math.sqrt(MEAN_FILTERS / share / ROTATIONS)))
        self.turns = [np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(ROTATIONS)]
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        self.codes = [(unit(rng.normal(size=(self.words, self.half))), unit(rng.normal(size=(self.words, max(dims - self.half, 1))))) for _ in range(ROTATIONS)]
        # The threshold that random vectors exceed in the wanted share of directions.
        x = rng.normal(size=(256, dims))
        s, t = ((unit(x)[:, part] @ code.T)[:, : 4_000_000 // 256 // min(self.words, 250)] for part, code in zip((slice(self.half), slice(self.half, None)), self.codes[0], strict=True))
        self.threshold = np.quantile(s[:, :, None] + t[:, None, :], 1 - share) if dims > 1 else 0.0

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) for all directions that the rows of x exceed, by row and direction."""
        rows, found = [], []
        for r, (turn, (a, b)) in enumerate(zip(self.turns, self.codes, strict=True)):
            y = x @ turn
            s, t = y[:, : self.half] @ a.T, y[:, self.half :] @ b.T if x.shape[1] > self.half else np.zeros((len(x), self.words))
            # Only codewords that reach the threshold with the other half's best.
            i, p = np.nonzero(s + t.max(1, keepdims=True) >= self.threshold)
            for some in np.array_split(np.arange(len(i)), len(i) * self.words // 4_000_000 + 1):
                k, q = np.nonzero(s[i[some], p[some]][:, None] + t[i[some]] >= self.threshold)
                rows.append(i[some][k])
                found.append((r * self.words + p[some][k]).astype(np.int64) * self.words + q)
        rows, found = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((found, rows))
        return rows[order], found[order]


def _vectors(column: pa.Array, kind: type) -> tuple[np.ndarray, list[np.ndarray]]:
    """Indices of usable vectors, and those."""
    at, out = [], []
    flat = column.flatten()
    if not flat.null_count and not column.null_count and len(column):
        values = flat.to_numpy(zero_copy_only=False).astype(kind)
        cuts = np.cumsum(column.value_lengths().to_numpy())[:-1]
        every = np.split(values, cuts)
    else:
        every = [None if v is None or None in v else np.array(v, kind) for v in column.to_pylist()]
    for i, v in enumerate(every):
        if v is not None and len(v) and np.isfinite(v).all() and v.any():
            at.append(i)
            out.append(v)
    return np.array(at, np.int64), out


def _usable(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = _vectors(batch.column(1), kind)
            body: list[bytes | None] = [None] * len(batch)
            for i, v in zip(at.tolist(), vectors, strict=True):
                body[i] = (v + kind(0)).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], names=["vec_id", "body"])

    return run


def _unit(bodies: pa.Array, kind: type) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack([np.frombuffer(b.as_buffer(), kind) for b in bodies]).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode(dims: int, n: int, kind: type):
    """Adds to each row the ordered list of the directions that its vector exceeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = ProductCode(dims, n)
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, len(whole), 1000)):
                row, found = code.decode(_unit(batch.column(2), kind))
                bounds = np.searchsorted(row, np.arange(len(batch) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(found))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["rep", "copies", "body", "directions"])

    return run


def _compare(cosine: float, kind: type):
    names = ["rep", "links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, 3):
            i, j = (group.column(k)[0].as_py() for k in (1, 2))
            part, rep, copies = (group.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            if len(rep) < 2:
                continue
            x = _unit(group.column(6), kind)
            every, index = np.unique(group.column(7).flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            owner = np.repeat(np.arange(len(rep)), group.column(7).value_lengths().to_numpy(zero_copy_only=False))
            up, links = list(range(len(rep))), np.zeros(len(rep), np.int64)

            def root(k: int, up=up) -> int:
                while up[k] != k:
                    up[k] = up[up[k]]
                    k = up[k]
                return k

            for a in range(0, len(rep), 512):
                rows = slice(a, a + 512)
                near = x[rows] @ x.T >= cosine
                own = np.arange(a, min(a + 512, len(rep)))
                near[own - a, own] = False
                if i != j:
                    near &= part[rows][:, None] != part[None, :]
                if not near.any():
                    continue
                hit, other = np.nonzero(near)
                # Pairs that also meet in an earlier direction were counted there.
                linked, others = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                mine, theirs = np.full(len(rep), -1), np.full(len(rep), -1)
                mine[linked + a], theirs[others] = np.arange(len(linked)), np.arange(len(others))
                used = np.unique(index[mine[owner] >= 0])
                column = np.full(len(every), -1)
                column[used] = np.arange(len(used))
                have = []
                for chosen, n in ((mine, len(linked)), (theirs, len(others))):
                    shown = (chosen[owner] >= 0) & (column[index] >= 0)
                    have.append(np.zeros((n, len(used)), np.float32))
                    have[-1][chosen[owner[shown]], column[index[shown]]] = 1
                fresh = near[np.ix_(linked, others)] & ~(have[0] @ have[1].T > 0)
                links[linked + a] += fresh @ copies[others]
                # Each row's smallest neighbour, and then only links between parts that aren't connected yet.
                for h, o in zip(hit.tolist(), other.tolist(), strict=True) if len(hit) < 4 * len(rep) else _sparse(near):
                    p, q = root(h + a), root(o)
                    if p != q:
                        up[max(p, q)] = min(p, q)
            roots = np.array([root(k) for k in range(len(rep))])
            low = np.full(len(rep), np.iinfo(np.int64).max)
            np.minimum.at(low, roots, rep)
            keep = (links > 0) | (low[roots] != rep)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(rep[keep]), pa.array(links[keep]), pa.array(low[roots][keep])], names=names)

    return run


def _sparse(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that connect what a dense block of links connects: breadth first over its rows."""
    rows, columns = near.shape
    todo = np.ones(rows, bool)
    while todo.any():
        h = int(np.flatnonzero(todo)[0])
        todo[h] = False
        reach = near[h].copy()
        yield from ((h, int(o)) for o in np.flatnonzero(reach))
        while True:
            new = np.flatnonzero(todo & (near & reach[None, :]).any(1))
            if not len(new):
                break
            for k in new.tolist():
                yield k, int(np.flatnonzero(near[k] & reach)[0])
                fresh = near[k] & ~reach
                yield from ((k, int(o)) for o in np.flatnonzero(fresh))
                reach |= fresh
            todo[new] = False


def near_vectors(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; links are pairs of cosine >= `cosine` in double precision.

    Vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing, nor do vectors of other
    lengths than the most frequent one's with those; equal vectors are compared once and count each; a repeated row is
    another vector with the same id; a row without id links with nothing, has no component and isn't kept; further columns are
    ignored; no rows give none.
    Pairs above the threshold are found with a probability that grows with their cosine (README: measured recall).
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    kind = np.float32 if dict(rows.dtypes)["v"] == "array<float>" else np.float64
    usable = rows.mapInArrow(_usable(kind), "vec_id long, body binary")
    usable = staged(usable.withColumn("body", F.when(F.col("vec_id").isNotNull(), F.col("body"))), "vectors")
    classes = staged(usable.where("body is not null").groupBy("body").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    sizes = classes.groupBy(F.octet_length("body").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max("copies").alias("most")).collect()
    found = None
    for size in sorted(sizes, key=lambda r: r.size):
        here = _search(classes.where(F.octet_length("body") == size.size), kind, size.size // np.dtype(kind).itemsize, size.n, cosine)
        found = here if found is None else found.union(here)
    if found is None:
        return usable.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = staged(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select("rep", "root"), "rep", "root").withColumnRenamed("id", "rep")
    of_class = classes.join(links, "rep", "left").join(joined, "rep", "left")
    of_class = of_class.select("body", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = usable.join(of_class, "body", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _search(classes: DataFrame, kind: type, dims: int, n: int, cosine: float) -> DataFrame:
    """(rep, links, root) of vectors of one length: links found, and the smallest id that a vector was connected with.

    Directions are listed once a vector, and counted from the lists alone; only then are vectors sent to their
    directions, each with those of its directions that come before.
    """
    rows = classes.select("rep", "copies", "body").repartition("rep")
    lists = staged(rows.mapInArrow(_decode(dims, n, kind), "rep long, copies long, body binary, directions array<long>"), "directions")
    counts = lists.select(F.explode("directions").alias("direction")).groupBy("direction").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    # Directions of several blocks are few: Spark broadcasts this table if it is small enough, and shuffles it else.
    large = staged(counts.where("blocks > 1"), "large-directions")
    met = lists.select("rep", "copies", "body", "directions", F.posexplode("directions").alias("place", "direction"))
    met = met.withColumn("directions", F.expr("slice(directions, 1, place)")).join(large, "direction", "left")
    blocks = F.coalesce("blocks", F.lit(1).cast("long"))
    met = met.withColumn("part", F.pmod(F.xxhash64("rep", "direction"), blocks))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.select("direction", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "copies", "body", "directions")
    met = met.repartition("direction", "i", "j").sortWithinPartitions("direction", "i", "j", "rep")
    return met.mapInArrow(_compare(cosine, kind), "rep long, links long, root long")
