"""Exact removal of repeated byte strings by blockwise suffix grouping under a content-defined cover.

Every string of `length` bytes is a suffix prefix to be grouped with its equals.
Sorting all suffixes at once doesn't fit, so suffixes are dealt into buckets and
each bucket is sorted by itself.  A difference cover guarantees that two equal
strings contain a sampled position at the same offset; here the cover is
content-defined (the position of the smallest hashed `gram`-byte substring in the
string), which gives the same guarantee for equal strings with about
2 / (length - gram + 2) of all positions, where the smallest modular cover
needs about 1.5 / sqrt(length) of them.

1. Cover: each run of consecutive strings that share a sampled position becomes
   one row: bucket key (hash of the sampled gram) and rank key (hash of all bytes
   that the run's strings touch).
2. Buckets are sorted by (bucket key, rank key, document, start).  A run whose rank
   key occurred earlier repeats as a whole: the precomputed rank resolves its ties,
   however long.  A run whose bucket holds no other rank key is unique.
3. Only the remaining runs bring their bytes to the buckets, where their strings are
   compared one by one in (document, start) order; a bucket with very many of them is
   dealt out once more, to a bucket for each string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, mix, row_key, signed, staged, tasks, text_buffer

#: Bytes hashed at once; positions within a block fit the low 20 bits of a key.
BLOCK = 1 << 19
LOW = np.uint64((1 << 20) - 1)
#: A run is kept as start * 2**N_BITS + strings; it holds at most length - gram + 1 strings.
N_BITS = 12
#: Undecided runs of a bucket beyond which it is dealt out by string.
WIDE = 4096


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def cover_runs(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int):
    """Runs of windows [s, s + n) of a block: (index of the part, s, n, bucket key, rank key).

    lo and hi bound the block's parts (documents); windows of `length` bytes lie within a part.
    """
    keep = hi - lo >= length
    part, lo, hi = np.flatnonzero(keep), lo[keep], hi[keep]
    if not len(part):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    roll = Rolling(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = roll.span(at, at + gram)
    keys = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    at = (_sliding_min(keys, length - gram + 1) & LOW).astype(np.int64)
    new = np.ones(len(at), bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[lo] = True
    inside = np.zeros(len(at) + 1, np.int32)
    inside[lo] += 1
    np.add.at(inside, hi - length + 1, -1)
    starts = np.flatnonzero(new & (np.cumsum(inside[:-1]) > 0))
    owner = np.searchsorted(lo, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(at)), hi[owner] - length + 1)
    return part[owner], starts, ends - starts, grams[at[starts]], roll.span(starts, ends + length - 1)


def _blocks(at: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last + 1, first byte, last + 1) of blocks; a document over BLOCK comes in overlapping parts."""
    i, n = 0, len(at) - 1
    while i < n:
        if at[i + 1] - at[i] > BLOCK:
            begin = at[i]
            while begin + length <= at[i + 1]:
                yield i, i + 1, begin, min(begin + BLOCK, at[i + 1])
                begin += BLOCK - length + 1
            i += 1
            continue
        j = int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1
        yield i, max(j, i + 1), at[i], at[max(j, i + 1)]
        i = max(j, i + 1)


def _cover(length: int, gram: int):
    names = ["doc_id", "text_key", "place", "bucket", "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_key = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            text = batch.column(2)
            order = np.lexsort((text_key, ids))
            if (order[1:] < order[:-1]).any():
                ids, text_key, text = ids[order], text_key[order], text.take(pa.array(order))
            raw, at = text_buffer(text)
            for i, j, begin, end in _blocks(at, length):
                lo, hi = np.maximum(at[i:j], begin) - begin, np.minimum(at[i + 1 : j + 1], end) - begin
                part, start, n, bucket, rank = cover_runs(raw[begin:end], lo, hi, length, gram)
                if not len(part):
                    continue
                doc, of, start = ids[i + part], text_key[i + part], start + begin - at[i + part]
                # Rows are in (document, start) order, so of equal runs in a block the first is the earliest;
                # the others are settled here and don't go to the bucket: a hot bucket gets one row a block.
                _, first, same = np.unique(bucket * np.uint64(3) + rank, return_index=True, return_inverse=True)
                first = first[same]
                known = (doc != doc[first]) | (of != of[first]) | (start != start[first])
                bucket = np.where(known, np.arange(len(doc), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ bucket, bucket)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(of), pa.array((start << N_BITS) | n), pa.array(signed(bucket)), pa.array(signed(rank), mask=known)], names=names)

    return run


def _ragged(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _bodies(length: int):
    """Text and undecided runs of each document to one row a run, with the bytes that its strings touch.

    A run of a wide bucket is dealt out further, to a bucket for each string; of equal strings in a batch, only the
    first goes there.
    """
    names = ["bucket", "doc_id", "text_key", "start", "n", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, of = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            raw, at = text_buffer(batch.column(2))
            runs = batch.column(3)
            doc = np.repeat(np.arange(len(ids)), np.diff(runs.offsets.to_numpy()))
            place, bucket, wide = (f.to_numpy(zero_copy_only=False) for f in runs.flatten().flatten())
            start, n, wide = place >> N_BITS, place & ((1 << N_BITS) - 1), wide.astype(bool)
            fits = start + n + length - 1 <= at[doc + 1] - at[doc]
            for part in (np.flatnonzero(fits & ~wide), np.flatnonzero(fits & wide)):
                for some in np.array_split(part, len(part) // 5_000 + 1):
                    if not len(some):
                        continue
                    d, s, m, key = doc[some], start[some], n[some], bucket[some]
                    low = at[d] + s
                    size = m + length - 1
                    body = raw[np.repeat(low, size) + _ragged(size)]
                    if wide[some[0]]:
                        where = np.repeat(np.cumsum(size) - size, m) + _ragged(m)
                        string = Rolling(body).span(where, where + length)
                        d, key, s = np.repeat(d, m), np.repeat(key, m), np.repeat(s, m) + _ragged(m)
                        key = (mix(key.view(np.uint64)) ^ string).view(np.int64)
                        order = np.lexsort((s, of[d], ids[d]))
                        d, key, s, where = d[order], key[order], s[order], where[order]
                        _, first, same = np.unique(key, return_index=True, return_inverse=True)
                        known = (ids[d] != ids[d][first[same]]) | (of[d] != of[d][first[same]]) | (s != s[first[same]])
                        yield pa.RecordBatch.from_arrays([*map(pa.array, (s[known] ^ key[known], ids[d][known], of[d][known], s[known], np.ones(known.sum(), np.int64))), pa.nulls(int(known.sum()), pa.binary())], names=names)
                        d, key, s, where = d[~known], key[~known], s[~known], where[~known]
                        m, size = np.ones(len(d), np.int64), np.full(len(d), length)
                        body = body[np.repeat(where, size) + _ragged(size)]
                    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    bodies = pa.BinaryArray.from_buffers(pa.binary(), len(d), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (key, ids[d], of[d], s, m)), bodies], names=names)

    return run


def _settle(length: int):
    """Runs in (bucket, document, start) order to the runs of their strings that occurred earlier in the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, begun = None, np.zeros(0, np.uint64), (None, None, None)
        for batch in batches:
            bucket, doc, of, start, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5))
            raw, at = text_buffer(batch.column(5))
            if not len(bucket):
                continue
            known = np.diff(at) == 0
            m = np.where(known, 0, n)
            row = np.repeat(np.arange(len(m)), m)
            begin = np.repeat(at[:-1], m) + _ragged(m)
            string = Rolling(raw).span(begin, begin + length)
            key = mix(bucket[row].view(np.uint64)) ^ string
            place = start[row] + _ragged(m)
            repeat = np.zeros(len(key), bool)
            if len(key):
                _, first, same = np.unique(key, return_index=True, return_inverse=True)
                first = first[same]
                repeat = (doc[row] != doc[row][first]) | (of[row] != of[row][first]) | (place != place[first])
                if bucket[0] == last:
                    head = bucket[row] == last
                    old = head & np.isin(key, seen)
                    # A repeated input row isn't earlier than itself.
                    repeat |= old & ~((doc[row] == begun[0]) & (of[row] == begun[1]) & (place == begun[2]))
                tail = key[bucket[row] == bucket[-1]]
                seen = np.union1d(seen, tail) if bucket[-1] == last else np.unique(tail)
                begun = (doc[row[-1]], of[row[-1]], place[-1])
            last = bucket[-1]
            at_row = np.flatnonzero(repeat)
            cut = np.flatnonzero((np.diff(at_row) != 1) | (np.diff(row[at_row]) != 0)) + 1 if len(at_row) else np.zeros(0, np.int64)
            heads = np.concatenate([[0], cut]).astype(np.int64) if len(at_row) else cut
            counts = np.diff(np.append(heads, len(at_row)))
            docs, keys = (np.concatenate([x[row[at_row[heads]]], x[known]]) for x in (doc, of))
            places = np.concatenate([(place[at_row[heads]] << N_BITS) | counts, (start[known] << N_BITS) | n[known]])
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(keys), pa.array(places)], names=["doc_id", "text_key", "place"])

    return run


def removed_mask(size: int, start: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which bytes go, given the runs [start, start + n) of strings that occurred earlier."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + n + length - 1, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(length: int):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            raw, at = text_buffer(batch.column(1))
            lists = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in (batch.column(k).fill_null([]) for k in (2, 3))]
            sizes, gone, spans, digests, kept = [], [], [], [], []
            for i in range(len(ids)):
                text = raw[at[i] : at[i + 1]]
                place = np.concatenate([values[bounds[i] : bounds[i + 1]] for bounds, values in lists]).astype(np.int64)
                start, n = place >> N_BITS, place & ((1 << N_BITS) - 1)
                size = len(text)
                out, n_gone, n_spans = text, 0, 0
                if len(start):
                    fits = start + n + length - 1 <= size
                    mask = removed_mask(size, start[fits], n[fits], length)
                    n_gone = int(mask.sum())
                    n_spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                    out = text[~mask]
                out = out.tobytes()
                sizes.append(size)
                gone.append(n_gone)
                spans.append(n_spans)
                digests.append(hashlib.sha256(out).hexdigest())
                kept.append(out)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                names=names,
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts earlier (smaller id, or same id and earlier start).

    Returns (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row for each input row; `kept` holds the
    remaining bytes, which may end inside a character.  Null or short texts lose nothing; rows that repeat an id and its
    text aren't earlier than each other; rows that share an id but not the text are documents of their own, in the order of
    their texts' hashes; a null id sorts before all others and matches as id -2**63; columns but the two named are ignored.
    Work: one pass over the text, a shuffle of its sampled positions (about 1 in 39), a shuffle of texts.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), row_key(id_col, text_col).alias("text_key"), F.col(text_col).alias("text"))
    keys = docs.groupBy("doc_id").agg((F.min("text_key") != F.max("text_key")).alias("several"))
    if not keys.where("several").limit(1).count():  # an id names its text: the key needn't travel with each row
        docs = docs.withColumn("text_key", F.lit(0).cast("long"))
    own, n_tasks = ["doc_id", "text_key"], tasks(docs.sparkSession)
    runs = docs.mapInArrow(_cover(length, gram), "doc_id long, text_key long, place long, bucket long, rank long").repartition("bucket")
    bucket = Window.partitionBy("bucket")
    known = F.col("rank").isNull()
    ranked = (
        runs.withColumn("earliest", F.min(F.struct(*own, "place")).over(Window.partitionBy("bucket", "rank")))
        .withColumn("whole", known | (F.col("earliest") < F.struct(*own, "place")))
        .withColumn("low", F.min("rank").over(bucket))
        .withColumn("high", F.max("rank").over(bucket))
        .withColumn("wide", F.count(F.when(~F.col("whole"), 1)).over(bucket) > WIDE)
    )
    open_run = F.when(~F.col("whole"), F.struct("place", "bucket", "wide"))
    marks = ranked.where("whole or low != high").groupBy(*own)
    marks = staged(marks.agg(F.collect_list(F.when(F.col("whole"), F.col("place"))).alias("whole"), F.collect_list(open_run).alias("runs")), "repeats")
    bodies = docs.join(marks.select(*own, "runs").where("size(runs) > 0"), own)
    bodies = bodies.mapInArrow(_bodies(length), "bucket long, doc_id long, text_key long, start long, n long, body binary")
    parts = bodies.repartition(n_tasks, "bucket").sortWithinPartitions("bucket", *own, "start").mapInArrow(_settle(length), "doc_id long, text_key long, place long")
    parts = parts.groupBy(*own).agg(F.collect_list("place").alias("parts"))
    joined = docs.join(marks.select(*own, "whole"), own, "left").join(parts, own, "left").select("doc_id", "text", "whole", "parts")
    return joined.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
