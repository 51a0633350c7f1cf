"""Removal of repeated passages by relative Lempel-Ziv parsing against indexed reference blocks.

Documents are sequences of words; a window is `length` consecutive ones.  A window goes if its words also start in a document
with a smaller id, so only stretches of `length` words matter, and the parse seeks just the factors that can hold one.

1. Reference: documents are cut into overlapping blocks at content-defined anchors (the least hashed run of `gram` words of
   each window): a block is all that the windows of one anchor touch, `2 * length - gram` words at most.  Equal windows have
   equal anchors, so a block that doesn't share an anchor with a document has no factor of `length` words in common with it.
   Blocks are indexed by anchor and by the hash of all their words; the first document of each is found by aggregation, so
   that the copies of a block, however many, are factors as a whole without a comparison.
2. Parse: each further block of an anchor is factored against the anchor's first one: greedily, the longest stretch around
   the anchor that both share.  A factor of `length` words or more is a duplicate span.
3. Factor boundaries: windows that cross the end of a factor may still occur in another block of the anchor; they, and they
   alone, are looked up one by one, by aggregation of their hashes.
4. The spans of a document are joined, and the words they cover go.

Words and blocks are compared by 64-bit hashes, blocks and windows by two of them (the anchor's and their own).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_ROWS, U64, Rolling, lean, may_be_in, mix, row_key, signed, split_by, staged, text_buffer
from .suffix_dedup import LOW, _ragged, _sliding_min

#: Bytes of text hashed at once; a longer document comes in parts.
BLOCK = 1 << 19
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of BASE and of its inverse modulo 2**64."""
    up = np.full(size, BASE, np.uint64)
    down = np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Spans:
    """Hashes of any stretch of a sequence of scrambled 64-bit words, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, words: np.ndarray):
        up, self.down = _powers(1 << max(19, int(len(words)).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_bounds(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of UTF-8 texts that lie end to end, with the given bounds."""
    gap = np.ones(len(raw) + 2, bool)
    gap[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    return np.flatnonzero(~gap[1:-1] & (gap[:-2] | edge[:-1])), np.flatnonzero(~gap[1:-1] & (gap[2:] | edge[1:])) + 1


def _gaps(raw: np.ndarray) -> np.ndarray:
    return np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))


def _texts(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first text, last + 1, words of it that came before, word hashes, bounds in words) of blocks of BLOCK bytes.

    A text over BLOCK comes in parts that overlap by length - 1 words; a part grows until it holds `length` words.
    """
    i, n = 0, len(at) - 1
    while i < n:
        j = max(int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1, i + 1)
        begin, before, size = at[i], 0, BLOCK
        while True:
            end = at[j]
            if end - begin > size:
                gaps = _gaps(raw[begin : begin + size])
                if not len(gaps):
                    size *= 2
                    continue
                end = begin + gaps[-1]
            block = raw[begin:end]
            bounds = np.array([0, end - begin]) if j == i + 1 else at[i : j + 1] - begin
            starts, ends = word_bounds(block, bounds)
            if end < at[j] and len(starts) < length:
                size *= 2
                continue
            yield i, j, before, Rolling(block).span(starts, ends), np.searchsorted(starts, bounds)
            if end == at[j]:
                break
            begin, before, size = begin + starts[len(starts) - length + 1], before + len(starts) - length + 1, BLOCK
        i = j


def blocks(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int):
    """Blocks of texts words[lo[i]:hi[i]]: (text, first word, windows, words before the anchor, hash of the anchor, hash of all)."""
    keep = hi - lo >= length
    text, lo, hi = np.flatnonzero(keep), lo[keep], hi[keep]
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    spans = Spans(words)
    at = np.arange(len(words) - gram + 1)
    grams = spans(at, at + gram)
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
    return text[owner], starts, ends - starts, at[starts] - starts, grams[at[starts]], spans(starts, ends + length - 1)


def _cut_blocks(length: int, gram: int):
    names = ["doc_id", "text_key", "start", "n", "lead", "anchor", "rank"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, _, before, words, at in _texts(*text_buffer(batch.column(2)), length):
                text, start, n, lead, anchor, rank = blocks(words, at[:-1], at[1:], length, gram)
                if len(text):
                    of = i + text
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[of], keys[of], start - at[text] + before, n, lead, signed(anchor), signed(rank)))], names=names)

    return run


def _bodies(length: int):
    """Texts and the blocks wanted of them to one row a block, with the hashes of its words."""
    names = ["anchor", "rank", "doc_id", "text_key", "start", "n", "lead", "body"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            wanted = batch.column(3)
            doc = np.repeat(np.arange(len(ids)), np.diff(wanted.offsets.to_numpy()))
            start, n, lead, anchor, rank = (f.to_numpy(zero_copy_only=False) for f in wanted.flatten().flatten())
            order = np.lexsort((start, doc))
            doc, start, n, lead, anchor, rank = (x[order] for x in (doc, start, n, lead, anchor, rank))
            for i, j, before, words, at in _texts(*text_buffer(batch.column(2)), length):
                some = np.arange(*np.searchsorted(doc, (i, j)))
                size = n[some] + length - 1
                low = start[some] - before + at[doc[some] - i]
                whole = (start[some] >= before) & (low + size <= at[doc[some] - i + 1])
                some, size, low = some[whole], size[whole], low[whole]
                for part in np.array_split(np.arange(len(some)), len(some) // 5_000 + 1):
                    if len(part):
                        s, m = some[part], size[part]
                        body = words[np.repeat(low[part], m) + _ragged(m)]
                        offsets = np.concatenate([[0], np.cumsum(m * 8)]).astype(np.int32)
                        bodies = pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
                        yield pa.RecordBatch.from_arrays([*map(pa.array, (anchor[s], rank[s], ids[doc[s]], keys[doc[s]], start[s], n[s], lead[s])), bodies], names=names)

    return run


def factor(body: np.ndarray, at: np.ndarray, lead: np.ndarray, other: np.ndarray, other_at: np.ndarray, other_lead: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, last + 1), within each block, of the longest stretch around its anchor that the other block shares."""
    own, theirs = at[:-1] + lead, other_at[:-1] + other_lead

    def reach(n: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """Words that agree from a and b on, of n at most."""
        k = _ragged(n)
        row = np.repeat(np.arange(len(n)), n)
        differ = body[a[row] + step * k] != other[b[row] + step * k]
        out = n.copy()
        np.minimum.at(out, row[differ], k[differ])
        return out

    back = reach(np.minimum(lead, other_lead), own - 1, theirs - 1, -1)
    on = reach(np.minimum(at[1:] - own, other_at[1:] - theirs), own, theirs, 1)
    return lead - back, np.where(on < gram, lead - back, lead + on)


def _parse(length: int, gram: int):
    """Blocks beside the first block of their anchor to rows of spans (window null) and of windows at factor boundaries."""
    names = ["doc_id", "text_key", "start", "n", "anchor", "window"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            doc, key, start, n, lead, anchor, ref_doc, ref_lead, several = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(9))
            (raw, at), (other, other_at) = (text_buffer(batch.column(k)) for k in (9, 10))
            body, at, other, other_at = np.frombuffer(raw.tobytes(), np.uint64), at // 8, np.frombuffer(other.tobytes(), np.uint64), other_at // 8
            low, high = factor(body, at, lead, other, other_at, ref_lead, gram)
            found = np.maximum(high - low - length + 1, 0)  # windows inside the factor
            gone = np.flatnonzero((found > 0) & (ref_doc < doc))
            yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(key[gone]), pa.array(start[gone] + low[gone]), pa.array(found[gone]), pa.nulls(len(gone), pa.int64()), pa.nulls(len(gone), pa.int64())], names=names)
            m = np.where(several, n, 0)
            row, place = np.repeat(np.arange(len(m)), m), _ragged(m)
            across = (place < low[row]) | (place >= low[row] + found[row])
            row, place = row[across], place[across]
            if len(row):
                where = at[row] + place
                yield pa.RecordBatch.from_arrays([*map(pa.array, (doc[row], key[row], start[row] + place, np.ones(len(row), np.int64), anchor[row], signed(Spans(body)(where, where + length))))], names=names)

    return run


def _remove(length: int):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = text_buffer(batch.column(1))
            marks = batch.column(2)
            bounds, (start, n) = marks.offsets.to_numpy(), (f.to_numpy(zero_copy_only=False) for f in marks.values.flatten())  # null: no entry
            rows = []
            for i in range(len(batch)):
                text = raw[at[i] : at[i + 1]].copy()
                starts, ends = word_bounds(text, np.array([0, len(text)]))
                mine = slice(bounds[i], bounds[i + 1])
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, start[mine], 1)
                np.add.at(edge, start[mine] + n[mine] + length - 1, -1)
                kept = np.cumsum(edge[:-1]) == 0
                held = np.zeros(len(text) + 1, np.int8)
                np.add.at(held, starts[kept], 1)
                np.add.at(held, ends[kept], -1)
                held = np.cumsum(held[:-1], dtype=np.int8).view(bool)
                before = starts[kept][1:] - 1  # the gap before each kept word but the first becomes its one space
                text[before], held[before] = 32, True
                out = text[held].tobytes()
                rows.append((len(starts), int(len(starts) - kept.sum()), hashlib.sha256(out).hexdigest(), out))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=names)

    return run


def remove_passages(docs: DataFrame, length: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word [^\\x20\\x09-\\x0D]+ covered by `length` words in a row that also start in a document with a smaller id.

    Returns (doc_id, n_words, n_removed, kept_sha256, kept), one row for each input row; kept: the other words in UTF-8, joined
    by one space.  Windows are judged on the input.  Null or short texts lose nothing; documents of equal id aren't before
    each other, nor is a document before itself, so repeats within one stay; a null id comes before all others and matches as
    id -2**63; columns but the two named are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), row_key(id_col, text_col).alias("text_key"), F.col(text_col).alias("text"), F.col(id_col).alias("_id"))
    own = ["doc_id", "text_key"]
    place = "doc_id long, text_key long, start long, n long"
    runs = staged(docs.select(*own, "text").mapInArrow(_cut_blocks(length, gram), f"{place}, lead long, anchor long, rank long"), "passage-blocks", TEXT_ROWS)

    variants = runs.groupBy("anchor", "rank").agg(F.min(F.struct(*own, "start", "n", "lead")).alias("first"), F.max("doc_id").alias("last"))
    variants = staged(variants, "passage-variants")
    copied = variants.where("last > first.doc_id").select("anchor", "rank", F.col("first.doc_id").alias("first_doc"))
    whole = may_be_in(runs, "rank", copied.select(F.col("rank").alias("copied_rank")), "copied_rank")
    whole = whole.join(copied, ["anchor", "rank"]).where("doc_id > first_doc").select(*own, "start", "n")

    anchors = variants.groupBy("anchor").agg(F.min(F.struct("first", "rank")).alias("ref"), F.count(F.lit(1)).alias("variants")).where("variants > 1")
    anchors = staged(anchors.select("anchor", F.col("ref.rank").alias("ref_rank"), (F.col("variants") > 2).alias("several")), "passage-anchors")
    wanted = may_be_in(variants, "anchor", anchors.select(F.col("anchor").alias("shared")), "shared").join(anchors.select("anchor"), "anchor", "semi")
    wanted = staged(wanted.groupBy("first.doc_id", "first.text_key").agg(F.collect_list(F.struct("first.start", "first.n", "first.lead", "anchor", "rank")).alias("wanted")), "passage-wanted")
    held, _ = split_by(docs, "text_key", wanted.select(F.col("text_key").alias("wanted_key")), "wanted_key")
    held = held.dropDuplicates(own).join(wanted, own).select(*own, "text", "wanted")
    bodies = staged(held.mapInArrow(_bodies(length), f"anchor long, rank long, {place}, lead long, body binary"), "passage-bodies", TEXT_ROWS)
    told = bodies.join(anchors, "anchor")
    refs = told.where("rank = ref_rank").select("anchor", F.col("doc_id").alias("ref_doc"), F.col("lead").alias("ref_lead"), F.col("body").alias("ref_body"))
    pairs = told.where("rank <> ref_rank").join(refs, "anchor").select(*own, "start", "n", "lead", "anchor", "ref_doc", "ref_lead", "several", "body", "ref_body")
    parsed = staged(pairs.mapInArrow(_parse(length, gram), f"{place}, anchor long, window long"), "passage-factors")

    windows = parsed.where("window IS NOT NULL")
    met = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("last > first_doc")
    across = windows.join(met, ["anchor", "window"]).where("doc_id > first_doc").select(*own, "start", "n")
    spans = whole.union(parsed.where("window IS NULL").select(*own, "start", "n")).union(across)
    marks = staged(spans.groupBy(*own).agg(F.collect_set(F.struct("start", "n")).alias("marks")), "passage-marks")

    touched, clean = split_by(docs, "text_key", marks.select(F.col("text_key").alias("mark_key")), "mark_key")
    touched = touched.join(marks, own, "left").select("_id", "text", "marks")
    clean = clean.select("_id", "text", F.lit(None).cast(marks.schema["marks"].dataType).alias("marks"))
    kind = docs.schema["_id"].dataType.simpleString()
    return touched.union(clean).mapInArrow(_remove(length), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept binary")
