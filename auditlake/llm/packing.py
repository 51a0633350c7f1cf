"""Packing of tokenized documents into fixed-length sequences: shortest-pack-first over the length histogram.

Documents are tokenized where they lie and cut into pieces of at most `max_len` ids.
Only the histogram of piece lengths (max_len rows at most) goes to the driver, where lengths are
placed from the longest to the shortest, each into the packs with the most room, and counts of packing
patterns are updated.  A piece's rank among the pieces of its length then says which pack of which pattern it is in.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_ROWS, lean, staged
from .tokens import word_ids

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, place long"


def _pieces(path: str, max_len: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        coder, placed = word_ids(path), np.zeros(max_len + 1, np.int64)
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, len(whole), 512)):
                docs = batch.column(0)
                flat, counts = coder.encode([x or "" for x in batch.column(1).to_pylist()])
                rows, ids, at = [], [], 0
                for i, n in enumerate(counts.tolist()):
                    own = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                    at += n
                    for start in range(0, n + 1, max_len):
                        part = own[start : start + max_len]
                        rows.append((i, start, len(part), zlib.crc32(part), n + 1, placed[len(part)]))
                        placed[len(part)] += 1
                        if keep_ids:
                            ids.append(part)
                which, *columns = (pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True)) if rows else (pa.array([], pa.int64()) for _ in range(6))
                arrays = [docs.take(which), *columns[:4], pa.array(np.full(len(which), task, np.int32)), columns[4]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def plan_packs(histogram: dict[int, int], max_len: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, ranks, times in a pack, first pack, offset in it) for a histogram of lengths.

    Ranks [first, first + ranks) of a length fill consecutive packs from `first pack`, `times` to a pack.
    """
    room: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(space: int, pattern: tuple[tuple[int, int], ...], count: int) -> None:
        if space:
            room.setdefault(space, []).append((pattern, count))
        else:
            done.append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max(room, default=0)
            if space < length:
                put(max_len - length, ((length, 1),), left)
                break
            pattern, count = room[space].pop()
            if not room[space]:
                del room[space]
            used = min(left, count)
            if used < count:
                put(space, pattern, count - used)
            times = pattern[-1][1] + 1 if pattern[-1][0] == length else 1
            put(space - length, (*(pattern[:-1] if times > 1 else pattern), (length, times)), used)
            left -= used
    slots, ranks, pack = [], dict.fromkeys(histogram, 0), 0
    for pattern, count in [*done, *(x for space in sorted(room) for x in room[space])]:
        offset = 0
        for length, times in pattern:
            slots.append((length, ranks[length], count * times, times, pack, offset))
            ranks[length] += count * times
            offset += length * times
        pack += count
    return slots


def pack(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 1, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    tokenizer: path of a vocabulary of ranks.  Added tokens of the JSON file beside it have their own ids.  Each text is tokenized whole and ends with `end_id`; a null or empty text
    is that id alone, repeated rows are packed each, other columns are ignored, an empty table gives no rows.  Each id
    lies in exactly one piece, and the pieces of a sequence follow each other from offset 0 without gaps.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(source.mapInArrow(lean(_pieces(tokenizer, max_len, end_id, keep_ids), "words"), PIECE + ", ids array<int>" * keep_ids), "pieces", TEXT_ROWS)
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan_packs(histogram, max_len), "length long, first long, ranks long, times long, pack long, at long")
    before = counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "task"]).withColumn("rank", F.col("before") + F.col("place"))
    # Slots grow with max_len alone: fewer than max_len patterns are split off, of at most sqrt(2 * max_len) lengths each.
    slots = F.broadcast(slots.withColumnRenamed("length", "slot_length"))
    here = (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("ranks"))
    turn = F.col("rank") - F.col("first")
    placed = ranked.join(slots, here).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("pack") + F.floor(turn / F.col("times"))).alias("sequence_id"),
        (F.col("at") + turn % F.col("times") * F.col("length")).alias("offset"),
        *["ids"] * keep_ids,
    )
    return placed


def sequences(placed: DataFrame, max_len: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from pack(..., keep_ids=True): input_ids padded to max_len, and each id's doc_id."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    out = placed.groupBy("sequence_id").agg(parts.alias("parts"))
    pad = F.array_repeat(F.lit(pad_id), (F.lit(max_len) - F.expr("size(flatten(parts.ids))")).cast("int"))
    owner = F.expr("flatten(transform(parts, p -> array_repeat(p.doc_id, size(p.ids))))")
    return out.select("sequence_id", F.concat(F.expr("flatten(parts.ids)"), pad).alias("input_ids"), owner.alias("doc_ids"))
