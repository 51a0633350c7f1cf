"""What the corpus operators share: stage tables, Arrow text access, vectorised hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = spark.conf.get("auditlake.shared.dir", None)
        if folder is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="spark-auditlake-")
            spark.conf.set("auditlake.shared.dir", folder)
    return folder.rstrip("/")


#: Rows of an Arrow batch where whole texts go to Python workers: JVM and worker hold a batch of them each, for every task.
TEXT_ROWS = 1000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    batch_rows: rows of the Arrow batches while df is written, at most; the session's own setting if that is smaller.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/auditlake-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    if batch_rows and not 0 < int(before) <= batch_rows:
        spark.conf.set(BATCH_ROWS, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


#: What the tasks of a worker keep for later tasks of their kind, by kind: functions that let go of it.
KEPT: dict[str, Callable[[], None]] = {}


def forget(keeps: str | None = None) -> None:
    """Let go of what tasks of other kinds than `keeps` have kept, and give memory that is no longer needed back to the system."""
    for kind, let_go in KEPT.items():
        if kind != keeps:
            let_go()
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):  # Arrow's own, and the C heap
        pool.release_unused()


def lean(run, keeps: str | None = None):
    """An Arrow function that begins without what tasks of other kinds have kept, and gives memory back when its task ends.

    Workers stay for later tasks, of other stages too, and would keep the most that any of them took.
    """

    def wrapped(batches):
        forget(keeps)
        yield from run(batches)
        forget(keeps)

    return wrapped


def tasks(spark: SparkSession) -> int:
    """Partitions for stages whose work isn't in proportion to their bytes, which would be merged by bytes if left open."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(id_col: str, text_col: str) -> Column:
    """A key of a row by its id and whole text, never null: tells rows apart that share an id."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


#: Bits of the fixed-size table that prunes before a join, in words of 64.
BITS = 1 << 24


def _with_bit(rows: DataFrame, column: str, keys: DataFrame, key: str, how: str) -> DataFrame:
    spread = lambda c: F.expr(f"pmod(xxhash64({c}), {BITS})")
    bits = keys.select(spread(key).alias("_at")).groupBy(F.expr("_at div 64").alias("_slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 AS int))")).alias("_bits"))
    held = rows.withColumn("_at", spread(column)).join(F.broadcast(bits), F.expr("_at div 64") == F.col("_slot"), how)
    return held.withColumn("_may", F.expr("coalesce(shiftright(_bits, cast(_at % 64 AS int)) & 1L = 1L, false)"))


def may_be_in(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column is among the keys, and a few others: by a broadcast table of BITS bits at most."""
    return _with_bit(rows, column, keys, key, "inner").where("_may").drop("_at", "_slot", "_bits", "_may")


def split_by(rows: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rows that may_be_in() keeps, all others): the others needn't be shuffled."""
    told = _with_bit(rows, column, keys, key, "left")
    rest = lambda df: df.drop("_at", "_slot", "_bits", "_may")
    return rest(told.where("_may")), rest(told.where("NOT _may"))


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame returned by staged(), once nothing reads it any more."""
    path = getattr(df, "staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all values, n + 1 offsets into them) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finalizer constants of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Substrings are hashed by two polynomials modulo this prime, which don't share the collisions of arithmetic modulo 2**64.
PRIME = (1 << 31) - 1
BASES = (1_513_477_735, 906_150_257)
#: Entries of a table of powers that a worker keeps from one block to the next.
KEPT_POWERS = 1 << 20
#: Elements worked on at once, so that they stay in the processor's cache.
NEAR = 1 << 15


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, not fully reduced."""
    return (x & U64(PRIME)) + (x >> U64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = _fold(_fold(x))
    x -= U64(PRIME) * (x >= U64(PRIME))
    return x


@lru_cache(maxsize=1)
def byte_words() -> np.ndarray:
    """One pseudo-random word below PRIME for each byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) % U64(PRIME)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo PRIME; a worker keeps one table for each base, of KEPT_POWERS entries at most."""
    out = _POWERS.get(base, np.ones(1, np.uint32))
    while len(out) < n:
        out = np.concatenate([out, _reduced(out * U64(pow(base, len(out), PRIME))).astype(np.uint32)])
    if len(out) <= KEPT_POWERS:
        _POWERS[base] = out
    return out[:n]


class Rolling:
    """Hashes of any substring of bytes, or of code points (fewer than 2**31), by prefix sums of two polynomials."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        size = 1 << max(12, int(n).bit_length())
        self.sides = [(np.zeros(n + 1, np.uint64), powers(pow(base, -1, PRIME), size)) for base in BASES]
        table, up = byte_words(), [powers(base, size) for base in BASES]
        for a in range(0, n, NEAR):
            words = raw[a : a + NEAR]
            words = table[words] if raw.dtype == np.uint8 else mix(words.astype(np.uint64) + U64(1)) % U64(PRIME)
            for power, (prefix, _) in zip(up, self.sides, strict=True):
                terms = words * power[a : a + len(words)]
                terms = np.add(terms & U64(PRIME), terms >> U64(31), out=terms)
                terms[0] += prefix[a]
                np.cumsum(terms, out=prefix[a + 1 : a + 1 + len(words)])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of raw[start:end], for arrays of starts and ends; mixes the length in."""
        out = np.empty(len(start), np.uint64)
        for a in range(0, len(start), NEAR):
            s, e = start[a : a + NEAR], end[a : a + NEAR]
            high, low = (_reduced(_fold(_fold(prefix[e] - prefix[s])) * down[s]) for prefix, down in self.sides)
            out[a : a + NEAR] = mix(((high << U64(32)) | low) + (e - s).astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def key_groups(batches, keys: int):
    """Runs of equal values in the first `keys` columns of sorted batches, each as one record batch.

    A group may span batches; only the group at hand is held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(n, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(i)[len(held[-1]) - 1].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield pa.concat_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < n:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pa.concat_batches(held)
