"""Limits and budgets as keyed state of a stream: state in RocksDB, timers on event time, time to live.

Results are appended by the file sink, whose log and the stream's checkpoint lie in one folder: a stream that stops goes on
from there, with the same rows as one that never stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .changes import BUCKETS, refill, work_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How late an event may be: the watermark of limits stays this far behind the latest event.
LATENESS = "1 hour"
#: How long a scan's budget is kept after its last file.
BUDGET_DAYS = 7


def run_to_end(out: DataFrame, folder: str, idle: bool = True) -> DataFrame:
    """Append a stream of results to the files of a folder, over what input there is; returns all results so far.

    idle: whether batches without input run too, which move timers on; with state that goes by the clock there is no last one.
    """
    spark = out.sparkSession
    wanted = {PROVIDER: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        query = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


class Limiter(StatefulProcessor):
    """Token buckets of one key; a key whose buckets are all full again is forgotten, which changes nothing."""

    LONGEST = max(period for _, _, period in BUCKETS)
    OUTPUT = "k string, kind string, event_id long, allowed boolean, wait_seconds long, limit_type string, at double, minute long, hour long, day long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buckets", "last double, minute double, hour double, day double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = sorted((at, event) for frame in rows for at, event in zip(frame["at"].tolist(), frame["event_id"].tolist(), strict=True))
        if not events:
            return
        held = self.state.get() if self.state.exists() else None
        tokens = list(held[1:]) if held else [float(cap) for _, cap, _ in BUCKETS]
        last = held[0] if held else events[0][0]
        out = []
        for at, event in events:
            tokens, last, waits = refill(tokens, last, at)
            if waits:
                out.append((key[0], "call", int(event), False, int(max(w for w, _ in waits)), waits[0][1], at, None, None, None))
            else:
                tokens = [t - 1 for t in tokens]
                out.append((key[0], "call", int(event), True, 0, None, at, None, None, None))
        out.append((key[0], "stats", None, None, None, None, last, *map(int, tokens)))
        self.state.update((last, *tokens))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + self.LONGEST) * 1000) + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in self.OUTPUT.split(", ")], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited(stream: DataFrame, key: str = "project_id", folder: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """All rows of a limiter over a stream (key, event_id, ts): one of kind `call` an event, one of kind `stats` a key and batch.

    Events of a batch count in the order of time and id; of an event that comes later than the watermark no row is made.
    Once the watermark is a day past a key's last event its state goes.  A folder that was used before is gone on from.
    """
    folder = folder or work_folder(stream.sparkSession, "limits")
    rows = stream.select(F.col(key).cast("string").alias("k"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    out = rows.withWatermark("ts", lateness).groupBy("k").transformWithStateInPandas(Limiter(), Limiter.OUTPUT, "Append", "EventTime")
    return run_to_end(out, folder).withColumn(key, F.col("k").cast("long")).drop("k")


def rate_limit_stream(stream: DataFrame, key: str = "project_id", folder: str | None = None) -> DataFrame:
    """rate_limit() over a stream, by keyed state."""
    return limited(stream, key, folder).where("kind = 'call'").select(key, "event_id", "allowed", "wait_seconds", "limit_type")


def limiter_stats(stream: DataFrame, key: str = "project_id", folder: str | None = None) -> DataFrame:
    """(key, minute, hour, day, total_calls): whole tokens that each key is left with after its last event, and allowed calls so far."""
    rows = limited(stream, key, folder)
    last = F.max_by(F.when(F.col("kind") == "stats", F.struct("minute", "hour", "day")), F.when(F.col("kind") == "stats", F.col("at")))
    return rows.groupBy(key).agg(last.alias("s"), F.count_if("allowed").alias("total_calls")).select(key, "s.*", "total_calls")


class Budget(StatefulProcessor):
    """Files and cost of one scan so far, and whether it has stopped."""

    OUTPUT = "k string, file_no long, cost double"

    def __init__(self, limit: float, batch: int, days: int):
        self.limit, self.batch, self.days = limit, batch, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("spent", "files long, spent double, stopped boolean", self.days * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        files, spent, stopped = self.state.get() if self.state.exists() else (0, 0.0, False)
        out = []
        for n, cost in sorted((n, cost) for frame in rows for n, cost in zip(frame["file_no"].tolist(), frame["paid"].tolist(), strict=True)):
            if stopped:
                break
            files, spent = files + 1, spent + cost
            out.append((key[0], int(n), cost))
            stopped = files % self.batch == 0 and round(spent, 9) > self.limit
        self.state.update((int(files), float(spent), bool(stopped)))
        if out:
            yield pd.DataFrame(out, columns=["k", "file_no", "cost"])

    def close(self) -> None:
        pass


def budget_stream(stream: DataFrame, limit: float = 1.0, batch: int = 10, folder: str | None = None, days: int = BUDGET_DAYS) -> DataFrame:
    """The rows (scan_id, file_no, cost) of a stream that are analysed before their scan is over its budget, by keyed state.

    A scan stops after a group of `batch` files with which its cost exceeds the limit; a null cost is none.  Files of a batch
    count in the order of their numbers.  A scan without files for `days` days is forgotten.
    """
    folder = folder or work_folder(stream.sparkSession, "budget")
    rows = stream.select(F.col("scan_id").cast("string").alias("k"), "file_no", F.coalesce("cost", F.lit(0.0)).alias("paid"))
    out = rows.groupBy("k").transformWithStateInPandas(Budget(limit, batch, days), Budget.OUTPUT, "Append", "ProcessingTime")
    return run_to_end(out, folder, idle=False).select(F.col("k").cast("long").alias("scan_id"), "file_no", "cost")
