"""Change streams: filtering, counts over event time, rescans of changed files, rate limits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.severity import watch_path

#: Capacity and period in seconds of the buckets, in the order in which they are reported.
BUCKETS = (("minute", 10, 60.0), ("hour", 100, 3600.0), ("day", 500, 86400.0))


def read_changes(spark: SparkSession, folder: str, schema, pattern: str) -> DataFrame:
    """A stream of event rows from parquet files, with `ts` as a timestamp of the session zone."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def watched(events: DataFrame) -> DataFrame:
    """Events whose paths a watcher follows; for batches and streams."""
    return events.where(watch_path(F.col("path")))


def event_counts(events: DataFrame, window: str = "1 day", watermark: str | None = "1 day") -> DataFrame:
    """Counts per tumbling window and type; rows later than the watermark are dropped from a stream."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming and watermark else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


def distinct_paths(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count_distinct("path").alias("paths"), F.count(F.lit(1)).alias("n"))


def event_rate(events: DataFrame) -> DataFrame:
    span = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return events.groupBy("project_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.when(span > 0, F.count(F.lit(1)) / span).otherwise(0.0), 9).alias("per_second"))


def latest_by_path(events: DataFrame) -> DataFrame:
    """The last event of each path of each project: what a rescan has to look at."""
    return events.groupBy("project_id", "path").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select("project_id", "path", "e.ts", "e.event_id", "e.event_type")


def of_project(events: DataFrame, project: int) -> DataFrame:
    """The events of one project; for batches and streams."""
    return events.where(F.col("project_id") == project)


def once(events: DataFrame, key: str = "event_id", watermark: str = "1 day") -> DataFrame:
    """Events with repeated ones dropped: in a stream those that come within the watermark, later ones are dropped as late."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def run_to_end(stream: DataFrame, folder: str, mode: str, each: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what there is, batch by batch through a function; progress is kept below folder."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    writer.foreachBatch(each).start().awaitTermination()


def drain(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The table that a stream's updates add up to: its batches are appended to a table, the last row of each key counts."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession, "stream")
    run_to_end(stream, folder, "update", lambda df, n: df.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/batch={n}"))
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])).option("recursiveFileLookup", True).parquet(f"{folder}/rows")
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return last.select(*(F.col(c) if c in keys else F.col(f"v.{c}").alias(c) for c in stream.columns))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def append_once(rows: DataFrame, folder: str, batch: int) -> None:
    """Append a batch to a table: a batch that is written again replaces its own rows, so that repeating it changes nothing."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def appended(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table of all batches written by append_once()."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(folder)


#: Partitions of a table of findings; a batch of changes rewrites those of its paths.
PARTS = 64


class Findings:
    """Findings (path, ...) in a folder, partitioned by the hash of the path, of which each batch replaces the partitions it touches.

    What a batch writes follows from its changes and from rows that it doesn't change, so that a batch that ended halfway may
    be repeated.  Each partition that was touched holds a row without a path, so that one left without findings is written too.
    """

    def __init__(self, folder: str, first: DataFrame, parts: int = PARTS):
        self.folder, self.columns, self.parts = folder, first.columns, parts
        self.spark, self.schema = first.sparkSession, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in first.schema)}, part int"
        if not _exists(self.spark, folder):
            self._write(first.withColumn("part", self.part()))

    def part(self) -> Column:
        return F.pmod(F.xxhash64("path"), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.folder)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def read(self) -> DataFrame:
        return self._read().where("path IS NOT NULL").select(*self.columns)

    def replace(self, named: DataFrame, found: DataFrame) -> list[int]:
        """Put the findings `found` in the place of those of the paths `named`; returns the partitions written, at most `parts`."""
        touched = sorted(r.part for r in named.select(self.part().alias("part")).distinct().collect())
        if touched:
            kept = self._read().where(F.col("part").isin(touched) & F.col("path").isNotNull()).join(named.select("path"), "path", "left_anti")
            marks = self.spark.createDataFrame([(n,) for n in touched], "part int")
            self._write(kept.select(*self.columns, "part").unionByName(found.select(*self.columns, self.part().alias("part"))).unionByName(marks, allowMissingColumns=True))
        return touched


def rescan_stream(stream: DataFrame, findings: DataFrame, files: DataFrame, scanner: Callable[[DataFrame], DataFrame], folder: str | None = None, parts: int = PARTS) -> DataFrame:
    """Findings (path, ...) kept up with a stream of changes of files (path, ...): each batch rescans the paths that it names.

    The last event of a path in a batch counts: findings of changed paths are replaced by those of the scanner, those of deleted
    paths go, others stay, in partitions that aren't read or written.  A folder that was used before is gone on from.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark, "rescan")
    table = Findings(f"{folder}/findings", findings, parts)

    def each(df: DataFrame, n: int) -> None:
        last = df.where("path IS NOT NULL").groupBy("path").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type")).persist()
        try:
            changed = last.where("event_type <> 'deleted'").select("path")
            table.replace(last, scanner(files.join(changed, "path", "left_semi")))
        finally:
            last.unpersist()

    run_to_end(stream, folder, "append", each)
    return table.read()


def counts_and_late(stream: DataFrame, window: str = "1 day", lateness: str = "1 day", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts per tumbling window and type, late rows) of a stream of events: nothing vanishes.

    A row is late if its window ended before the watermark, the latest time of the batches before less `lateness`.  Each batch
    adds its own counts, so that no state is kept; late rows, and those without a time, are kept as they are, with their batch.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark, "late")
    counts = "window_start timestamp, event_type string, n long"

    def each(df: DataFrame, n: int) -> None:
        rows = df.where("ts IS NOT NULL").withColumn("_window", F.window(F.col("ts").cast("timestamp"), window))
        seen = appended(spark, f"{folder}/latest", "latest timestamp, of long").where(F.col("of") < n).agg(F.max("latest")).first()[0] if _exists(spark, f"{folder}/latest") else None
        late = F.coalesce(F.col("_window.end") <= F.lit(seen) - F.expr(f"INTERVAL {lateness}"), F.lit(False)) if seen else F.lit(False)
        rows = rows.withColumn("_late", late)
        append_once(rows.where("_late").select(*df.columns).unionByName(df.where("ts IS NULL")).withColumn("batch_id", F.lit(n).cast("long")), f"{folder}/late", n)
        append_once(rows.where("NOT _late").groupBy(F.col("_window.start").alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n")), f"{folder}/counts", n)
        append_once(df.agg(F.max(F.col("ts").cast("timestamp")).alias("latest"), F.lit(n).cast("long").alias("of")), f"{folder}/latest", n)

    run_to_end(stream, folder, "append", each)
    whole = appended(spark, f"{folder}/counts", counts).groupBy("window_start", "event_type").agg(F.sum("n").alias("n"))
    return whole, appended(spark, f"{folder}/late", T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())]))


def refill(tokens: list[float], last: float, at: float) -> tuple[list[float], float, list[tuple[float, str]]]:
    """Tokens of the buckets at a time, the later of the two times, and (seconds to wait, bucket) of those without a whole token."""
    tokens = [min(t + max(at - last, 0.0) * cap / period, float(cap)) for t, (_, cap, period) in zip(tokens, BUCKETS, strict=True)]
    waits = [((1 - t) * period / cap, name) for t, (name, cap, period) in zip(tokens, BUCKETS, strict=True) if t < 1]
    return tokens, max(at, last), waits


def rate_limit(events: DataFrame, key: str = "project_id") -> DataFrame:
    """Events with allowed, wait_seconds and limit_type under token buckets, for each key in the order of time and id.

    The state of a key is four numbers, so events of a key are read as a stream of batches, never as one group.
    """
    columns = [key, "event_id", "allowed", "wait_seconds", "limit_type"]
    rows = events.select(F.col(key).cast("long").alias("k"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    ordered = rows.repartition("k").sortWithinPartitions("k", "at", "event_id")

    def run(frames):
        now, tokens, last = (), [], 0.0
        for frame in frames:
            out = []
            for k, event, at in zip(*(frame[c].tolist() for c in ("k", "event_id", "at")), strict=True):
                k = None if pd.isna(k) else int(k)
                if (k,) != now:
                    now, tokens, last = (k,), [float(cap) for _, cap, _ in BUCKETS], at
                tokens, last, waits = refill(tokens, last, at)
                if waits:
                    out.append((k, int(event), False, int(max(w for w, _ in waits)), waits[0][1]))
                else:
                    tokens = [t - 1 for t in tokens]
                    out.append((k, int(event), True, 0, None))
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return ordered.mapInPandas(run, f"{key} long, event_id long, allowed boolean, wait_seconds long, limit_type string")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables: below spark.checkpoint.dir, which executors share; a local one only where Spark is local."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if top is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-work-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
