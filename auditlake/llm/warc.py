"""Deterministic sharded WARC archives: one gzip member a record, range-sorted, rolled by compressed size.

Shards are ranges of page ids, cut at exact quantiles of the payload bytes, so that they follow from the pages alone and
not from how they are spread over partitions.  A shard's task writes files under temporary names, rolls them by compressed
size, renames each when it is complete, and returns a manifest row for it; only files in the manifest table count.  A task
that runs again writes the same bytes under the same names.  Payloads that occur more than once are written once, as
the response with the largest id; the other records revisit it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, staged

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 256 << 20
#: Payload bytes of a shard: a 512th of all, but not less or more than these.
LEAST_SHARD, MOST_SHARD = 4 << 20, 1 << 30
#: Tasks that write or read; beyond, a task has several shards or files.
MOST_TASKS = 20_000
#: What a page without an id sorts as.
NO_ID = -(2**63)
#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "file string, records long, bytes long, sha1 string, first_page long, last_page long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


def _fs(url: str):
    """(file system, path) for a URL of a shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))


def _record_id(page_id: int | None, sha1: bytes = b"") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'payload:{sha1.hex()}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member with a response record, or with a revisit record if refers_to is given."""
    sha1 = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, sha1)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join((url or ('urn:page:none' if page_id is None else f'urn:page:{page_id}')).split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *([f"X-Page-ID: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _write(folder: str, roll: int):
    """Rows (shard, page_id, digest, kind, url, html, refers_to), in order, to files; rows of kind 0 hold what the next rows refer to."""
    names = [x.split()[0] for x in MANIFEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, top = _fs(folder)
        attempt = TaskContext.get().taskAttemptId()
        now, number, out, rows, told = None, 0, None, [], (None, None, None)

        def close():
            nonlocal out, number
            out["stream"].close()
            name = f"shard-{now:06d}-{number:05d}.warc.gz"
            system.move(out["temporary"], f"{top}/{name}")
            rows.append((name, out["records"], out["bytes"], out["sha1"].hexdigest(), out["first"], out["last"]))
            number, out = number + 1, None

        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, len(whole), 64)):
                for shard, page, digest, kind, url, html, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == 0:
                        told = (page, digest, refers)
                        continue
                    if shard != now:
                        if out is not None:
                            close()
                        now, number = shard, 0
                    member = record(page, url, (html or "").encode(), told[2] if told[:2] == (page, digest) else None)
                    if out is None:
                        temporary = f"{top}/.part-{shard:06d}-{number:05d}-{attempt}"
                        out = {"temporary": temporary, "stream": system.open_output_stream(temporary), "records": 0, "bytes": 0, "sha1": hashlib.sha1(), "first": page}
                    out["stream"].write(member)
                    out["sha1"].update(member)
                    out |= {"records": out["records"] + 1, "bytes": out["bytes"] + len(member), "last": page}
                    if out["bytes"] >= roll:
                        close()
        if out is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(n, pa.string() if n in ("file", "sha1") else pa.int64()) for n in names]))

    return run


def _payload() -> Column:
    return F.coalesce(F.col("html"), F.lit(""))


def plan_records(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to): which records revisit which response; rows without an id neither revisit nor are revisited."""
    keyed = pages.select("page_id", F.sha1(_payload().cast("binary")).alias("digest"), F.octet_length(_payload()).alias("size")).where((F.col("size") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    largest = keyed.groupBy("digest", "size").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keyed.join(largest, ["digest", "size"]).where("page_id < response").select("page_id", "digest", F.col("response").alias("refers_to")).distinct()


def shard_bounds(pages: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(first id of each range of pages, number of shards it is dealt to), by exact quantiles of the payload bytes.

    A page's place among all bytes doesn't depend on how Spark cuts its ranges.  An id with more bytes than a shard holds is
    a range of its own, dealt by payload.  The driver gets one row a range: 1024, or two a gigabyte.
    """
    weight = F.sum(F.octet_length(_payload()).cast("long") + 500)
    sizes = pages.groupBy(F.coalesce("page_id", F.lit(NO_ID)).alias("page_id")).agg(weight.alias("bytes")).repartitionByRange("page_id")
    # The ranges come from a sample; the written table holds them fast.
    sizes = staged(sizes.select("page_id", "bytes", F.spark_partition_id().alias("part")), "page-sizes")
    parts = sizes.groupBy("part").agg(F.sum("bytes").alias("held"), F.min("page_id").alias("low")).orderBy("low").collect()
    total = sum(r.held for r in parts)
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    target = min(max(total // 512, LEAST_SHARD), MOST_SHARD)
    before, offsets = 0, []
    for r in parts:  # one row a partition
        offsets.append((r.part, before))
        before += r.held
    offsets = F.broadcast(sizes.sparkSession.createDataFrame(offsets, "part int, before long"))
    upto = F.sum("bytes").over(Window.partitionBy("part").orderBy("page_id"))
    placed = sizes.withColumn("upto", upto).join(offsets, "part").withColumn("range", F.floor((F.col("before") + F.col("upto") - F.col("bytes")) / target))
    large = F.col("bytes") > target
    ranges = placed.groupBy("range", large.alias("large")).agg(F.min("page_id").alias("first"), F.sum("bytes").alias("bytes")).orderBy("first").collect()
    return np.array([r["first"] for r in ranges]), np.array([-(-r.bytes // target) if r.large else 1 for r in ranges])


def write_archives(pages: DataFrame, folder: str | None = None, roll: int = ROLL_BYTES) -> tuple[str, DataFrame]:
    """Write pages (page_id, url, html) to archives; returns (folder, manifest).

    Null html is an empty payload, a null url becomes urn:page:ID; a page without an id is a response that nothing refers to,
    named by its payload, in the first shard; repeated rows are records each, and rows that share an id but not the payload
    are judged each for itself; further columns are ignored; no pages, no files.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    system, top = _fs(folder)
    system.create_dir(top, recursive=True)
    first, n = shard_bounds(rows)
    upto = np.cumsum(n)

    @F.arrow_udf("struct<range:long,shards:long>")
    def range_of(page_id: pa.Array) -> pa.Array:
        at = np.maximum(np.searchsorted(first, page_id.to_numpy(zero_copy_only=False), "right") - 1, 0)
        return pa.StructArray.from_arrays([pa.array(upto[at] - n[at]), pa.array(n[at])], names=["range", "shards"])

    # Plan rows travel with the pages through the one shuffle, so that payloads aren't shuffled again for a join.
    page = rows.select("page_id", F.sha1(_payload().cast("binary")).alias("digest"), F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    none = F.lit(None).cast("string")
    both = plan_records(rows).select("page_id", "digest", F.lit(0).alias("kind"), none.alias("url"), none.alias("html"), "refers_to").union(page)
    both = both.withColumn("at", range_of(F.coalesce("page_id", F.lit(NO_ID))))
    both = both.withColumn("shard", F.col("at.range") + F.pmod(F.xxhash64("digest"), F.col("at.shards")))
    n_tasks = max(int(upto[-1]) if len(upto) else 1, 1)
    order = ["shard", "page_id", "digest", "kind", "url"]
    ready = both.repartition(min(n_tasks, MOST_TASKS), "shard").sortWithinPartitions(*order)
    manifest = staged(ready.select(*order, "html", "refers_to").mapInArrow(_write(folder, roll), MANIFEST), "manifest")
    return folder, manifest


def parse_members(data: bytes | io.BufferedIOBase) -> Iterator[dict]:
    """Records of an archive: headers by lower-case name, and the payload (None for revisits)."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data) if isinstance(data, bytes) else data)
    while version := stream.readline():
        if not version.strip():
            continue
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}" != headers["warc-block-digest"]:
            raise ValueError(f"damaged record {headers['warc-record-id']}")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
        yield headers | {"payload": None if headers["warc-type"] == "revisit" else payload, "payload-length": length}


def _parse(folder: str, with_payload: bool):
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _fs(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for h in parse_members(stream):
                        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                        refers = h.get("x-refers-to-page-id")
                        page = h.get("x-page-id")
                        rows.append((page and int(page), h["payload-length"], digest, h["warc-type"], refers and int(refers), h["warc-target-uri"], h["payload"] if with_payload else None))
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return run


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the manifest's files, a task for each file, streamed member by member; block digests are checked."""
    files = manifest.select("file").repartition(min(max(manifest.count(), 1), MOST_TASKS), "file")
    return files.mapInArrow(_parse(folder, with_payload), READ)
