"""Hybrid merge of pattern findings with model findings, and interval joins on lines."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["scan_id", "file_path", "control_id"]


def match(pattern: DataFrame, model: DataFrame, tolerance: int = 3, buckets: bool = True) -> DataFrame:
    """(llm_id, regex_id, *KEY): one-to-one matches of model findings, in id order, with the nearest free pattern finding.

    Findings match within a key and `tolerance` lines; of equally near ones the earlier id is taken.  Candidates come
    from a join on the key and a bucket of lines; the greedy choice is a pass over each run of lines that share candidates,
    as a sorted stream that holds the ids taken in the run.
    """
    width = 2 * tolerance + 1
    reach = F.sequence(F.floor((F.col("line_number") - tolerance) / width), F.floor((F.col("line_number") + tolerance) / width))  # two buckets at most
    left = model.select(*KEY, F.col("id").alias("llm_id"), F.col("line_number").alias("llm_line"), F.explode(reach).alias("bucket"))
    right = pattern.select(*KEY, F.col("id").alias("regex_id"), F.col("line_number").alias("regex_line"), F.floor(F.col("line_number") / width).alias("bucket"))
    apart = F.abs(F.col("llm_line") - F.col("regex_line"))
    near = left.join(right, [*KEY, "bucket"]).where(apart <= tolerance).select(*KEY, "llm_id", "llm_line", F.struct(apart.alias("d"), "regex_id").alias("c"))
    each = near.groupBy(*KEY, "llm_id", "llm_line").agg(F.array_sort(F.collect_list("c")).alias("c"))
    # Findings further apart than two tolerances share no candidate: runs of lines without such a gap match independently.
    lines = Window.partitionBy(*KEY).orderBy("llm_line", "llm_id")
    gap = F.coalesce((F.col("llm_line") - F.lag("llm_line").over(lines) > 2 * tolerance).cast("long"), F.lit(0))
    each = each.withColumn("gap", gap).withColumn("run", F.sum("gap").over(lines))
    ordered = each.select(*KEY, "run", "llm_id", F.transform("c", lambda x: x["regex_id"]).alias("near")).repartition(*KEY, "run").sortWithinPartitions(*KEY, "run", "llm_id")
    kinds = ", ".join(f"{c} {each.schema[c].dataType.simpleString()}" for c in KEY)
    return ordered.mapInArrow(_greedy, f"{kinds}, llm_id long, regex_id long")


def _greedy(batches):
    """Rows (*KEY, run, llm_id, near), sorted: the first of `near` that no row of the run before has taken, if there is one."""
    now, taken = None, set()
    for batch in batches:
        runs = list(zip(*(batch.column(i).to_pylist() for i in range(len(KEY) + 1)), strict=True))
        rows, chosen = [], []
        for i, (run, near) in enumerate(zip(runs, batch.column(len(KEY) + 2).to_pylist(), strict=True)):
            if run != now:
                now, taken = run, set()
            free = next((x for x in near if x not in taken), None)
            if free is not None:
                taken.add(free)
                rows.append(i)
                chosen.append(free)
        picked = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(picked.column(i) for i in range(len(KEY))), picked.column(len(KEY) + 1), pa.array(chosen, pa.int64())], names=[*KEY, "llm_id", "regex_id"])


def merge(pattern: DataFrame, model: DataFrame, tolerance: int = 3, pairs: DataFrame | None = None) -> DataFrame:
    """Hybrid findings (the model's row, the higher severity), and what is left of either side, disjoint.

    The pairs of match() are read three times: given as a written table, they aren't matched again each time.

    Where findings have a description, hybrid ones say what the pattern found and where, and why the model reported it.
    """
    from ..functions.severity import SEVERITIES, rank

    pairs = (match(pattern, model, tolerance) if pairs is None else pairs).select("llm_id", "regex_id")
    matched = model.join(pairs, model.id == pairs.llm_id).drop("llm_id")
    told = "description" in model.columns
    regex = pattern.select(F.col("id").alias("regex_id"), F.col("severity").alias("regex_severity"), *([F.col("description").alias("regex_description"), F.col("line_number").alias("regex_line")] if told else []))
    names = F.array(*map(F.lit, SEVERITIES))
    best = F.element_at(names, F.least(F.least(rank(F.col("severity")), F.lit(3)), F.least(rank(F.col("regex_severity")), F.lit(3))) + 1)
    hybrid = matched.join(regex, "regex_id").withColumn("severity", best).withColumn("detection_method", F.lit("hybrid"))
    columns = list(model.columns)
    if told:
        found = F.format_string("Pattern match at line %d: %s", "regex_line", "regex_description")
        apart = F.format_string("%s (regex detected at line %d, LLM at line %d)", found, "regex_line", "line_number")
        hybrid = hybrid.withColumn("regex_reasoning", F.when(F.col("regex_line") == F.col("line_number"), found).otherwise(apart))
        own = F.col("llm_reasoning") if "llm_reasoning" in columns else F.lit(None).cast("string")
        hybrid = hybrid.withColumn("llm_reasoning", F.coalesce(own, "description"))
        columns += [c for c in ("regex_reasoning", "llm_reasoning") if c not in columns]
    rest = model.join(pairs, model.id == pairs.llm_id, "left_anti").unionByName(pattern.join(pairs, pattern.id == pairs.regex_id, "left_anti"))
    return hybrid.select(*columns).unionByName(rest, allowMissingColumns=True)


#: Lines of a bin, to which spans and findings of a file are dealt.
BIN = 1024


def outermost(spans: DataFrame) -> DataFrame:
    """Disjoint parts (path, kind, name, start_line, end_line) of spans: of the lines of each, those in no span of its kind that began before."""
    order = Window.partitionBy("path", "kind").orderBy("start_line", F.desc("end_line"), "name").rowsBetween(Window.unboundedPreceding, -1)
    reached = spans.withColumn("reached", F.coalesce(F.max("end_line").over(order), F.lit(0)))
    own = reached.where("end_line > reached")
    return own.select("path", "kind", "name", F.greatest("start_line", F.col("reached") + 1).alias("start_line"), "end_line")


def enclosing(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings (id, path, line_number, ...) with function_name and class_name of the outermost span that holds the line.

    Of the spans of a kind that hold a line the one that begins first counts.  Spans are cut into disjoint parts, parts and
    findings are dealt to bins of lines, and a pass over each bin in line order carries the last part that began: work and
    rows grow with findings, spans and lines, however many spans a file has.
    """
    parts = outermost(spans.where("end_line >= start_line")).select("path", "kind", "name", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))).alias("bin"))
    part = lambda kind: F.when(F.col("kind") == kind, F.struct("name", "end_line"))
    begun = parts.select("path", "bin", F.greatest("start_line", F.col("bin") * BIN).alias("at"), F.lit(0).alias("point"), part("function").alias("f"), part("class").alias("c"), F.lit(None).cast(findings.schema["id"].dataType).alias("id"))
    points = findings.select("path", F.floor(F.col("line_number") / BIN).alias("bin"), F.col("line_number").alias("at"), F.lit(1).alias("point"), *(F.lit(None).cast("struct<name:string,end_line:bigint>").alias(x) for x in "fc"), "id")
    line = Window.partitionBy("path", "bin").orderBy("at", "point").rowsBetween(Window.unboundedPreceding, 0)
    passed = begun.unionByName(points).withColumn("f", F.last("f", True).over(line)).withColumn("c", F.last("c", True).over(line)).where("point = 1")
    name = lambda x: F.when(F.col(f"{x}.end_line") >= F.col("at"), F.col(f"{x}.name"))
    named = passed.select("id", name("f").alias("function_name"), name("c").alias("class_name"))
    return findings.join(named, "id", "left")
