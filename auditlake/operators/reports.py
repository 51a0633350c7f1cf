"""Reports over projects, scans, violations, costs and audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.severity import SEVERITIES, rank

# Dollars per million tokens.
PRICES = {"input": 0.80, "output": 4.00, "cache_read": 0.08, "cache_write": 1.00}
# The same by model.
PRICE_BOOK = (
    ("haiku", 0.80, 4.00, 0.08, 1.00), ("grok", 0.20, 0.50, 0.0, 0.0), ("claude", 1.00, 5.00, 0.10, 1.25),
)
RANGES = {"24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}


def count_by_severity() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]


def violations_view(df: DataFrame, scan_id=None, severity=(), control=(), status=()) -> DataFrame:
    for column, wanted in (("scan_id", [scan_id] if scan_id is not None else ()), ("severity", severity), ("control_id", control), ("status", status)):
        if wanted:
            df = df.where(F.col(column).isin(*wanted))
    return df.orderBy(rank(F.col("severity")), "line_number", "id")


def result_view(df: DataFrame, severity: str = "all", controls=(), files=(), term: str = "") -> DataFrame:
    if severity != "all":
        df = df.where(F.col("severity") == severity)
    if controls:
        df = df.where(F.col("control_id").isin(*controls))
    if files:
        df = df.where(F.col("file_path").isin(*files))
    return df.where(F.contains(F.lower("file_path"), F.lit(term.strip().lower())))


def newest_events(events: DataFrame, limit: int = 1000) -> DataFrame:
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def audit_view(events: DataFrame, types=(), project=None, start=None, end=None, limit: int = 1000) -> DataFrame:
    """Filters over the newest `limit` events: the limit comes first."""
    out = newest_events(events, limit)
    if types:
        out = out.where(F.col("event_type").isin(*types))
    if project is not None:
        out = out.where(F.col("project_id") == project)
    if start is not None:
        out = out.where(F.col("created_at") >= F.lit(start))
    return out if end is None else out.where(F.col("created_at") <= F.lit(end))


def with_cost(costs: DataFrame, prices: dict[str, float] = PRICES) -> DataFrame:
    """Token cost, cost and tokens per file (0 where no file was analysed)."""
    total = sum((F.col(f"{k}_tokens") * p / 1_000_000 for k, p in prices.items()), F.lit(0.0))
    tokens = sum((F.col(f"{k}_tokens") for k in prices), F.lit(0))
    files = F.col("files_analyzed_with_llm")
    out = costs.withColumn("total_cost_usd", total).withColumn("total_tokens", tokens)
    return out.withColumn("cost_per_file", F.when(files == 0, 0.0).otherwise(F.col("total_cost_usd") / files)).withColumn("tokens_per_file", F.when(files == 0, 0.0).otherwise(F.col("total_tokens") / files))


def priced(costs: DataFrame, book: DataFrame | None = None) -> DataFrame:
    """Costs (model, tokens of four kinds) with total_cost_usd by the price book's row of the model; null for an unknown model."""
    if book is None:
        book = F.broadcast(costs.sparkSession.createDataFrame(PRICE_BOOK, "model string, " + ", ".join(f"_{k} double" for k in PRICES)))  # three rows
    total = sum((F.col(f"{k}_tokens") * F.col(f"_{k}") / 1_000_000 for k in PRICES), F.lit(0.0))
    return costs.join(book, "model", "left").withColumn("total_cost_usd", total).drop(*(f"_{k}" for k in PRICES))


def recent_costs(costs: DataFrame, span: str, as_of: DataFrame, n: int = 10) -> DataFrame:
    """The newest n costs of a time range."""
    return costs_since(costs, span, as_of).orderBy(F.desc("created_at"), F.desc("scan_id")).limit(n)


def project_scans(scans: DataFrame, project: int) -> DataFrame:
    """A project's scans, newest first."""
    return scans.where(F.col("project_id") == project).orderBy(F.desc("started_at"), F.desc("id"))


def costs_since(costs: DataFrame, span: str, as_of: DataFrame) -> DataFrame:
    """Costs not older than 24h, 7d or 30d before the one instant in as_of; all of them for `all`."""
    if span not in RANGES:
        return costs
    return costs.crossJoin(F.broadcast(as_of.select(F.col(as_of.columns[0]).alias("as_of")).limit(1))).where(F.col("created_at") >= F.col("as_of") - F.expr(RANGES[span])).drop("as_of")


def severity_counts(violations: DataFrame, by: str = "scan_id") -> DataFrame:
    return violations.groupBy(by).agg(*count_by_severity())


def method_report(violations: DataFrame, scans: DataFrame) -> DataFrame:
    """Counts by method, and by severity, for each scan mode."""
    joined = violations.join(scans.select(F.col("id").alias("scan_id"), "scan_mode"), "scan_id")
    return joined.groupingSets([["scan_mode", "detection_method"], ["scan_mode", "severity"]], "scan_mode", "detection_method", "severity").agg(F.count(F.lit(1)).alias("n"))


def file_groups(violations: DataFrame) -> DataFrame:
    out = violations.groupBy("scan_id", "file_path").agg(*count_by_severity(), F.count(F.lit(1)).alias("total"))
    return out.orderBy(*(F.desc(s) for s in SEVERITIES), F.desc("total"), "scan_id", "file_path")


def latest_scans(scans: DataFrame, n: int = 1) -> DataFrame:
    newest = Window.partitionBy("project_id").orderBy(F.desc("started_at"), F.desc("id"))
    return scans.where("status = 'completed'").withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= n)


def project_health(projects: DataFrame, scans: DataFrame, violations: DataFrame) -> DataFrame:
    last = latest_scans(scans).select(F.col("project_id"), F.col("id").alias("scan_id"))
    counts = last.join(severity_counts(violations), "scan_id", "left").fillna(0, list(SEVERITIES))
    out = projects.select(F.col("id").alias("project_id"), "name").join(counts, "project_id", "left")
    status = F.when(F.col("scan_id").isNull(), "no-scans").when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "warning").otherwise("healthy")
    return out.fillna(0, list(SEVERITIES)).withColumn("health", status)


def dashboard_totals(health: DataFrame, scans: DataFrame) -> DataFrame:
    totals = health.agg(F.count(F.lit(1)).alias("projects"), *(F.sum(s).alias(s) for s in SEVERITIES), F.count_if(F.col("health") == "healthy").alias("healthy"), F.count_if(F.col("health") == "critical").alias("critical_projects"))
    return totals.crossJoin(scans.agg(F.count_if(F.col("status") == "completed").alias("completed_scans")))  # one row each


def trend(scans: DataFrame, violations: DataFrame) -> DataFrame:
    """Of the five newest completed scans of each project, the last ten overall, oldest first, with their counts."""
    last = latest_scans(scans, 5).select(F.col("id").alias("scan_id"), F.coalesce("completed_at", "started_at").alias("at"))
    last = last.orderBy(F.desc("at"), F.desc("scan_id")).limit(10)
    return last.join(severity_counts(violations), "scan_id", "left").fillna(0, list(SEVERITIES)).orderBy("at", "scan_id")


def recent_scans(scans: DataFrame, projects: DataFrame, n: int = 10) -> DataFrame:
    done = scans.where("status = 'completed'").orderBy(F.desc("started_at"), F.desc("id")).limit(n)
    return done.join(projects.select(F.col("id").alias("project_id"), "name"), "project_id")


def cost_totals(costs: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files_analyzed_with_llm", *(f"{k}_tokens" for k in PRICES))]
    average = F.coalesce(F.sum("total_cost_usd") / F.sum("files_analyzed_with_llm"), F.lit(0.0))
    return costs.agg(F.round(F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)), 6).alias("cost"), *sums, F.round(F.coalesce(F.avg("total_cost_usd"), F.lit(0.0)), 6).alias("per_scan"), F.round(average, 6).alias("per_file"))


def daily_costs(costs: DataFrame, days: int = 30) -> DataFrame:
    by_day = costs.groupBy(F.to_date("created_at").alias("day")).agg(F.round(F.sum("total_cost_usd"), 6).alias("cost"), F.count(F.lit(1)).alias("scans"))
    return by_day.orderBy(F.desc("day")).limit(days).orderBy("day")


def running_cost(costs: DataFrame) -> DataFrame:
    """Cumulative cost within each project over its scans in time."""
    order = Window.partitionBy("project_id").orderBy("created_at", "scan_id").rowsBetween(Window.unboundedPreceding, 0)
    return costs.withColumn("running", F.round(F.sum("total_cost_usd").over(order), 6))


def budget_cut(file_costs: DataFrame, limit: float = 1.0, batch: int = 10, on_limit: str = "stop") -> tuple[DataFrame, DataFrame]:
    """(files analysed, events) of (scan_id, file_no, cost): after each batch, a scan over its limit stops if files remain."""
    order = Window.partitionBy("scan_id").orderBy("file_no")
    rows = file_costs.withColumn("rn", F.row_number().over(order)).withColumn("batch", F.floor((F.col("rn") - 1) / batch))
    rows = rows.withColumn("spent", F.sum(F.coalesce("cost", F.lit(0.0))).over(order)).withColumn("files", F.count(F.lit(1)).over(Window.partitionBy("scan_id")))
    ends = rows.where((F.col("rn") % batch == 0) & (F.round("spent", 9) > limit) & (F.col("rn") < F.col("files")))
    cut = ends.groupBy("scan_id").agg(F.min_by(F.struct("batch", "spent", "rn", "files"), "rn").alias("c"))
    events = cut.select("scan_id", F.round("c.spent", 6).alias("cost"), F.lit(limit).alias("cost_limit"), F.col("c.rn").cast("long").alias("analysed"), (F.col("c.files") - F.col("c.rn")).cast("long").alias("remaining"))
    if on_limit != "stop":
        return rows, events
    kept = rows.join(cut.select("scan_id", F.col("c.batch").alias("last")), "scan_id", "left").where(F.col("last").isNull() | (F.col("batch") <= F.col("last"))).drop("last")
    return kept, events


def scan_cost_rollup(kept: DataFrame) -> DataFrame:
    """A cost row for each scan with analysed files (those with a cost) that cost something; caches aren't counted there."""
    paid = F.col("cost").isNotNull()
    tokens = [F.coalesce(F.sum(F.when(paid, F.col(c))), F.lit(0)).cast("long").alias(c) for c in ("input_tokens", "output_tokens")]
    out = kept.groupBy("scan_id").agg(F.count_if(paid).alias("files_analyzed_with_llm"), *tokens, F.round(F.sum("cost"), 6).alias("total_cost_usd"))
    out = out.withColumns({c: F.lit(0).cast("long") for c in ("cache_read_tokens", "cache_write_tokens")})
    return out.where("files_analyzed_with_llm > 0 AND total_cost_usd > 0").select("scan_id", "files_analyzed_with_llm", *(f"{k}_tokens" for k in PRICES), "total_cost_usd")


def scan_summary(scans: DataFrame, violations: DataFrame, files: DataFrame, costs: DataFrame) -> DataFrame:
    """A row for each scan: its status, violations by severity, files (scan_id, total_files, files_scanned) and cost, 0 where there are none."""
    counts = violations.groupBy(F.col("scan_id").alias("id")).agg(*count_by_severity(), F.count(F.lit(1)).alias("violations_found"))
    paid = costs.groupBy(F.col("scan_id").alias("id")).agg(F.round(F.sum("total_cost_usd"), 6).alias("total_cost_usd"))
    out = scans.select("id", "project_id", "status").join(counts, "id", "left").join(files.withColumnRenamed("scan_id", "id"), "id", "left").join(paid, "id", "left")
    return out.fillna(0, [c for c in out.columns if c not in ("id", "project_id", "status")])


def progress_events(files: DataFrame, every: int = 10) -> DataFrame:
    """Counts after each `every` files of a scan, and after its last one."""
    order = Window.partitionBy("scan_id").orderBy("file_no")
    rows = files.withColumn("scanned", F.row_number().over(order)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("scan_id")))
    return rows.where((F.col("scanned") % every == 0) | (F.col("scanned") == F.col("total"))).select("scan_id", F.col("scanned").cast("long").alias("scanned"), "total")
