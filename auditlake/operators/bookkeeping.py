"""What follows a decision on a finding: status changes with their audit rows, lineage of fixes, appends, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The controls.
CONTROLS = (
    ("CC6.1", "Logical Access Controls", "The organization restricts logical access to facilities and systems containing or supporting sensitive information by validating user identity and authenticating access requests appropriately.", "Implement authentication decorators and RBAC checks on sensitive operations.", "CC6 - Access Control"),
    ("CC6.7", "Cryptography - Encryption and Secrets", "The organization protects sensitive information during transmission and storage through encryption, preventing exposure of secrets and enforcing TLS for external communication.", "No hardcoded secrets, move to environment variables, enforce HTTPS/TLS.", "CC6 - Access Control"),
    ("CC7.2", "Monitoring and Logging", "The organization monitors information systems and related assets for anomalies and logs security-relevant events including user activity, system access, and configuration changes.", "Implement audit logging on sensitive operations, prevent logging of sensitive data.", "CC7 - System Monitoring"),
    ("A1.2", "Resilience and Error Handling", "The organization maintains system resilience through proper error handling, retry logic, and circuit breaker patterns on external dependencies.", "Add try/catch blocks, implement retry logic with exponential backoff, use circuit breakers.", "A1 - Service Availability"),
)
CONTROL_COLUMNS = ("control_id", "control_name", "control_description", "requirement", "category")
# Settings by what they hold.
SETTINGS = {"desktop_notifications": "boolean", "llm_scan_mode": "string", "cost_limit_per_scan": "double"}


def controls(df: DataFrame) -> DataFrame:
    """The four controls, in the session of df."""
    return df.sparkSession.createDataFrame(CONTROLS, ", ".join(f"{c} string" for c in CONTROL_COLUMNS))


def audit_rows(rows: DataFrame, event_type: str, description: Column, project: str = "project_id", violation: str = "violation_id", fix: Column | None = None) -> DataFrame:
    """(event_type, project_id, violation_id, fix_id, description): an audit row for each row."""
    fix_id = F.lit(None).cast("long") if fix is None else fix
    return rows.select(F.lit(event_type).alias("event_type"), F.col(project).alias("project_id"), F.col(violation).alias("violation_id"), fix_id.alias("fix_id"), description.alias("description"))


def lineage(fixes: DataFrame, violations: DataFrame, scans: DataFrame, projects: DataFrame) -> DataFrame:
    """(fix_id, violation_id, scan_id, project_id, path, file_path, line_number, description, status): what each fix is for.

    status is `ok`, or says which link is missing first.
    """
    v = violations.select(F.col("id").alias("violation_id"), "scan_id", "file_path", "line_number", "description", F.lit(True).alias("_v"))
    s = scans.select(F.col("id").alias("scan_id"), "project_id", F.lit(True).alias("_s"))
    p = projects.select(F.col("id").alias("project_id"), "path", F.lit(True).alias("_p"))
    joined = fixes.select(F.col("id").alias("fix_id"), "violation_id").join(v, "violation_id", "left").join(s, "scan_id", "left").join(p, "project_id", "left")
    status = F.when(F.col("_v").isNull(), "Violation not found").when(F.col("_s").isNull(), "Scan not found").when(F.col("_p").isNull(), "Project not found").otherwise("ok")
    return joined.select("fix_id", "violation_id", "scan_id", "project_id", "path", "file_path", "line_number", "description", status.alias("status"))


def dismiss(violations: DataFrame, scans: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(violations with the wanted ones dismissed, audit rows): wanted has a column id; ids below 1 or unknown change nothing."""
    ids = wanted.where("id > 0").select("id").distinct()
    marked = violations.join(ids.withColumn("_gone", F.lit(True)), "id", "left")
    changed = marked.withColumn("status", F.when(F.col("_gone"), "dismissed").otherwise(F.col("status"))).select(*violations.columns)
    rows = violations.join(ids, "id", "left_semi").select(F.col("id").alias("violation_id"), "scan_id", "description")
    rows = rows.join(scans.select(F.col("id").alias("scan_id"), "project_id"), "scan_id")
    return changed, audit_rows(rows, "violation_dismissed", F.concat(F.lit("Dismissed violation: "), "description"))


def record_fixes(store: dict[str, DataFrame], applied: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the store after fixes were applied, audit rows) of (fix_id, applied_at, backup_path).

    A fix gets its time and backup, its violation the status fixed; fixes whose lineage is broken are left as they are.
    """
    done = lineage(store["fixes"], store["violations"], store["scans"], store["projects"]).where("status = 'ok'").join(applied, "fix_id")
    new = done.select(F.col("fix_id").alias("id"), F.col("applied_at").alias("_at"), F.col("backup_path").alias("_backup"))
    fixes = store["fixes"] if "backup_path" in store["fixes"].columns else store["fixes"].withColumn("backup_path", F.lit(None).cast("string"))
    joined = fixes.join(new, "id", "left")
    out = dict(store)
    out["fixes"] = joined.withColumn("applied_at", F.coalesce("_at", "applied_at")).withColumn("backup_path", F.coalesce("_backup", "backup_path")).select(*fixes.columns)
    fixed = done.select(F.col("violation_id").alias("id"), F.lit(True).alias("_fixed")).distinct()
    v = store["violations"]
    out["violations"] = v.join(fixed, "id", "left").withColumn("status", F.when(F.col("_fixed"), "fixed").otherwise(F.col("status"))).select(*v.columns)
    return out, audit_rows(done, "fix_applied", F.concat(F.lit("Applied fix for violation: "), "description"), fix=F.col("fix_id"))


def backup_path(project_path: Column, file_path: Column, at: Column) -> Column:
    """Where a file's former content is kept: by its name and the time, below the project."""
    name = F.element_at(F.split(file_path, "/"), -1)
    return F.concat(project_path, F.lit("/.backups/"), name, F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Append rows to the table at path; Spark's committer makes them visible whole, or not at all."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def typed_settings(settings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row of the known settings (for each value of `by`), with their types; unknown keys are ignored, junk is null."""
    known = {"boolean": lambda v: F.when(v == "true", True).when(v == "false", False), "double": lambda v: v.try_cast("double"), "string": lambda v: v}
    value = lambda key, kind: known[kind](F.max(F.when(F.col("key") == key, F.col("value")))).alias(key)
    return settings.groupBy(*(by or [])).agg(*(value(k, t) for k, t in SETTINGS.items()))


def one_fix(fixes: DataFrame) -> DataFrame:
    """The first fix, by id, of each violation."""
    return fixes.withColumn("_rn", F.row_number().over(Window.partitionBy("violation_id").orderBy("id"))).where("_rn = 1").drop("_rn")


def detail(violations: DataFrame, fixes: DataFrame, scans: DataFrame) -> DataFrame:
    """Violations with their control, one fix and their scan."""
    known = F.broadcast(controls(violations))  # four rows
    fix = one_fix(fixes).select("violation_id", F.col("id").alias("fix_id"), "trust_level")
    out = violations.join(known, "control_id", "left").join(fix, violations["id"] == fix["violation_id"], "left").drop("violation_id")
    return out.join(scans.select(F.col("id").alias("scan_id"), F.col("status").alias("scan_status"), "project_id"), "scan_id", "left")
