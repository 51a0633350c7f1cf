"""Maintenance of the store's tables as pure functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Allowed values of columns, by table.
ALLOWED = {
    "scans": {"status": ("running", "completed", "failed")},
    "violations": {"severity": ("critical", "high", "medium", "low"), "status": ("open", "fixed", "dismissed"), "detection_method": ("regex", "llm", "hybrid")},
    "fixes": {"trust_level": ("auto", "review", "manual")},
    "audit_events": {
        "event_type": (
            "scan_started", "scan_completed", "scan_failed", "violation_detected", "violation_dismissed", "fix_generated", "fix_applied",
            "project_created", "project_selected", "project_deleted", "settings_updated", "settings_changed", "scan", "violation", "fix",
        )
    },
}
REFERENCES = (("scans", "project_id", "projects"), ("violations", "scan_id", "scans"), ("fixes", "violation_id", "violations"), ("scan_costs", "scan_id", "scans"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str = "updated_at") -> DataFrame:
    """Last writer wins by key; rows with an empty key are refused."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    rows = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    newest = newest.orderBy(F.desc(order), F.desc("_new"))
    for k in keys:
        rows = rows.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return rows.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn", "_new")


def delete_keys(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return current.join(keys, on, "left_anti")


def insert_or_ignore(current: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(defaults.join(current.select(*keys), keys, "left_anti"))


def get_or_create_projects(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Projects by path: an old name stays, a given framework replaces the old one; new ones are named by their last folder."""
    w = wanted.groupBy("path").agg(F.max("framework").alias("new_framework"))
    joined = current.join(w, "path", "full_outer")
    name = F.coalesce("name", F.element_at(F.split("path", "/"), -1))
    return joined.select("path", name.alias("name"), F.coalesce("new_framework", "framework").alias("framework"), F.col("id").isNull().alias("created"))


def apply_updates(current: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns set from an updates table where it has a value."""
    u = updates.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in columns))
    joined = current.join(u, key, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c))
    return joined.select(*current.columns)


def delete_cascade(store: dict[str, DataFrame], projects: DataFrame) -> dict[str, DataFrame]:
    """The store without some projects (column project_id), their scans, violations, fixes and costs; audit rows lose the reference."""
    gone = projects.select("project_id").distinct()
    out = dict(store)
    out["projects"] = store["projects"].join(gone, store["projects"].id == gone.project_id, "left_anti")
    scans = store["scans"].join(gone, "project_id", "left_semi").select(F.col("id").alias("scan_id"))
    violations = store["violations"].join(scans, "scan_id", "left_semi").select(F.col("id").alias("violation_id"))
    out["scans"] = store["scans"].join(gone, "project_id", "left_anti")
    out["violations"] = store["violations"].join(scans, "scan_id", "left_anti")
    out["fixes"] = store["fixes"].join(violations, "violation_id", "left_anti")
    out["scan_costs"] = store["scan_costs"].join(scans, "scan_id", "left_anti")
    events = store["audit_events"].join(gone.withColumn("_gone", F.lit(True)), "project_id", "left")
    out["audit_events"] = events.withColumn("project_id", F.when(F.col("_gone"), None).otherwise(F.col("project_id"))).drop("_gone")
    return out


def table_counts(store: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in sorted(store.items()):
        row = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


def export(store: dict[str, DataFrame], path: str) -> DataFrame:
    """Each table as gzipped JSON below path; returns the counts of what was written, read back."""
    for name, df in store.items():
        df.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    spark = next(iter(store.values())).sparkSession
    return table_counts({name: spark.read.schema(df.schema).json(f"{path}/{name}") for name, df in store.items()})


def snapshot_and_purge(store: dict[str, DataFrame], path: str, emptied=("fixes", "violations", "scans", "audit_events")) -> dict[str, DataFrame]:
    """A copy of the store below path, and the store with some tables emptied."""
    for name, df in store.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: df.limit(0) if name in emptied else df for name, df in store.items()}


# Columns that tables got with each version of the schema, their types, and what older rows have in them.
VERSIONS = {
    "violations": (
        (2, "detection_method", "string", "regex"), (2, "confidence_score", "int", None), (2, "llm_reasoning", "string", None), (2, "regex_reasoning", "string", None),
        (3, "function_name", "string", None), (3, "class_name", "string", None),
    ),
    "scans": ((4, "scan_mode", "string", "regex_only"),),
}


def evolve(name: str, parts: list[DataFrame], version: int = 4) -> DataFrame:
    """Parts of a table, written under any versions of the schema, as one table of a version, with that version's defaults.

    Columns of later versions go.  A table that has the version already comes back as it is.
    """
    later = [c for v, c, _, _ in VERSIONS[name] if v > version]
    out = None
    for part in parts:
        rows = part.drop(*later)
        for v, column, kind, default in VERSIONS[name]:
            if v <= version:
                held = F.col(column).cast(kind) if column in rows.columns else F.lit(None).cast(kind)
                rows = rows.withColumn(column, held if default is None else F.coalesce(held, F.lit(default)))
        out = rows if out is None else out.unionByName(rows)
    return out


def evolve_scans(scans: DataFrame, costs: DataFrame) -> DataFrame:
    """Scans of any version with scan_mode: smart where it says regex_only, by default too, and the scan has a cost row."""
    has = costs.select(F.col("scan_id").alias("id"), F.lit(True).alias("_cost")).distinct()
    old = evolve("scans", [scans]).join(has, "id", "left")
    return old.withColumn("scan_mode", F.when(F.col("_cost") & (F.col("scan_mode") == "regex_only"), "smart").otherwise(F.col("scan_mode"))).drop("_cost")


def save_clustered(df: DataFrame, folder: str, order: tuple[str, ...], lookups: tuple[str, ...] = (), group_bytes: int = 64 << 20) -> None:
    """Write a table range-sorted by `order`, with Parquet bloom filters for `lookups`.

    A filter on the first columns of `order` reads the row groups of its range alone, by their least and largest values; an
    equality on one of `lookups` those whose bloom filter may have the value.
    """
    writer = df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", group_bytes)
    for column in lookups:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(folder)


def lookup(spark: SparkSession, folder: str, schema, **values) -> DataFrame:
    """The rows of a stored table whose columns have the values given (a list: one of them); the filter reaches the scan."""
    rows = spark.read.schema(schema).parquet(folder)
    for column, value in values.items():
        rows = rows.where(F.col(column).isin(value) if isinstance(value, list) else F.col(column) == value)
    return rows


def quarantine(store: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, n_bad): values out of their lists, duplicate project paths, rows without what they refer to."""
    found = []
    for name, columns in ALLOWED.items():
        for column, values in columns.items():
            if name in store and column in store[name].columns:
                found.append(store[name].where(~F.col(column).isin(*values)).agg(F.lit(name).alias("table_name"), F.lit(f"{column} not allowed").alias("rule"), F.count(F.lit(1)).alias("n_bad")))
    for name, column, parent in REFERENCES:
        if name in store and parent in store:
            orphans = store[name].join(store[parent].select(F.col("id").alias(column)), column, "left_anti")
            found.append(orphans.agg(F.lit(name).alias("table_name"), F.lit(f"{column} missing").alias("rule"), F.count(F.lit(1)).alias("n_bad")))
    repeated = store["projects"].groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    found.append(repeated.agg(F.lit("projects").alias("table_name"), F.lit("path repeated").alias("rule"), F.count(F.lit(1)).alias("n_bad")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


#: Rules on single rows: table, name, condition that is bad.
RANGES = (("violations", "confidence_score out of 0 to 100", "confidence_score < 0 OR confidence_score > 100"),)
SETTING_RULES = (
    ("cost_limit_per_scan below 0", "key = 'cost_limit_per_scan' AND try_cast(value AS double) < 0"),
    ("cost_limit_per_scan above 1000", "key = 'cost_limit_per_scan' AND try_cast(value AS double) > 1000"),
    ("llm_scan_mode unknown", "key = 'llm_scan_mode' AND value NOT IN ('regex_only', 'smart', 'analyze_all')"),
)


def quarantined(store: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_id, rule): the rows behind the counts of quarantine(), those out of ranges, and settings that aren't allowed."""
    found = []
    note = lambda df, name, rule, key="id": df.select(F.lit(name).alias("table_name"), F.col(key).cast("string").alias("row_id"), F.lit(rule).alias("rule"))
    for name, columns in ALLOWED.items():
        found += [note(store[name].where(~F.col(c).isin(*values)), name, f"{c} not allowed") for c, values in columns.items() if name in store and c in store[name].columns]
    for name, column, parent in REFERENCES:
        if name in store and parent in store:
            found.append(note(store[name].join(store[parent].select(F.col("id").alias(column)), column, "left_anti"), name, f"{column} missing", "id" if "id" in store[name].columns else column))
    if "projects" in store:
        repeated = store["projects"].groupBy("path").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        found.append(note(store["projects"].join(repeated, "path", "left_semi"), "projects", "path repeated"))
    for name, rule, bad in RANGES:
        if name in store and "confidence_score" in store[name].columns:
            found.append(note(store[name].where(bad), name, rule))
    if "settings" in store:
        found += [note(store["settings"].where(bad), "settings", rule, "key") for rule, bad in SETTING_RULES]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def manifest(store: dict[str, DataFrame], exported_at: str) -> DataFrame:
    """(version, exported_at, table_name, n): the head of an export."""
    return table_counts(store).select(F.lit("1.0").alias("version"), F.lit(exported_at).alias("exported_at"), "table_name", "n")


def export_all(store: dict[str, DataFrame], path: str, exported_at: str) -> DataFrame:
    """Each table as JSON below path, and the manifest() of what was written, read back, beside them."""
    counts = export(store, path)
    out = counts.select(F.lit("1.0").alias("version"), F.lit(exported_at).alias("exported_at"), "table_name", "n")
    out.write.mode("overwrite").json(f"{path}/manifest")
    return out.sparkSession.read.schema(out.schema).json(f"{path}/manifest")
