"""The registered queries of the compliance operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import severity as sev
from ..operators import bookkeeping, corpus, merge, prompts, remedy, reports, rules, store
from ..sources import table
from ..sources.fixtures import derived, oracle
from ..streaming import changes, keyed
from . import rule_sql, span_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL over the given and derived tables."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = oracle(sql)
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.gather_lines(derived(spark, sf_dir, "code_lines"), ["file_id", "path"])


#: The scan of a file of code_lines: forty files each.
SCAN_OF = "floor(file_id / 40)"


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.with_cost(derived(spark, sf_dir, "scan_costs"))


def store_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: derived(spark, sf_dir, n) for n in ("projects", "scans", "violations", "fixes", "scan_costs", "audit_events")}


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written to a work folder and read back: what is read several times is worked out once."""
    folder = changes.work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


SEV = "count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low"
RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
COST = "(input_tokens * 0.80::DOUBLE / 1000000 + output_tokens * 4.00::DOUBLE / 1000000 + cache_read_tokens * 0.08::DOUBLE / 1000000 + cache_write_tokens * 1.00::DOUBLE / 1000000)"
TOKENS = "(input_tokens + output_tokens + cache_read_tokens + cache_write_tokens)"
DONE = "done AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, id DESC) AS rn FROM scans WHERE status = 'completed')"
HEALTH = f"""{DONE}, counts AS (SELECT scan_id, {SEV} FROM violations GROUP BY scan_id),
  health AS (SELECT p.id AS project_id, p.name, d.id AS scan_id, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
    CASE WHEN d.id IS NULL THEN 'no-scans' WHEN coalesce(critical, 0) > 0 THEN 'critical' WHEN coalesce(high, 0) > 0 THEN 'warning' ELSE 'healthy' END AS health
    FROM projects p LEFT JOIN (SELECT * FROM done WHERE rn = 1) d ON d.project_id = p.id LEFT JOIN counts c ON c.scan_id = d.id)"""

# ---- sources and store


@query("SELECT path, count(*) AS n_lines, CAST(sum(strlen(line)) + count(*) - 1 AS BIGINT) AS n_bytes FROM code_lines GROUP BY path")
def file_counters(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return files.select("path", F.size("lines").cast("long").alias("n_lines"), F.octet_length(F.array_join("lines", "\n")).cast("long").alias("n_bytes"))


@query("""SELECT DISTINCT path, len(list_filter(string_split(path, '/'), lambda c: list_contains(['node_modules','vendor','assets','public','static','.git','venv','.venv','__pycache__','.pytest_cache','.tox','.coverage','dist','build','out','target','.cargo','.next','.babel_cache','.cache','coverage'], c) OR starts_with(c, '.'))) > 0 AS skipped,
  CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.ts' THEN 'typescript' END AS language FROM code_lines""")
def skip_and_language(spark, sf_dir):
    paths = derived(spark, sf_dir, "code_lines").select("path").distinct()
    return paths.select("path", sev.skip_path(F.col("path")).alias("skipped"), sev.language(F.col("path")).alias("language"))


@query("""SELECT event_id, path FROM file_events WHERE path NOT LIKE '%build%' AND (path LIKE '%.py' OR path LIKE '%.ts')""")
def watched_events(spark, sf_dir):
    return changes.watched(derived(spark, sf_dir, "file_events")).select("event_id", "path")


@query("SELECT path, line_no, line FROM code_lines")
def line_split(spark, sf_dir):
    texts = code_files(spark, sf_dir).select("path", F.concat(F.array_join("lines", "\r\n"), F.lit("\n")).alias("content"))
    return corpus.explode_lines(corpus.with_lines(texts))


@query("SELECT id, scan_id, control_id, severity FROM violations WHERE scan_id = (SELECT min(scan_id) FROM violations)")
def violation_lookup(spark, sf_dir):
    v = derived(spark, sf_dir, "violations")
    return v.join(v.agg(F.min("scan_id").alias("scan_id")), "scan_id", "left_semi").select("id", "scan_id", "control_id", "severity")


@query("SELECT id, scan_id, control_id, severity FROM violations WHERE scan_id = (SELECT max(scan_id) FROM violations)")
def clustered_lookup(spark, sf_dir):
    """Written once sorted by scan, with bloom filters of ids, then looked up."""
    v, folder = derived(spark, sf_dir, "violations"), changes.work_folder(spark, "violations")
    store.save_clustered(v, folder, ("scan_id", "id"), ("id",))
    last = spark.read.schema(v.schema).parquet(folder).agg(F.max("scan_id")).first()[0]  # one number, of the files' statistics
    return store.lookup(spark, folder, v.schema, scan_id=last).select("id", "scan_id", "control_id", "severity")


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN 'regex' ELSE detection_method END AS detection_method, CASE WHEN id % 4 >= 1 THEN CAST(line_number AS INTEGER) END AS confidence_score,
  CASE WHEN id % 4 >= 2 THEN 'f' || line_number END AS function_name FROM violations""")
def evolved_violations(spark, sf_dir):
    v = kept(derived(spark, sf_dir, "violations"), "violations")  # numbered once, not for each part
    folder, part = changes.work_folder(spark, "versions"), lambda n: v.where(F.pmod("id", F.lit(4)) == n)
    second = lambda df: df.withColumn("confidence_score", F.col("line_number").cast("int"))
    third = lambda df: second(df).withColumn("function_name", F.concat(F.lit("f"), "line_number"))
    written = [part(0).drop("detection_method"), second(part(1)), third(part(2)), third(part(3)).withColumn("class_name", F.lit(None).cast("string"))]
    for n, df in enumerate(written):
        df.write.parquet(f"{folder}/version={n + 1}")
    read = [spark.read.schema(df.schema).parquet(f"{folder}/version={n + 1}") for n, df in enumerate(written)]
    once = store.evolve("violations", read)
    return store.evolve("violations", [once]).select("id", "detection_method", "confidence_score", "function_name")


@query("""SELECT status, sha256, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM (
  SELECT CASE doc_id % 4 WHEN 0 THEN 'read' WHEN 3 THEN 'not UTF-8' ELSE 'skipped' END AS status, CASE WHEN doc_id % 4 = 0 THEN sha256(coalesce(text, '') || chr(10)) END AS sha256,
    octet_length(encode(coalesce(text, ''))) + CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END AS size FROM documents) f GROUP BY status, sha256""")
def corpus_files(spark, sf_dir):
    """Documents as files, a part of them in folders that scans pass over, a part not in UTF-8; listed, then read."""
    docs, root = table(spark, sf_dir, "documents"), changes.work_folder(spark, "files")
    kind, text = F.col("doc_id") % 4, F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary")
    below = F.when(kind == 0, "src").when(kind == 1, "node_modules/x").when(kind == 3, "lib").otherwise("lib/venv")
    corpus.write_files(docs.select(below.alias("below"), F.when(kind == 3, F.concat(F.unhex(F.lit("FF")), text)).otherwise(text).alias("content")), root)
    files = corpus.list_corpus(spark, root)
    rows = corpus.told_corpus(spark, root, files).select(F.coalesce("reason", F.lit("read")).alias("status"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), "size")
    passed = files.where("skipped").select(F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("sha256"), "size")
    return rows.unionByName(passed).groupBy("status", "sha256").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))


@query("SELECT id, project_id, started_at, status FROM scans ORDER BY started_at DESC, id DESC LIMIT 50")
def newest_scans(spark, sf_dir):
    return derived(spark, sf_dir, "scans").orderBy(F.desc("started_at"), F.desc("id")).limit(50).select("id", "project_id", "started_at", "status")


@query("""SELECT key, arg_max(value, updated_at) AS value FROM (SELECT 'k' || (o_custkey % 500) AS key, CAST(o_orderkey AS VARCHAR) AS value, o_orderkey AS updated_at FROM orders) s GROUP BY key""")
def settings_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.concat(F.lit("k"), F.col("o_custkey") % 500).alias("key"), F.col("o_orderkey").cast("string").alias("value"), F.col("o_orderkey").alias("updated_at"))
    even = F.col("updated_at") % 2 == 0
    return store.upsert(rows.where(even), rows.where(~even), ["key"]).select("key", "value")


@query("""SELECT path, name, framework, false AS created FROM projects WHERE id % 2 = 0
  UNION ALL SELECT path, regexp_extract(path, '[^/]*$') AS name, framework, true AS created FROM projects WHERE id % 2 = 1 AND id % 3 = 0""")
def project_get_or_create(spark, sf_dir):
    p = derived(spark, sf_dir, "projects")
    return store.get_or_create_projects(p.where("id % 2 = 0"), p.where("id % 3 = 0").select("path", "framework"))


@query("SELECT id, name FROM projects WHERE id % 3 <> 0 UNION ALL SELECT id, 'seed' AS name FROM projects WHERE id % 3 = 0")
def seed_missing(spark, sf_dir):
    p = derived(spark, sf_dir, "projects").select("id", "name")
    return store.insert_or_ignore(p.where("id % 3 <> 0"), p.select("id", F.lit("seed").alias("name")), ["id"])


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'dismissed' ELSE status END AS status FROM violations")
def status_updates(spark, sf_dir):
    v = derived(spark, sf_dir, "violations").select("id", "status")
    return store.apply_updates(v, v.where("id % 7 = 0").select("id", F.lit("dismissed").alias("status")), "id", ["status"])


GONE = "SELECT id FROM projects WHERE id % 5 = 0"


@query(f"""SELECT 'audit_events' AS table_name, count(*) AS n FROM audit_events UNION ALL
  SELECT 'fixes', count(*) FROM fixes WHERE violation_id NOT IN (SELECT id FROM violations WHERE scan_id IN (SELECT id FROM scans WHERE project_id IN ({GONE}))) UNION ALL
  SELECT 'projects', count(*) FROM projects WHERE id NOT IN ({GONE}) UNION ALL
  SELECT 'scan_costs', count(*) FROM scan_costs WHERE scan_id NOT IN (SELECT id FROM scans WHERE project_id IN ({GONE})) UNION ALL
  SELECT 'scans', count(*) FROM scans WHERE project_id NOT IN ({GONE}) UNION ALL
  SELECT 'violations', count(*) FROM violations WHERE scan_id NOT IN (SELECT id FROM scans WHERE project_id IN ({GONE}))""")
def cascade_delete(spark, sf_dir):
    s = store_of(spark, sf_dir)
    return store.table_counts(store.delete_cascade(s, s["projects"].where("id % 5 = 0").select(F.col("id").alias("project_id"))))


@query(f"SELECT id, CASE WHEN project_id IN ({GONE}) THEN NULL ELSE project_id END AS project_id FROM audit_events")
def cascade_set_null(spark, sf_dir):
    s = store_of(spark, sf_dir)
    gone = s["projects"].where("id % 5 = 0").select(F.col("id").alias("project_id"))
    return store.delete_cascade(s, gone)["audit_events"].select("id", "project_id")


@query("""SELECT s.id, CASE WHEN s.id IN (SELECT scan_id FROM scan_costs) THEN 'smart' ELSE 'regex_only' END AS scan_mode FROM scans s""")
def scan_mode_backfill(spark, sf_dir):
    return store.evolve_scans(derived(spark, sf_dir, "scans").drop("scan_mode"), derived(spark, sf_dir, "scan_costs")).select("id", "scan_mode")


@query("""SELECT 'scans' AS table_name, 'status not allowed' AS rule, count(*) AS n_bad FROM scans WHERE status NOT IN ('running','completed','failed') UNION ALL
  SELECT 'violations', 'severity not allowed', count(*) FROM violations WHERE severity NOT IN ('critical','high','medium','low') UNION ALL
  SELECT 'violations', 'status not allowed', count(*) FROM violations WHERE status NOT IN ('open','fixed','dismissed') UNION ALL
  SELECT 'violations', 'detection_method not allowed', count(*) FROM violations WHERE detection_method NOT IN ('regex','llm','hybrid') UNION ALL
  SELECT 'fixes', 'trust_level not allowed', count(*) FROM fixes WHERE trust_level NOT IN ('auto','review','manual') UNION ALL
  SELECT 'audit_events', 'event_type not allowed', count(*) FROM audit_events WHERE event_type NOT IN ('scan_started', 'scan_completed', 'scan_failed', 'violation_detected', 'violation_dismissed', 'fix_generated', 'fix_applied', 'project_created', 'project_selected', 'project_deleted', 'settings_updated', 'settings_changed', 'scan', 'violation', 'fix') UNION ALL
  SELECT 'scans', 'project_id missing', count(*) FROM scans WHERE project_id NOT IN (SELECT id FROM projects) UNION ALL
  SELECT 'violations', 'scan_id missing', count(*) FROM violations WHERE scan_id NOT IN (SELECT id FROM scans) UNION ALL
  SELECT 'fixes', 'violation_id missing', count(*) FROM fixes WHERE violation_id NOT IN (SELECT id FROM violations) UNION ALL
  SELECT 'scan_costs', 'scan_id missing', count(*) FROM scan_costs WHERE scan_id NOT IN (SELECT id FROM scans) UNION ALL
  SELECT 'projects', 'path repeated', count(*) FROM (SELECT path FROM projects GROUP BY path HAVING count(*) > 1) r""")
def constraint_audit(spark, sf_dir):
    return store.quarantine(store_of(spark, sf_dir))


@query("""SELECT path, starts_with(path, '/') AS absolute, contains(path, '..') AS traversal, false AS nul,
  (starts_with(path, '/') AND length(path) - 1 <= 10) AS system FROM (SELECT DISTINCT CASE id % 3 WHEN 0 THEN path WHEN 1 THEN '..' || path ELSE substr(path, 2) END AS path FROM projects) p""")
def path_safety(spark, sf_dir):
    p = derived(spark, sf_dir, "projects")
    kinds = F.when(F.col("id") % 3 == 0, F.col("path")).when(F.col("id") % 3 == 1, F.concat(F.lit(".."), "path")).otherwise(F.expr("substr(path, 2)"))
    flags = sev.path_flags(F.col("path"))
    return p.select(kinds.alias("path")).distinct().select("path", *(c.alias(n) for n, c in flags.items()))


@query("""SELECT 'audit_events' AS table_name, count(*) AS n FROM audit_events UNION ALL SELECT 'fixes', count(*) FROM fixes UNION ALL SELECT 'projects', count(*) FROM projects
  UNION ALL SELECT 'scan_costs', count(*) FROM scan_costs UNION ALL SELECT 'scans', count(*) FROM scans UNION ALL SELECT 'violations', count(*) FROM violations""")
def export_counts(spark, sf_dir):
    folder = changes.work_folder(spark, "export")
    return store.export(store_of(spark, sf_dir), folder)


@query("""SELECT '1.0' AS version, '2026-01-01T00:00:00Z' AS exported_at, table_name, n FROM (SELECT 'audit_events' AS table_name, count(*) AS n FROM audit_events UNION ALL SELECT 'fixes', count(*) FROM fixes
  UNION ALL SELECT 'projects', count(*) FROM projects UNION ALL SELECT 'scans', count(*) FROM scans UNION ALL SELECT 'settings', count(*) FROM settings UNION ALL SELECT 'violations', count(*) FROM violations) t""")
def export_manifest(spark, sf_dir):
    held = store_of(spark, sf_dir) | {"settings": derived(spark, sf_dir, "settings")}
    held.pop("scan_costs")
    return store.export_all(held, changes.work_folder(spark, "export"), "2026-01-01T00:00:00Z")


@query("""SELECT 'audit_events' AS table_name, 0 AS n UNION ALL SELECT 'fixes', 0 UNION ALL SELECT 'projects', count(*) FROM projects
  UNION ALL SELECT 'scan_costs', count(*) FROM scan_costs UNION ALL SELECT 'scans', 0 UNION ALL SELECT 'violations', 0""")
def purge_counts(spark, sf_dir):
    return store.table_counts(store.snapshot_and_purge(store_of(spark, sf_dir), changes.work_folder(spark, "snapshot")))


# ---- filters and expressions


@query("SELECT id, severity, line_number FROM violations WHERE severity IN ('critical','high') AND control_id IN ('CC6.1','A1.2') AND status = 'open'")
def violations_filtered(spark, sf_dir):
    return reports.violations_view(derived(spark, sf_dir, "violations"), severity=("critical", "high"), control=("CC6.1", "A1.2"), status=("open",)).select("id", "severity", "line_number")


@query("SELECT id FROM violations WHERE severity = 'medium' AND control_id = 'CC7.2' AND contains(lower(file_path), 'f2')")
def result_view(spark, sf_dir):
    return reports.result_view(derived(spark, sf_dir, "violations"), "medium", ("CC7.2",), (), " F2 ").select("id")


@query("SELECT id, event_type, created_at FROM (SELECT * FROM audit_events ORDER BY created_at DESC, id DESC LIMIT 1000) e WHERE event_type IN ('scan_started','fix_applied') AND created_at <= TIMESTAMP '2030-01-01'")
def audit_filtered(spark, sf_dir):
    return reports.audit_view(derived(spark, sf_dir, "audit_events"), ("scan_started", "fix_applied"), end="2030-01-01").select("id", "event_type", "created_at")


@query("SELECT id, event_type FROM audit_events WHERE project_id = 7")
def audit_by_project(spark, sf_dir):
    return derived(spark, sf_dir, "audit_events").where("project_id = 7").orderBy(F.desc("created_at"), F.desc("id")).select("id", "event_type")


@query("SELECT scan_id FROM scan_costs WHERE created_at >= (SELECT max(created_at) FROM scan_costs) - INTERVAL 30 DAYS")
def costs_last_30d(spark, sf_dir):
    c = derived(spark, sf_dir, "scan_costs")
    return reports.costs_since(c, "30d", c.agg(F.max("created_at"))).select("scan_id")


@query("""SELECT path, severity, CASE WHEN path LIKE '%/test%' OR path LIKE '%test/%' THEN CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END ELSE severity END AS adjusted
  FROM (SELECT DISTINCT c.path, v.severity FROM code_lines c JOIN (SELECT DISTINCT severity FROM violations) v ON true) x""")
def test_downgrade(spark, sf_dir):
    paths = derived(spark, sf_dir, "code_lines").select("path").distinct()
    levels = derived(spark, sf_dir, "violations").select("severity").distinct()  # at most four rows
    return paths.crossJoin(F.broadcast(levels)).select("path", "severity", sev.downgrade(F.col("severity"), F.col("path")).alias("adjusted"))


@query(f"SELECT scan_id, round({COST}, 6) AS total_cost_usd, {TOKENS} AS total_tokens, round({COST} / files_analyzed_with_llm, 6) AS cost_per_file, round({TOKENS} / files_analyzed_with_llm, 6) AS tokens_per_file FROM scan_costs")
def token_costs(spark, sf_dir):
    return costs(spark, sf_dir).select("scan_id", *(F.round(c, 6).alias(c) if c != "total_tokens" else F.col(c) for c in ("total_cost_usd", "total_tokens", "cost_per_file", "tokens_per_file")))


_GROUPS = ", ".join(
    f"len(list_filter([{', '.join(chr(39) + w + chr(39) for w in words)}], lambda w: contains(low, w))) > 0 AS has_{group}" for group, words in corpus.KEYWORDS.items()
)


@query(f"""SELECT path, has_auth, has_database, has_endpoint, has_secrets, has_file_io, has_network,
  (path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.ts') AND (has_auth OR has_database OR has_endpoint OR has_secrets OR has_file_io OR has_network) AS selected
  FROM (SELECT path, {_GROUPS} FROM (SELECT path, lower(string_agg(line, chr(10) ORDER BY line_no)) AS low FROM code_lines GROUP BY path) f) g""")
def model_selection(spark, sf_dir):
    files = code_files(spark, sf_dir)
    out = corpus.select_for_model(files, "smart", F.array_join("lines", "\n"))
    return out.select("path", *(f"has_{g}" for g in corpus.KEYWORDS), "selected")


@query("""SELECT round(100.0 * count(*) FILTER (WHERE path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.ts') / count(*), 6) AS rate FROM (SELECT DISTINCT path FROM code_lines) p""")
def selection_rate(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return corpus.select_for_model(files, "analyze_all", F.array_join("lines", "\n")).agg(F.round(F.avg(F.col("selected").cast("int")) * 100, 6).alias("rate"))


@query("""SELECT event_type, CASE WHEN contains(event_type, 'scan') THEN 'scan' WHEN contains(event_type, 'fix') THEN 'fix' WHEN contains(event_type, 'violation') THEN 'violation' ELSE event_type END AS label, count(*) AS n FROM audit_events GROUP BY 1, 2""")
def audit_labels(spark, sf_dir):
    return derived(spark, sf_dir, "audit_events").groupBy("event_type", sev.audit_label(F.col("event_type")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT project_id, round(100.0 * count(*) FILTER (WHERE status = 'completed') / count(*)) AS progress FROM scans GROUP BY project_id")
def progress_percent(spark, sf_dir):
    n = derived(spark, sf_dir, "scans").groupBy("project_id").agg(F.count_if(F.col("status") == "completed").alias("a"), F.count(F.lit(1)).alias("b"))
    return n.select("project_id", sev.progress(F.col("a"), F.col("b")).alias("progress"))


@query("""SELECT id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || CASE WHEN s // 60 = 1 THEN ' minute ago' ELSE ' minutes ago' END
  WHEN s < 86400 THEN (s // 3600) || CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE (s // 86400) || CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END END AS age
  FROM (SELECT id, CAST(floor(epoch((SELECT max(created_at) FROM audit_events))) - floor(epoch(created_at)) AS BIGINT) AS s FROM audit_events) a""")
def relative_ages(spark, sf_dir):
    e = derived(spark, sf_dir, "audit_events")
    now = e.agg(F.max("created_at").alias("now"))
    return e.crossJoin(F.broadcast(now)).select("id", sev.relative_age(F.col("created_at"), F.col("now")).alias("age"))  # one instant


@query("""SELECT control_id, CASE control_id WHEN 'CC6.1' THEN 'Added access control protection to ensure only authorized users can access this resource.'
  WHEN 'CC6.7' THEN 'Moved hardcoded secret to environment variable. Use secure secret management in production.' WHEN 'CC7.2' THEN 'Added audit logging to track this sensitive operation for compliance monitoring.'
  ELSE 'Added error handling with proper recovery logic to improve system resilience.' END AS explanation, count(*) AS n FROM violations GROUP BY 1, 2""")
def fix_explanations(spark, sf_dir):
    return derived(spark, sf_dir, "violations").groupBy("control_id", remedy.explanation(F.col("control_id")).alias("explanation")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT path, line_no, string_agg(format('{:4d} | {}', line_no, line), chr(10)) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS snippet FROM code_lines""")
def context_snippets(spark, sf_dir):
    rows = code_files(spark, sf_dir).select("path", "lines", F.explode(F.sequence(F.lit(1), F.size("lines"))).alias("line_no"))
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), remedy.snippet(F.col("lines"), F.col("line_no"), 1)["text"].alias("snippet"))


@query("""WITH near AS (SELECT v.id, v.line_number, c.line_no, c.line FROM violations v JOIN code_lines c ON c.path = v.file_path AND c.line_no BETWEEN v.line_number - 2 AND v.line_number + 2)
  SELECT v.id, n.text, n.rel FROM violations v LEFT JOIN (SELECT id, string_agg(format('{:4d} | {}', line_no, line), chr(10) ORDER BY line_no) AS text, line_number - min(line_no) + 1 AS rel FROM near GROUP BY id, line_number HAVING bool_or(line_no = line_number)) n USING (id)""")
def violation_snippets(spark, sf_dir):
    return remedy.line_snippets(derived(spark, sf_dir, "violations").withColumnRenamed("file_path", "path"), derived(spark, sf_dir, "code_lines"), 2, keep=kept)


@query("""SELECT id AS violation_id, code_snippet AS original_code, 'fixed ' || id AS fixed_code, CASE control_id WHEN 'CC6.1' THEN 'Added access control protection to ensure only authorized users can access this resource.'
  WHEN 'CC6.7' THEN 'Moved hardcoded secret to environment variable. Use secure secret management in production.' WHEN 'CC7.2' THEN 'Added audit logging to track this sensitive operation for compliance monitoring.'
  ELSE 'Added error handling with proper recovery logic to improve system resilience.' END AS explanation, 'review' AS trust_level FROM violations WHERE id % 4 <> 3""")
def new_fix_rows(spark, sf_dir):
    v = derived(spark, sf_dir, "violations")
    code, kind = F.concat(F.lit("fixed "), "id"), F.col("id") % 4
    reply = F.when(kind == 0, F.concat(F.lit("Here it is:\n```python\n"), code, F.lit("\n```\nDone."))).when(kind == 1, F.concat(F.lit("```\n"), code)).otherwise(F.concat(F.lit("\n"), code, F.lit("\r\n")))
    return remedy.new_fixes(v, v.where(kind != 3).select(F.col("id").alias("violation_id"), reply.alias("response")))


# ---- rules


def _rule_query(rule: str) -> None:
    def run(spark, sf_dir):
        return rules.scan_lines(derived(spark, sf_dir, "code_lines"), (rule,), keep=("file_id", "path")).select("path", "severity", "description", "line_number", "code_snippet")

    run.__name__ = f"rule_{rule.lower()}"
    query(rule_sql.select(rule))(run)


for _rule in rules.RULES:
    _rule_query(_rule)


@query(rule_sql.union("SELECT rule, control_id, severity, count(*) AS n FROM found GROUP BY rule, control_id, severity"))
def scan_findings(spark, sf_dir):
    return rules.scan_lines(derived(spark, sf_dir, "code_lines"), keep=("file_id", "path")).groupBy("rule", "control_id", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(rule_sql.union(f"SELECT CAST(floor(file_id / 40) AS BIGINT) AS scan_id, {SEV} FROM found GROUP BY 1", ("R1", "R8", "R12")))
def scan_severity(spark, sf_dir):
    found = rules.scan_lines(derived(spark, sf_dir, "code_lines"), ("R1", "R8", "R12"), keep=("file_id", "path"))
    return reports.severity_counts(found.withColumn("scan_id", F.expr(SCAN_OF)))


@query(f"""SELECT doc_id, CAST(i AS BIGINT) AS line_number FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents) d) x
  WHERE regexp_matches(line, {rule_sql.quoted(rules.SECRET)}) AND NOT regexp_matches(line, {rule_sql.quoted(rules.NO_SECRET)}) AND NOT regexp_matches(trim(line), '^(#|//)')""")
def document_secrets(spark, sf_dir):
    return rules.secret_hits(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {span_sql.SPANS} SELECT path, kind, name, start_line, end_line FROM spans")
def definition_spans(spark, sf_dir):
    return corpus.spans(code_files(spark, sf_dir))


@query("SELECT path, line_no, line FROM code_lines WHERE regexp_matches(line, '^\\s*(import|from)\\s')")
def import_lines(spark, sf_dir):
    return corpus.import_lines(code_files(spark, sf_dir))


@query(span_sql.SPAN_RULES)
def span_rule_findings(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return corpus.span_rules(files, corpus.spans(files))


@query(rule_sql.union(f", {span_sql.SPANS} SELECT path, rule, line_number, {span_sql.within('function', 'f.path', 'line_number')} AS function_name, {span_sql.within('class', 'f.path', 'line_number')} AS class_name FROM found f", ("R8", "R12", "R13")))
def enriched_findings(spark, sf_dir):
    found = rules.scan_lines(derived(spark, sf_dir, "code_lines"), ("R8", "R12", "R13"), keep=("file_id", "path")).withColumn("id", F.struct("path", "rule", "line_number"))
    return merge.enclosing(found, corpus.spans(code_files(spark, sf_dir))).select("path", "rule", "line_number", "function_name", "class_name")


# ---- joins


_NEAR = """WITH RECURSIVE cand AS (SELECT l.scan_id, l.file_path, l.control_id, l.id AS llm_id, list(r.id ORDER BY abs(l.line_number - r.line_number), r.id) AS c
    FROM findings l JOIN findings r ON l.scan_id = r.scan_id AND l.file_path = r.file_path AND l.control_id = r.control_id AND l.detection_method = 'llm' AND r.detection_method = 'regex' AND abs(l.line_number - r.line_number) <= 3
    GROUP BY 1, 2, 3, 4),
  nth AS (SELECT *, row_number() OVER (PARTITION BY scan_id, file_path, control_id ORDER BY llm_id) AS k FROM cand),
  step AS (SELECT scan_id, file_path, control_id, llm_id, k, c[1] AS regex_id, [c[1]] AS used FROM nth WHERE k = 1
    UNION ALL SELECT n.scan_id, n.file_path, n.control_id, n.llm_id, n.k, list_filter(n.c, lambda x: NOT list_contains(s.used, x))[1],
      list_append(s.used, list_filter(n.c, lambda x: NOT list_contains(s.used, x))[1]) FROM step s JOIN nth n ON n.scan_id = s.scan_id AND n.file_path = s.file_path AND n.control_id = s.control_id AND n.k = s.k + 1)"""


def merged_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid merge of the derived findings; they and their matches are written once, as the merge reads them several times."""
    f = kept(derived(spark, sf_dir, "findings"), "findings")
    pattern, model = f.where("detection_method = 'regex'"), f.where("detection_method = 'llm'")
    return merge.merge(pattern, model, pairs=kept(merge.match(pattern, model).select("llm_id", "regex_id"), "pairs"))


@query(_NEAR + " SELECT scan_id, file_path, control_id, llm_id, regex_id FROM step WHERE regex_id IS NOT NULL")
def hybrid_matches(spark, sf_dir):
    f = derived(spark, sf_dir, "findings")
    return merge.match(f.where("detection_method = 'regex'"), f.where("detection_method = 'llm'"))


@query(_NEAR + """ SELECT l.id, CASE least(CASE l.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, CASE r.severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END)
    WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, l.description AS llm_reasoning, 'Pattern match at line ' || r.line_number || ': ' || r.description ||
    CASE WHEN l.line_number <> r.line_number THEN ' (regex detected at line ' || r.line_number || ', LLM at line ' || l.line_number || ')' ELSE '' END AS regex_reasoning
  FROM step s JOIN findings l ON l.id = s.llm_id JOIN findings r ON r.id = s.regex_id""")
def hybrid_reasoning(spark, sf_dir):
    merged = merged_findings(spark, sf_dir)
    return merged.where("detection_method = 'hybrid'").select("id", "severity", "llm_reasoning", "regex_reasoning")


@query(_NEAR + """ SELECT 'hybrid' AS detection_method, count(*) AS n FROM step WHERE regex_id IS NOT NULL UNION ALL
  SELECT detection_method, count(*) FROM findings WHERE id NOT IN (SELECT llm_id FROM step WHERE regex_id IS NOT NULL) AND id NOT IN (SELECT regex_id FROM step WHERE regex_id IS NOT NULL) GROUP BY 1""")
def merge_summary(spark, sf_dir):
    return merged_findings(spark, sf_dir).groupBy("detection_method").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT v.id, v.severity, v.control_id, CASE v.control_id WHEN 'CC6.1' THEN 'Logical Access Controls' WHEN 'CC6.7' THEN 'Cryptography - Encryption and Secrets' WHEN 'CC7.2' THEN 'Monitoring and Logging'
    WHEN 'A1.2' THEN 'Resilience and Error Handling' END AS control_name, f.fix_id, f.trust_level, s.status AS scan_status, s.project_id
  FROM violations v LEFT JOIN (SELECT violation_id, min(id) AS fix_id, arg_min(trust_level, id) AS trust_level FROM fixes GROUP BY 1) f ON f.violation_id = v.id LEFT JOIN scans s ON s.id = v.scan_id""")
def violation_detail(spark, sf_dir):
    s = store_of(spark, sf_dir)
    return bookkeeping.detail(s["violations"], s["fixes"], s["scans"]).select("id", "severity", "control_id", "control_name", "fix_id", "trust_level", "scan_status", "project_id")


@query("""SELECT f.id AS fix_id, f.violation_id, s.project_id, p.path, CASE WHEN s.id IS NULL THEN 'Scan not found' WHEN p.id IS NULL THEN 'Project not found' ELSE 'ok' END AS status
  FROM fixes f JOIN violations v ON v.id = f.violation_id LEFT JOIN scans s ON s.id = v.scan_id LEFT JOIN projects p ON p.id = s.project_id""")
def fix_lineage(spark, sf_dir):
    s = store_of(spark, sf_dir)
    return bookkeeping.lineage(*(s[n] for n in ("fixes", "violations", "scans", "projects"))).select("fix_id", "violation_id", "project_id", "path", "status")


_WANTED = "SELECT id FROM violations WHERE id % 11 = 0"


@query(f"""SELECT 'violation_dismissed' AS event_type, s.project_id, v.id AS violation_id, CAST(NULL AS BIGINT) AS fix_id, 'Dismissed violation: ' || v.description AS description
  FROM violations v JOIN scans s ON s.id = v.scan_id WHERE v.id IN ({_WANTED})""")
def dismissal_audit(spark, sf_dir):
    v = derived(spark, sf_dir, "violations")
    return bookkeeping.dismiss(v, derived(spark, sf_dir, "scans"), v.where("id % 11 = 0").select("id"))[1]


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN id IN ({_WANTED}) THEN 'dismissed' ELSE status END AS status FROM violations) x GROUP BY status")
def dismissals(spark, sf_dir):
    v = derived(spark, sf_dir, "violations")
    return bookkeeping.dismiss(v, derived(spark, sf_dir, "scans"), v.where("id % 11 = 0").select("id"))[0].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _recorded(spark, sf_dir):
    s = store_of(spark, sf_dir)
    s["fixes"] = s["fixes"].withColumn("applied_at", F.col("applied_at").cast("timestamp"))
    lines = bookkeeping.lineage(s["fixes"], s["violations"], s["scans"], s["projects"]).where("fix_id % 7 = 0")
    at = F.lit("2026-01-02 03:04:05").cast("timestamp")
    return bookkeeping.record_fixes(s, lines.select("fix_id", at.alias("applied_at"), bookkeeping.backup_path(F.col("path"), F.col("file_path"), at).alias("backup_path")))


_DONE = "(SELECT f.id AS fix_id, v.id AS violation_id, s.project_id, p.path, v.file_path, v.description FROM fixes f JOIN violations v ON v.id = f.violation_id JOIN scans s ON s.id = v.scan_id JOIN projects p ON p.id = s.project_id WHERE f.id % 7 = 0)"


@query(f"SELECT f.id, d.path || '/.backups/' || regexp_extract(d.file_path, '[^/]*$') || '_20260102_030405' AS backup_path, CASE WHEN d.fix_id IS NOT NULL THEN 'fixed' ELSE v.status END AS status FROM fixes f JOIN violations v ON v.id = f.violation_id LEFT JOIN {_DONE} d ON d.fix_id = f.id")
def recorded_fixes(spark, sf_dir):
    out = _recorded(spark, sf_dir)[0]
    return out["fixes"].select("id", "violation_id", "backup_path").join(out["violations"].select(F.col("id").alias("violation_id"), "status"), "violation_id").drop("violation_id")


@query(f"SELECT 'fix_applied' AS event_type, project_id, violation_id, fix_id, 'Applied fix for violation: ' || description AS description FROM {_DONE} d")
def fix_audit(spark, sf_dir):
    return _recorded(spark, sf_dir)[1]


@query("SELECT CAST(id % 3 AS INT) AS part, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM audit_events GROUP BY 1")
def appended_events(spark, sf_dir):
    folder = changes.work_folder(spark, "append")
    e = derived(spark, sf_dir, "audit_events").select("id", "event_type", (F.col("id") % 3).cast("int").alias("part"))
    bookkeeping.append(e.where("id % 2 = 0"), folder, "part")
    bookkeeping.append(e.where("id % 2 <> 0"), folder, "part")
    return spark.read.parquet(folder).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("""SELECT project_id, CASE max(value) FILTER (WHERE key = 'desktop_notifications') WHEN 'true' THEN true WHEN 'false' THEN false END AS desktop_notifications, max(value) FILTER (WHERE key = 'llm_scan_mode') AS llm_scan_mode,
  try_cast(max(value) FILTER (WHERE key = 'cost_limit_per_scan') AS DOUBLE) AS cost_limit_per_scan FROM settings GROUP BY project_id""")
def settings_view(spark, sf_dir):
    return bookkeeping.typed_settings(derived(spark, sf_dir, "settings"), ["project_id"])


@query("""SELECT 'audit_events' AS table_name, CAST(id AS VARCHAR) AS row_id, 'event_type not allowed' AS rule FROM audit_events WHERE event_type NOT IN ('scan_started', 'scan_completed', 'scan_failed', 'violation_detected', 'violation_dismissed', 'fix_generated', 'fix_applied', 'project_created', 'project_selected', 'project_deleted', 'settings_updated', 'settings_changed', 'scan', 'violation', 'fix') UNION ALL
  SELECT 'scans', CAST(id AS VARCHAR), 'project_id missing' FROM scans WHERE project_id NOT IN (SELECT id FROM projects) UNION ALL
  SELECT 'violations', CAST(id AS VARCHAR), 'scan_id missing' FROM violations WHERE scan_id NOT IN (SELECT id FROM scans) UNION ALL
  SELECT 'settings', key, 'cost_limit_per_scan above 1000' FROM settings WHERE key = 'cost_limit_per_scan' AND try_cast(value AS DOUBLE) > 1000 UNION ALL
  SELECT 'settings', key, 'llm_scan_mode unknown' FROM settings WHERE key = 'llm_scan_mode' AND value NOT IN ('regex_only', 'smart', 'analyze_all')""")
def quarantined_rows(spark, sf_dir):
    return store.quarantined(store_of(spark, sf_dir) | {"settings": derived(spark, sf_dir, "settings")})


@query("""SELECT project_id, CASE project_id % 9 WHEN 0 THEN 'django' WHEN 1 THEN 'flask' WHEN 2 THEN 'nextjs' WHEN 3 THEN 'express' WHEN 4 THEN 'django' WHEN 5 THEN 'flask' WHEN 7 THEN CASE WHEN project_id % 2 = 0 THEN 'react' END END AS framework FROM project_files GROUP BY project_id""")
def project_frameworks(spark, sf_dir):
    return corpus.detect_frameworks(derived(spark, sf_dir, "project_files"))


@query(f"""WITH {span_sql.SPANS}, placed AS (SELECT v.*, {span_sql.within('function', 'v.file_path', 'v.line_number')} AS f, {span_sql.within('class', 'v.file_path', 'v.line_number')} AS c FROM violations v)
  SELECT v.id AS violation_id, 'Fix the following ' || CASE control_id WHEN 'CC6.1' THEN 'access control' WHEN 'CC6.7' THEN 'secrets/cryptography' WHEN 'CC7.2' THEN 'logging' ELSE 'resilience' END || ' violation in ' || coalesce(framework, 'unknown') || ' code:' || chr(10) || chr(10) ||
    'Violation: ' || description || chr(10) || chr(10) || CASE WHEN f IS NOT NULL OR c IS NOT NULL THEN 'Context:' || chr(10) || coalesce('- Function: ' || f || chr(10), '') || coalesce('- Class: ' || c || chr(10), '') || chr(10) ELSE '' END ||
    'Original code:' || chr(10) || '```' || chr(10) || code_snippet || chr(10) || '```' || chr(10) || chr(10) ||
    CASE control_id WHEN 'CC6.1' THEN '' WHEN 'CC6.7' THEN 'Move hardcoded secrets to environment variables. ' WHEN 'CC7.2' THEN 'Add proper audit logging without logging sensitive data. ' ELSE 'Add error handling, timeouts, and retry logic. ' END || 'Provide the fixed code only, no explanation.' AS prompt
  FROM placed v JOIN scans s ON s.id = v.scan_id LEFT JOIN projects p ON p.id = s.project_id""")
def fix_prompts(spark, sf_dir):
    v = derived(spark, sf_dir, "violations").join(derived(spark, sf_dir, "scans").select(F.col("id").alias("scan_id"), "project_id"), "scan_id")
    v = merge.enclosing(v.withColumn("path", F.col("file_path")), corpus.spans(code_files(spark, sf_dir)))
    return prompts.fix_requests(v, derived(spark, sf_dir, "projects").select(F.col("id").alias("project_id"), "framework"))


@query("""WITH code AS (SELECT path, string_agg(line, chr(10) ORDER BY line_no) AS content FROM code_lines GROUP BY path)
  SELECT scan_id, file_path, 'Analyze this file for SOC 2 compliance violations:' || chr(10) || chr(10) || '**File**: ' || file_path || chr(10) || chr(10) || '**Code**:' || chr(10) || '```' || chr(10) || content || chr(10) || '```' || chr(10) || chr(10) ||
    coalesce('**Regex Pattern Detections** (already found):' || chr(10) || string_agg('- Line ' || line_number || ': ' || description || ' (' || control_id || ')' || chr(10), '' ORDER BY line_number, control_id, description) FILTER (WHERE detection_method = 'regex') ||
      chr(10) || 'Focus on finding violations that regex patterns missed.' || chr(10) || chr(10), '') || 'Respond with JSON array of violations (or [] if none found). Consider semantic issues, not just keyword matching.' AS prompt
  FROM violations JOIN code ON path = file_path GROUP BY scan_id, file_path, content""")
def analysis_prompts(spark, sf_dir):
    v = derived(spark, sf_dir, "violations")
    paths = kept(v.select(F.col("file_path").alias("path")).where("path IS NOT NULL").distinct(), "paths")
    code = corpus.gather_lines(corpus.of_paths(derived(spark, sf_dir, "code_lines"), paths), ["file_id", "path"])
    contents = kept(code.select("path", F.array_join("lines", "\n").alias("content")), "contents")
    files = v.select("scan_id", "file_path").distinct().withColumn("path", F.col("file_path"))
    return prompts.analysis_requests(files, v.where("detection_method = 'regex'"), ["scan_id", "file_path"], contents).select("scan_id", "file_path", "prompt")


@query("SELECT id, started_at, status FROM scans WHERE project_id = (SELECT min(project_id) FROM scans)")
def scans_of_project(spark, sf_dir):
    scans = derived(spark, sf_dir, "scans")
    first = scans.agg(F.min("project_id")).first()[0]  # one number
    return reports.project_scans(scans, first).select("id", "started_at", "status")


@query("SELECT scan_id, created_at FROM scan_costs WHERE created_at >= (SELECT max(created_at) FROM scan_costs) - INTERVAL 7 DAYS ORDER BY created_at DESC, scan_id DESC LIMIT 10")
def recent_costs(spark, sf_dir):
    c = derived(spark, sf_dir, "scan_costs")
    return reports.recent_costs(c, "7d", c.agg(F.max("created_at"))).select("scan_id", "created_at")


@query("""SELECT scan_id, round(CASE scan_id % 4 WHEN 0 THEN input_tokens * 0.80::DOUBLE / 1000000 + output_tokens * 4.00::DOUBLE / 1000000 + cache_read_tokens * 0.08::DOUBLE / 1000000 + cache_write_tokens * 1.00::DOUBLE / 1000000
  WHEN 1 THEN input_tokens * 0.20::DOUBLE / 1000000 + output_tokens * 0.50::DOUBLE / 1000000
  WHEN 2 THEN input_tokens * 1.00::DOUBLE / 1000000 + output_tokens * 5.00::DOUBLE / 1000000 + cache_read_tokens * 0.10::DOUBLE / 1000000 + cache_write_tokens * 1.25::DOUBLE / 1000000 END, 8) AS cost FROM scan_costs""")
def costs_by_model(spark, sf_dir):
    model = F.when(F.col("scan_id") % 4 == 0, "haiku").when(F.col("scan_id") % 4 == 1, "grok").when(F.col("scan_id") % 4 == 2, "claude").otherwise("other")
    return reports.priced(derived(spark, sf_dir, "scan_costs").withColumn("model", model)).select("scan_id", F.round("total_cost_usd", 8).alias("cost"))


@query("SELECT id, date_trunc('second', created_at) - CASE id % 3 WHEN 2 THEN INTERVAL 2 HOURS ELSE INTERVAL 0 HOURS END AS at FROM audit_events")
def normalised_times(spark, sf_dir):
    e = derived(spark, sf_dir, "audit_events").withColumn("s", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    text = F.when(F.col("id") % 3 == 0, F.col("s")).when(F.col("id") % 3 == 1, F.concat(F.replace(F.col("s"), F.lit(" "), F.lit("T")), F.lit("Z"))).otherwise(F.concat("s", F.lit("+0200")))
    return e.select("id", sev.parse_time(text).cast("timestamp_ntz").alias("at"))


@query("""SELECT CAST(floor(file_id / 40) AS BIGINT) AS scan_id, count(*) FILTER (WHERE NOT skipped) AS total_files, count(*) FILTER (WHERE NOT skipped AND known) AS files_scanned FROM
  (SELECT DISTINCT file_id, path LIKE 'node_modules/%' AS skipped, path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.ts' AS known FROM code_lines) f GROUP BY 1""")
def scan_file_totals(spark, sf_dir):
    files = derived(spark, sf_dir, "code_lines").select("file_id", "path").distinct().where(~sev.skip_path(F.col("path")))
    return files.groupBy(F.expr(SCAN_OF).alias("scan_id")).agg(F.count(F.lit(1)).alias("total_files"), F.count(sev.language(F.col("path"))).alias("files_scanned"))


@query("SELECT id, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 END AS weight, CASE WHEN status IN ('open', 'fixed', 'dismissed') THEN status ELSE 'open' END AS status FROM violations")
def severity_weights(spark, sf_dir):
    return derived(spark, sf_dir, "violations").select("id", sev.weight(F.col("severity")).alias("weight"), sev.parse_status(F.col("status")).alias("status"))


@query("SELECT key, value FROM (SELECT 'k' || (o_custkey % 500) AS key, CAST(max(o_orderkey) AS VARCHAR) AS value FROM orders GROUP BY 1) s WHERE key NOT IN (SELECT 'k' || (7 * (o_custkey % 70)) FROM orders)")
def settings_delete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.groupBy(F.concat(F.lit("k"), F.col("o_custkey") % 500).alias("key")).agg(F.max("o_orderkey").cast("string").alias("value"))
    return store.delete_keys(rows, orders.select(F.concat(F.lit("k"), F.col("o_custkey") % 70 * 7).alias("key")).distinct(), ["key"])


@query(f"SELECT p.id AS project_id, p.name, round(sum({COST}), 6) AS cost FROM projects p JOIN scans s ON s.project_id = p.id JOIN scan_costs c ON c.scan_id = s.id GROUP BY 1, 2")
def cost_by_project(spark, sf_dir):
    c = costs(spark, sf_dir).join(derived(spark, sf_dir, "scans").select(F.col("id").alias("scan_id"), "project_id"), "scan_id")
    named = c.join(derived(spark, sf_dir, "projects").select(F.col("id").alias("project_id"), "name"), "project_id")
    return named.groupBy("project_id", "name").agg(F.round(F.sum("total_cost_usd"), 6).alias("cost")).orderBy(F.desc("cost"), "project_id")


@query("SELECT f.scan_id, f.file_path, coalesce(string_agg(format('- line {:06d} {} {}', line_number, control_id, severity), chr(10) ORDER BY format('- line {:06d} {} {}', line_number, control_id, severity)) FILTER (WHERE detection_method = 'regex'), '') AS bullets FROM violations f GROUP BY 1, 2")
def regex_context(spark, sf_dir):
    v = derived(spark, sf_dir, "violations")
    return remedy.regex_context(v.select("scan_id", "file_path").distinct(), v)


@query("SELECT s.id FROM scans s WHERE s.id IN (SELECT scan_id FROM scan_costs)")
def scans_with_costs(spark, sf_dir):
    return derived(spark, sf_dir, "scans").join(derived(spark, sf_dir, "scan_costs").select(F.col("scan_id").alias("id")), "id", "left_semi").select("id")


@query("SELECT v.id FROM violations v WHERE v.scan_id NOT IN (SELECT id FROM scans)")
def orphan_violations(spark, sf_dir):
    return derived(spark, sf_dir, "violations").join(derived(spark, sf_dir, "scans").select(F.col("id").alias("scan_id")), "scan_id", "left_anti").select("id")


# ---- aggregations, windows, rankings


@query(f"SELECT scan_id, {SEV} FROM violations GROUP BY scan_id")
def severity_counts(spark, sf_dir):
    return reports.severity_counts(derived(spark, sf_dir, "violations"))


@query("SELECT scan_mode, detection_method, severity, count(*) AS n FROM (SELECT s.scan_mode, v.detection_method, v.severity FROM violations v JOIN scans s ON s.id = v.scan_id) x GROUP BY GROUPING SETS ((scan_mode, detection_method), (scan_mode, severity))")
def method_report(spark, sf_dir):
    return reports.method_report(derived(spark, sf_dir, "violations"), derived(spark, sf_dir, "scans"))


@query(f"SELECT scan_id, file_path, {SEV}, count(*) AS total FROM violations GROUP BY 1, 2")
def file_groups(spark, sf_dir):
    return reports.file_groups(derived(spark, sf_dir, "violations"))


def _health(spark, sf_dir):
    return reports.project_health(*(derived(spark, sf_dir, n) for n in ("projects", "scans", "violations")))


@query(f"WITH {HEALTH} SELECT * FROM health")
def project_health(spark, sf_dir):
    return _health(spark, sf_dir)


@query(f"WITH {HEALTH} SELECT health, count(*) AS n FROM health GROUP BY health")
def health_rollup(spark, sf_dir):
    return _health(spark, sf_dir).groupBy("health").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {HEALTH} SELECT count(*) AS projects, CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium, CAST(sum(low) AS BIGINT) AS low,
  count(*) FILTER (WHERE health = 'healthy') AS healthy, count(*) FILTER (WHERE health = 'critical') AS critical_projects, (SELECT count(*) FROM scans WHERE status = 'completed') AS completed_scans FROM health""")
def dashboard_totals(spark, sf_dir):
    return reports.dashboard_totals(_health(spark, sf_dir), derived(spark, sf_dir, "scans"))


@query(f"SELECT round(sum({COST}), 6) AS cost, CAST(sum(files_analyzed_with_llm) AS BIGINT) AS files_analyzed_with_llm, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, round(avg({COST}), 6) AS per_scan, round(sum({COST}) / sum(files_analyzed_with_llm), 6) AS per_file FROM scan_costs")
def cost_totals(spark, sf_dir):
    return reports.cost_totals(costs(spark, sf_dir))


@query(f"SELECT CAST(day AS VARCHAR) AS day, cost, scans FROM (SELECT CAST(created_at AS DATE) AS day, round(sum({COST}), 6) AS cost, count(*) AS scans FROM scan_costs GROUP BY 1 ORDER BY 1 DESC LIMIT 30) d")
def daily_costs(spark, sf_dir):
    return reports.daily_costs(costs(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("SELECT CAST(CAST(started_at AS DATE) AS VARCHAR) AS day, count(*) AS n FROM scans GROUP BY 1")
def daily_scans(spark, sf_dir):
    return derived(spark, sf_dir, "scans").groupBy(F.to_date("started_at").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "day")


@query("SELECT CAST(sum(input_tokens) AS BIGINT) AS total FROM scan_costs WHERE scan_id < 0")
def empty_sum(spark, sf_dir):
    return derived(spark, sf_dir, "scan_costs").where("scan_id < 0").agg(F.sum("input_tokens").alias("total"))


@query("SELECT count(*) FILTER (WHERE event_type IN ('scan_started','scan_completed')) AS scans, count(*) FILTER (WHERE event_type = 'fix_applied') AS fixes, count(*) FILTER (WHERE event_type = 'violation_detected') AS violations, count(*) AS total FROM audit_events")
def audit_stats(spark, sf_dir):
    kind = F.col("event_type")
    return derived(spark, sf_dir, "audit_events").agg(F.count_if(kind.isin("scan_started", "scan_completed")).alias("scans"), F.count_if(kind == "fix_applied").alias("fixes"), F.count_if(kind == "violation_detected").alias("violations"), F.count(F.lit(1)).alias("total"))


@query("SELECT scan_id, count(DISTINCT file_path) AS files, count(DISTINCT control_id) AS controls, count(*) AS n FROM violations GROUP BY scan_id")
def scan_distincts(spark, sf_dir):
    return derived(spark, sf_dir, "violations").groupBy("scan_id").agg(F.count_distinct("file_path").alias("files"), F.count_distinct("control_id").alias("controls"), F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(severity, 'all') AS tab, count(*) AS n FROM violations GROUP BY ROLLUP (severity)")
def severity_tabs(spark, sf_dir):
    return derived(spark, sf_dir, "violations").rollup("severity").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("severity", F.lit("all")).alias("tab"), "n")


FILE_TOTALS = """(SELECT CAST(floor(file_id / 40) AS BIGINT) AS scan_id, count(*) FILTER (WHERE NOT skipped) AS total_files, count(*) FILTER (WHERE NOT skipped AND known) AS files_scanned FROM
  (SELECT DISTINCT file_id, path LIKE 'node_modules/%' AS skipped, path LIKE '%.py' OR path LIKE '%.js' OR path LIKE '%.ts' AS known FROM code_lines) f GROUP BY 1)"""


@query(f"""SELECT s.id, s.project_id, s.status, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(n, 0) AS violations_found,
    coalesce(total_files, 0) AS total_files, coalesce(files_scanned, 0) AS files_scanned, coalesce(round({COST}, 6), 0) AS total_cost_usd
  FROM scans s LEFT JOIN (SELECT scan_id, {SEV}, count(*) AS n FROM violations GROUP BY 1) c ON c.scan_id = s.id LEFT JOIN {FILE_TOTALS} t ON t.scan_id = s.id LEFT JOIN scan_costs k ON k.scan_id = s.id""")
def scan_summary(spark, sf_dir):
    totals = scan_file_totals(spark, sf_dir)
    return reports.scan_summary(derived(spark, sf_dir, "scans"), derived(spark, sf_dir, "violations"), totals, costs(spark, sf_dir))


@query(f"WITH {DONE} SELECT project_id, id, started_at FROM done WHERE rn = 1")
def latest_scans(spark, sf_dir):
    return reports.latest_scans(derived(spark, sf_dir, "scans")).select("project_id", "id", "started_at")


@query(f"WITH {DONE}, counts AS (SELECT scan_id, {SEV} FROM violations GROUP BY scan_id), last AS (SELECT id AS scan_id, coalesce(completed_at, started_at) AS finished FROM done WHERE rn <= 5 ORDER BY finished DESC, scan_id DESC LIMIT 10) SELECT l.scan_id, finished, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low FROM last l LEFT JOIN counts c ON c.scan_id = l.scan_id")
def violation_trend(spark, sf_dir):
    return reports.trend(derived(spark, sf_dir, "scans"), derived(spark, sf_dir, "violations")).withColumnRenamed("at", "finished")


@query(f"SELECT c.scan_id, s.project_id, round(sum({COST}) OVER (PARTITION BY s.project_id ORDER BY c.created_at, c.scan_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM scan_costs c JOIN scans s ON s.id = c.scan_id")
def running_cost(spark, sf_dir):
    joined = costs(spark, sf_dir).join(derived(spark, sf_dir, "scans").select(F.col("id").alias("scan_id"), "project_id"), "scan_id")
    return reports.running_cost(joined).select("scan_id", "project_id", "running")


FILE_COSTS = "SELECT CAST(floor(file_id / 40) AS BIGINT) AS scan_id, file_id AS file_no, CASE WHEN file_id % 17 = 0 THEN NULL ELSE (file_id % 13) * 0.01::DOUBLE END AS cost, file_id % 500 AS input_tokens, file_id % 70 AS output_tokens FROM (SELECT DISTINCT file_id FROM code_lines) f"
_BUDGET = f"""WITH fc AS ({FILE_COSTS}), r AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY file_no) AS rn, sum(coalesce(cost, 0)) OVER (PARTITION BY scan_id ORDER BY file_no ROWS UNBOUNDED PRECEDING) AS spent, count(*) OVER (PARTITION BY scan_id) AS files FROM fc),
  cut AS (SELECT scan_id, min(rn) AS rn FROM r WHERE rn % 10 = 0 AND round(spent, 9) > 1.0 AND rn < files GROUP BY scan_id)"""


def file_costs(spark, sf_dir):
    files = derived(spark, sf_dir, "code_lines").select("file_id").distinct()
    cost = F.when(F.col("file_id") % 17 == 0, None).otherwise((F.col("file_id") % 13) * F.lit(0.01))
    return files.select(F.expr(SCAN_OF).alias("scan_id"), F.col("file_id").alias("file_no"), cost.alias("cost"), (F.col("file_id") % 500).alias("input_tokens"), (F.col("file_id") % 70).alias("output_tokens"))


@query(_BUDGET + " SELECT r.scan_id, round(r.spent, 6) AS cost, 1.0::DOUBLE AS cost_limit, r.rn AS analysed, r.files - r.rn AS remaining FROM r JOIN cut ON cut.scan_id = r.scan_id AND cut.rn = r.rn")
def budget_events(spark, sf_dir):
    return reports.budget_cut(file_costs(spark, sf_dir))[1]


@query(_BUDGET + " SELECT r.scan_id, count(cost) AS files_analyzed_with_llm, CAST(sum(input_tokens) FILTER (cost IS NOT NULL) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) FILTER (cost IS NOT NULL) AS BIGINT) AS output_tokens, 0::BIGINT AS cache_read_tokens, 0::BIGINT AS cache_write_tokens, round(sum(cost), 6) AS total_cost_usd FROM r LEFT JOIN cut ON cut.scan_id = r.scan_id WHERE cut.rn IS NULL OR r.rn <= cut.rn GROUP BY r.scan_id HAVING count(cost) > 0 AND round(sum(cost), 6) > 0")
def scan_cost_rollup(spark, sf_dir):
    return reports.scan_cost_rollup(reports.budget_cut(file_costs(spark, sf_dir))[0])


@query(f"WITH fc AS ({FILE_COSTS}), r AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY file_no) AS scanned, count(*) OVER (PARTITION BY scan_id) AS total FROM fc) SELECT * FROM r WHERE scanned % 10 = 0 OR scanned = total")
def scan_progress(spark, sf_dir):
    return reports.progress_events(file_costs(spark, sf_dir))


@query(f"SELECT scan_id, round({COST}, 6) AS cost FROM scan_costs ORDER BY {COST} DESC, scan_id LIMIT 3")
def most_expensive(spark, sf_dir):
    return costs(spark, sf_dir).orderBy(F.desc("total_cost_usd"), "scan_id").limit(3).select("scan_id", F.round("total_cost_usd", 6).alias("cost"))


@query(f"SELECT scan_id, round({COST} / files_analyzed_with_llm, 6) AS cost_per_file FROM scan_costs WHERE files_analyzed_with_llm > 0")
def cost_efficiency(spark, sf_dir):
    return costs(spark, sf_dir).where("files_analyzed_with_llm > 0").orderBy("cost_per_file", "scan_id").select("scan_id", F.round("cost_per_file", 6).alias("cost_per_file"))


@query(f"SELECT scan_id, round({COST}, 6) AS cost FROM scan_costs WHERE round({COST}, 6) >= 0.05")
def costs_above(spark, sf_dir):
    return costs(spark, sf_dir).select("scan_id", F.round("total_cost_usd", 6).alias("cost")).where("cost >= 0.05").orderBy(F.desc("cost"), "scan_id")


@query("SELECT s.id, p.name, s.started_at FROM (SELECT * FROM scans WHERE status = 'completed' ORDER BY started_at DESC, id DESC LIMIT 10) s JOIN projects p ON p.id = s.project_id")
def recent_scans(spark, sf_dir):
    return reports.recent_scans(derived(spark, sf_dir, "scans"), derived(spark, sf_dir, "projects")).select("id", "name", "started_at")


@query("SELECT DISTINCT scan_id, file_path, control_id FROM violations")
def distinct_findings(spark, sf_dir):
    return derived(spark, sf_dir, "violations").select("scan_id", "file_path", "control_id").distinct()


# ---- remediation


PATCHED = ("R7", "R12", "R13")
#: Fixes of single lines: the first of a line's, by number, is applied, further ones overlap it.
_FIXES = ", fix AS (SELECT path, line_number, code_snippet, CAST(line_number * 100 + CAST(substr(rule, 2) AS BIGINT) AS BIGINT) AS id, '# fixed ' || rule || ': ' || code_snippet AS fixed FROM found), chosen AS (SELECT *, row_number() OVER (PARTITION BY path, line_number ORDER BY id) AS rn FROM fix)"


def patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(files before, files after with the outcomes of their fixes)."""
    files = code_files(spark, sf_dir).select("path", F.array_join("lines", "\n").alias("content"))
    found = rules.scan_lines(derived(spark, sf_dir, "code_lines"), PATCHED, keep=("file_id", "path"))
    number = F.col("line_number") * 100 + F.substring("rule", 2, 2).cast("long")
    fixes = found.select(number.alias("id"), "path", F.col("code_snippet").alias("original"), F.concat(F.lit("# fixed "), "rule", F.lit(": "), "code_snippet").alias("fixed"), "line_number")
    return files, remedy.apply_patches(files, fixes)


@query(rule_sql.union(_FIXES + """, after AS (SELECT c.path, string_agg(CASE WHEN f.id IS NULL THEN line ELSE replace(line, f.code_snippet, f.fixed) END, chr(10) ORDER BY line_no) AS text, count(f.id) AS changed
    FROM code_lines c LEFT JOIN (SELECT * FROM chosen WHERE rn = 1) f ON f.path = c.path AND f.line_number = c.line_no GROUP BY c.path)
  SELECT a.path, sha256(a.text) AS after_sha256, a.changed, n_fixes FROM after a JOIN (SELECT path, count(*) AS n_fixes FROM fix GROUP BY path) n USING (path)""", PATCHED))
def patched_files(spark, sf_dir):
    files, out = patches(spark, sf_dir)
    out = out.withColumnRenamed("content", "after").join(files, "path")
    return out.select("path", F.sha2("after", 256).alias("after_sha256"), remedy.patch_impact(F.col("content"), F.col("after")).alias("changed"), F.size("outcomes").cast("long").alias("n_fixes"))


@query(rule_sql.union(_FIXES + " SELECT path, id, CASE WHEN rn = 1 THEN 'applied' ELSE 'deferred' END AS status FROM chosen", PATCHED))
def fix_outcomes(spark, sf_dir):
    return patches(spark, sf_dir)[1].select("path", F.inline("outcomes")).select("path", "id", "status")


@query("SELECT file_path, control_id, severity, CAST(line_number AS BIGINT) AS line_number FROM (SELECT 'r' || id AS file_path, control_id, severity, line_number FROM violations WHERE id % 4 < 3) v")
def parsed_replies(spark, sf_dir):
    v = derived(spark, sf_dir, "violations").withColumn("file_path", F.concat(F.lit("r"), "id")).withColumn("description", F.lit("d"))
    one = F.to_json(F.array(F.struct("control_id", "severity", "description", "line_number")))
    kind = F.col("id") % 4
    reply = F.when(kind == 0, one).when(kind == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(kind == 2, F.concat(F.lit('{"violations": '), one, F.lit("}"))).otherwise('[{"control_id": "CC6.1"}]')
    return remedy.parse_replies(v.select("file_path", reply.alias("response")))[0].select("file_path", "control_id", "severity", "line_number")


@query("SELECT 'r' || id AS file_path FROM violations WHERE id % 4 = 3")
def rejected_replies(spark, sf_dir):
    v = derived(spark, sf_dir, "violations").withColumn("file_path", F.concat(F.lit("r"), "id"))
    reply = F.when(F.col("id") % 4 == 3, '[{"control_id": "CC6.1"}]').otherwise("[]")
    return remedy.parse_replies(v.select("file_path", reply.alias("response")))[1].select("file_path")


# ---- streams


@query("SELECT event_type, count(DISTINCT path) AS paths, count(*) AS n FROM file_events GROUP BY event_type")
def event_paths(spark, sf_dir):
    return changes.distinct_paths(derived(spark, sf_dir, "file_events"))


@query("SELECT project_id, min(ts) AS first_ts, max(ts) AS last_ts, round(CASE WHEN floor(epoch(max(ts))) > floor(epoch(min(ts))) THEN count(*) / (floor(epoch(max(ts))) - floor(epoch(min(ts)))) ELSE 0.0 END, 9) AS per_second FROM file_events GROUP BY project_id")
def event_rates(spark, sf_dir):
    return changes.event_rate(derived(spark, sf_dir, "file_events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz")).withColumn("last_ts", F.col("last_ts").cast("timestamp_ntz"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = changes.event_counts(changes.read_changes(spark, sf_dir, schema, "events.parquet"))
    return changes.drain(stream, ["window_start", "event_type"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT project_id, path, arg_max(event_type, (ts, event_id)) AS event_type FROM file_events GROUP BY project_id, path")
def latest_changes(spark, sf_dir):
    return changes.latest_by_path(derived(spark, sf_dir, "file_events")).select("project_id", "path", "event_type")


@query()
def rate_limited_events(spark, sf_dir):
    return changes.rate_limit(derived(spark, sf_dir, "file_events"))


def _event_stream(spark, sf_dir):
    return changes.read_changes(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_distinct_events(spark, sf_dir):
    events = _event_stream(spark, sf_dir)
    return changes.drain(changes.once(events.unionByName(events)).select("event_id", "event_type"), ["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, path FROM file_events WHERE project_id = 7")
def project_changes(spark, sf_dir):
    return changes.of_project(derived(spark, sf_dir, "file_events"), 7).select("event_id", "path")


def _path_events(stream):
    """The derived table file_events over a stream of events."""
    n = F.col("event_id")
    path = F.concat(F.when(n % 10 == 0, "build/f").otherwise("src/f"), n % 97, F.when(n % 3 == 0, ".py").when(n % 3 == 1, ".ts").otherwise(".md"))
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").otherwise("modified")
    return stream.select("event_id", F.col("user_id").alias("project_id"), "ts", path.alias("path"), kind.alias("event_type"))


@query(rule_sql.union("""SELECT f.rule, f.path, f.line_number FROM found f LEFT JOIN (SELECT path, arg_max(event_type, (ts, event_id)) AS event_type FROM file_events GROUP BY path) e ON e.path = f.path WHERE e.event_type IS NULL OR e.event_type <> 'deleted'""", ("R8", "R13")))
def rescanned_findings(spark, sf_dir):
    files = code_files(spark, sf_dir)
    scanner = lambda f: rules.scan(f, ("R8", "R13")).select("rule", "path", "line_number")
    return changes.rescan_stream(_path_events(_event_stream(spark, sf_dir)), scanner(files), files, scanner)


@query(_BUDGET + " SELECT r.scan_id, r.file_no FROM r LEFT JOIN cut ON cut.scan_id = r.scan_id WHERE cut.rn IS NULL OR r.rn <= cut.rn")
def budget_over_stream(spark, sf_dir):
    folder = changes.work_folder(spark, "file-costs")
    file_costs(spark, sf_dir).select("scan_id", "file_no", "cost").write.parquet(folder)
    stream = spark.readStream.schema("scan_id long, file_no long, cost double").parquet(folder)
    return keyed.budget_stream(stream).select("scan_id", "file_no")


@query()
def rate_limited_stream(spark, sf_dir):
    return keyed.rate_limit_stream(_path_events(_event_stream(spark, sf_dir)))


@query()
def rate_limiter_stats(spark, sf_dir):
    return keyed.limiter_stats(_path_events(_event_stream(spark, sf_dir)))


@query("""SELECT event_id, path FROM file_events WHERE path NOT LIKE '%build%' AND (path LIKE '%.py' OR path LIKE '%.ts')""")
def watched_stream(spark, sf_dir):
    return changes.drain(changes.watched(_path_events(_event_stream(spark, sf_dir))).select("event_id", "path"), ["event_id"])


@query("SELECT event_id, path FROM file_events WHERE project_id = 7")
def project_changes_stream(spark, sf_dir):
    return changes.drain(changes.of_project(_path_events(_event_stream(spark, sf_dir)), 7).select("event_id", "path"), ["event_id"])


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts_without_loss(spark, sf_dir):
    counts, _ = changes.counts_and_late(_event_stream(spark, sf_dir))
    return counts.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
