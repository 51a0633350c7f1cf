"""Compliance tables derived from the star-schema test tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import table

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS: dict[str, str] = {}

VIEWS["code_lines"] = """
SELECT file_id, project_id, path, line_no, CASE WHEN script <> '' THEN script ELSE code END AS line FROM (SELECT file_id, file_id % 50 AS project_id,
  CASE WHEN file_id % 11 = 0 THEN 'node_modules/m' || file_id || '.js'
       WHEN file_id % 7 = 0 THEN 'app/tests/test_f' || file_id || '.py'
       WHEN file_id % 5 = 0 THEN 'src/f' || file_id || '.ts'
       WHEN file_id % 3 = 0 THEN 'src/f' || file_id || '.js'
       WHEN file_id % 13 = 0 THEN 'docs/f' || file_id || '.md'
       ELSE 'src/f' || file_id || '.py' END AS path,
  CAST(row_number() OVER (PARTITION BY file_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS line_no,
  CASE WHEN file_id % 11 = 0 OR (file_id % 7 <> 0 AND (file_id % 5 = 0 OR file_id % 3 = 0)) THEN CASE l_partkey % 29
    WHEN 3 THEN '  s = "}{" + `{` + ''{{''; // }' WHEN 5 THEN '  /* { */ (a, [{b}]);' WHEN 11 THEN 'export async function pay(a, {b}) {' WHEN 12 THEN '  } */'
    WHEN 20 THEN '  /* {' WHEN 24 THEN 'function sign(x);' WHEN 25 THEN 'class Account extends Model {' WHEN 26 THEN '  function total(' WHEN 27 THEN '} // done }'
    WHEN 28 THEN '  }' ELSE '' END ELSE '' END AS script,
  CASE l_partkey % 29
    WHEN 0 THEN 'def delete_user(request):' WHEN 1 THEN '@login_required' WHEN 2 THEN '    user.save()'
    WHEN 3 THEN '    logger.info(password)' WHEN 4 THEN '    response = requests.get(url)' WHEN 5 THEN '    # comment .save()'
    WHEN 6 THEN '' WHEN 7 THEN '    cursor.execute(q)' WHEN 8 THEN '    except ValueError:' WHEN 9 THEN '    user_id = 42'
    WHEN 10 THEN '    commit()' WHEN 11 THEN '    x = 1' WHEN 12 THEN 'def admin_purge(request, x):'
    WHEN 13 THEN '    if user.is_staff and check_permission(user):' WHEN 14 THEN '@app.get("/admin/users")'
    WHEN 15 THEN 'def list_users(db=Depends(get_db)):' WHEN 16 THEN '@app.route("/orders", methods=["POST"])'
    WHEN 17 THEN '@app.route("/login")' WHEN 18 THEN 'router.get("/account/me", (req, res) => {'
    WHEN 19 THEN '  router.post("/api/pay", verifyToken, (req, res) => {' WHEN 20 THEN 'def authenticate(user, pwd):'
    WHEN 21 THEN '    api_key = "sk-1234567890abcdef"' WHEN 22 THEN '    api_key = os.getenv("API_KEY")'
    WHEN 23 THEN '    r = requests.post(url, timeout=5)' WHEN 24 THEN '    try:' WHEN 25 THEN 'class Account(Model):'
    WHEN 26 THEN '    with open(path) as f:' WHEN 27 THEN 'import logging' WHEN 28 THEN '    return x' END AS code
FROM (SELECT *, CAST(floor(l_orderkey / 8) AS BIGINT) AS file_id FROM lineitem) l) c
"""

VIEWS["projects"] = """
SELECT c_custkey AS id, c_name AS name, '/p/' || c_custkey AS path,
  CASE c_custkey % 4 WHEN 0 THEN 'django' WHEN 1 THEN 'flask' WHEN 2 THEN 'express' END AS framework
FROM customer
"""

VIEWS["scans"] = """
SELECT o_orderkey AS id, o_custkey AS project_id, o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + (o_orderkey % 90) * INTERVAL '1' MINUTE END AS completed_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CASE o_orderkey % 3 WHEN 0 THEN 'regex_only' WHEN 1 THEN 'smart' ELSE 'analyze_all' END AS scan_mode
FROM orders
"""

VIEWS["violations"] = """
SELECT l_orderkey * 1000 + CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS id,
  l_orderkey AS scan_id,
  CASE l_partkey % 4 WHEN 0 THEN 'CC6.1' WHEN 1 THEN 'CC6.7' WHEN 2 THEN 'CC7.2' ELSE 'A1.2' END AS control_id,
  CASE l_suppkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  'src/f' || (l_partkey % 5) || '.py' AS file_path, CAST(l_quantity AS BIGINT) AS line_number,
  CASE l_returnflag WHEN 'A' THEN 'fixed' WHEN 'N' THEN 'open' ELSE 'dismissed' END AS status,
  CASE WHEN l_linestatus = 'F' THEN 'regex' ELSE 'llm' END AS detection_method,
  'issue ' || (l_suppkey % 7) AS description, 'code(' || (l_partkey % 11) || ')' AS code_snippet, l_shipdate AS detected_at
FROM lineitem
"""

VIEWS["fixes"] = """
SELECT id, id AS violation_id, CASE id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'review' ELSE 'manual' END AS trust_level,
  CASE WHEN status = 'fixed' THEN detected_at END AS applied_at
FROM violations WHERE status <> 'dismissed'
"""

VIEWS["scan_costs"] = """
SELECT l_orderkey AS scan_id, count(*) AS files_analyzed_with_llm,
  CAST(sum(l_partkey) AS BIGINT) * 10 AS input_tokens, CAST(sum(l_suppkey) AS BIGINT) * 20 AS output_tokens,
  CAST(sum(l_linenumber) AS BIGINT) * 100 AS cache_read_tokens, count(*) * 50 AS cache_write_tokens,
  max(l_shipdate) AS created_at
FROM lineitem GROUP BY l_orderkey
"""

VIEWS["audit_events"] = """
SELECT event_id AS id, user_id AS project_id, ts AS created_at, props AS metadata,
  CASE event_type WHEN 'signup' THEN 'scan_started' WHEN 'view' THEN 'scan_completed' WHEN 'click' THEN 'violation_detected'
       WHEN 'purchase' THEN 'fix_applied'
       ELSE CASE event_id % 4 WHEN 0 THEN 'database_cleared' WHEN 1 THEN 'settings_changed' WHEN 2 THEN 'fix_failed' ELSE 'scan' END END AS event_type
FROM events
"""

VIEWS["file_events"] = """
SELECT event_id, user_id AS project_id, ts,
  CASE WHEN event_id % 10 = 0 THEN 'build/f' ELSE 'src/f' END || (event_id % 97) ||
  CASE event_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.md' END AS path,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' ELSE 'modified' END AS event_type
FROM events
"""

VIEWS["findings"] = """
SELECT CAST(floor(l_orderkey / 64) AS BIGINT) AS scan_id, 'src/f' || (l_partkey % 2) || '.py' AS file_path,
  CASE WHEN l_suppkey % 2 = 0 THEN 'CC6.1' ELSE 'A1.2' END AS control_id,
  l_orderkey * 1000 + CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS id,
  CAST(l_quantity AS BIGINT) AS line_number,
  CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  'issue ' || (l_suppkey % 7) AS description,
  CASE WHEN l_linestatus = 'F' THEN 'regex' ELSE 'llm' END AS detection_method
FROM lineitem
"""

VIEWS["settings"] = """
SELECT c_custkey % 40 AS project_id, CASE c_custkey % 4 WHEN 0 THEN 'desktop_notifications' WHEN 1 THEN 'llm_scan_mode' WHEN 2 THEN 'cost_limit_per_scan' ELSE 'theme' END AS key,
  CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END WHEN 1 THEN CASE c_custkey % 5 WHEN 0 THEN 'smart' WHEN 1 THEN 'all' ELSE 'regex_only' END
    WHEN 2 THEN CASE WHEN c_custkey % 6 = 0 THEN '5000.0' ELSE '2.5' END ELSE 'dark' END AS value
FROM customer WHERE c_custkey <= 40
"""

VIEWS["project_files"] = """
SELECT c_custkey AS project_id, CASE c_custkey % 9 WHEN 0 THEN 'web/manage.py' WHEN 1 THEN 'app.py' WHEN 2 THEN 'package.json' WHEN 3 THEN 'package.json' WHEN 4 THEN 'requirements.txt'
    WHEN 5 THEN 'requirements.txt' WHEN 6 THEN 'a/b/c/d/e/settings.py' WHEN 7 THEN 'package.json' ELSE 'src/package.json' END AS path,
  CASE c_custkey % 9 WHEN 2 THEN '{"next": 1, "react": 2}' WHEN 3 THEN '{"express": 1}' WHEN 4 THEN 'Django==4' WHEN 5 THEN CASE WHEN c_custkey % 2 = 0 THEN 'Flask' ELSE 'flask==3' END
    WHEN 7 THEN CASE WHEN c_custkey % 2 = 0 THEN '{"react": 1}' ELSE '{"name": "react", "private": true}' END ELSE '"express": "react": ' END AS content
FROM customer
"""


_NAMES = re.compile(r"\b(FROM|JOIN) (\w+)\b")


def needed(sql: str) -> list[str]:
    """Derived tables that a statement reads, those they are made of first."""
    found: list[str] = []
    for _, name in _NAMES.findall(sql):
        if name in VIEWS:
            found += [x for x in (*needed(VIEWS[name]), name) if x not in found]
    return found


def oracle(sql: str) -> str:
    """A statement over derived tables as one over the given tables."""
    views = ", ".join(f"{name} AS ({VIEWS[name]})" for name in needed(sql))
    if not views:
        return sql
    return f"WITH {views} {sql}" if not sql.lstrip().upper().startswith("WITH") else f"WITH {'RECURSIVE ' if ' RECURSIVE ' in sql[:40].upper() else ''}{views}, " + re.sub(r"^\s*WITH( RECURSIVE)? ", "", sql, flags=re.I)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table over the tables of sf_dir."""
    sql = oracle(f"SELECT * FROM {name}")
    bases = {b for _, b in _NAMES.findall(sql) if b in BASE}
    for base in bases:
        table(spark, sf_dir, base).createOrReplaceTempView(f"auditlake_{base}")
    return spark.sql(_NAMES.sub(lambda m: f"{m[1]} auditlake_{m[2]}" if m[2] in bases else m[0], sql))
