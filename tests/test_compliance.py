"""Rules at the edges of their frames, merges, patches, replies, limits, and the registered queries against DuckDB."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from auditlake.functions import severity as sev
from auditlake.operators import corpus, merge, remedy, reports, rules, store
from auditlake.plans import catalog
from auditlake.streaming import changes, keyed

SF = "/root/testdata/sf0.001"


def hits(spark, rule, text, path="src/a.py"):
    files = corpus.with_lines(spark.createDataFrame([(path, text)], "path string, content string"))
    return [(r.line_number, r.severity) for r in rules.scan(files, (rule,)).orderBy("line_number").collect()]


@pytest.mark.parametrize(
    ("rule", "text", "expected"),
    [
        ("R1", "def view(request):\n  pass", [(1, "high")]),
        ("R1", "@login_required\n@other\n\ndef view(request):\n  pass", []),
        ("R1", "@login_required\nx = 1\ndef view(request):\n  pass", [(3, "high")]),
        ("R1", "def view(request):\n a\n b\n c\n current_user", []),
        ("R1", "def view(request):\n a\n b\n c\n d\n current_user", [(1, "high")]),
        ("R2", "user_id = 42\n# user_id = 42", [(1, "high")]),
        ("R5", "@app.get('/admin/x')", []),
        ("R5", "@app.get('/admin/x')\ndef f():", [(1, "high")]),
        ("R6", "@app.route('/a', methods=['POST'])\ndef f():", [(1, "critical")]),
        ("R7", 'a = 1\npassword = "MyS3cr3tP@ssw0rd"\npassword = os.getenv("X")', [(2, "critical")]),
        ("R8", "logger.info()\nuser.save()", []),
        ("R8", "user.save()\na\nb\nlogger.info()", [(1, "medium")]),
        ("R8", "user.save()\na\nlogger.info()", []),
        ("R10", "def login(u):\n a\n b\n audit()", []),
        ("R11", "# commit\ncommit()", [(1, "medium")]),
        ("R12", "try:\n  a\n  b\n  requests.get(u)\nexcept E:", []),
        ("R12", "try:\n  a\n  b\n  c\n  requests.get(u)\nexcept E:", [(5, "high")]),
        ("R13", "requests.get(u,\n  a,\n  timeout=3)", []),
        ("R16", "requests.get(u); requests.get(v)", [(1, "medium")]),
        ("R16", "requests.get(u)", []),
    ],
)
def test_rule_frames(spark, rule, text, expected):
    assert hits(spark, rule, text) == expected


def test_downgrade_and_empty_file(spark):
    assert hits(spark, "R2", "user_id = 42", "app/test_x.py") == []
    assert hits(spark, "R13", "requests.get(u)", "app/tests/x.py") == [(1, "medium")]
    assert hits(spark, "R13", "") == []


def test_merge_is_one_to_one(spark):
    row = "id long, scan_id long, file_path string, control_id string, line_number long, severity string, detection_method string"
    regex = spark.createDataFrame([(1, 1, "f", "c", 10, "low", "regex"), (2, 1, "f", "c", 12, "critical", "regex"), (3, 1, "g", "c", 10, "low", "regex")], row)
    llm = spark.createDataFrame([(11, 1, "f", "c", 11, "high", "llm"), (12, 1, "f", "c", 11, "medium", "llm"), (13, 1, "f", "c", 16, "low", "llm")], row)
    assert {(r.llm_id, r.regex_id) for r in merge.match(regex, llm).collect()} == {(11, 1), (12, 2)}
    found = {(r.id, r.severity, r.detection_method) for r in merge.merge(regex, llm).collect()}
    assert found == {(11, "high", "hybrid"), (12, "critical", "hybrid"), (13, "low", "llm"), (3, "low", "regex")}


def test_merge_of_a_dense_file_against_a_loop(spark):
    rng = random.Random(5)
    row = "id long, scan_id long, file_path string, control_id string, line_number long"
    regex = [(i, i % 2, "f", "c", rng.randint(1, 900)) for i in range(3000)]
    llm = [(10_000 + i, i % 2, "f", "c", rng.randint(1, 900)) for i in range(3000)]
    want, taken = set(), set()
    for i, scan, _, _, line in llm:
        near = sorted((abs(r[4] - line), r[0]) for r in regex if r[1] == scan and abs(r[4] - line) <= 3 and r[0] not in taken)
        if near:
            taken.add(near[0][1])
            want.add((i, near[0][1]))
    assert {(r.llm_id, r.regex_id) for r in merge.match(spark.createDataFrame(regex, row), spark.createDataFrame(llm, row)).collect()} == want


def test_merged_reasoning_and_far_runs(spark):
    row = "id long, scan_id long, file_path string, control_id string, line_number long, severity string, detection_method string, description string, llm_reasoning string"
    regex = spark.createDataFrame([(1, 1, "f", "c", 10, "low", "regex", "r1", None), (2, 1, "f", "c", 90, "low", "regex", "r2", None), (3, 1, "f", "c", 13, "odd", "regex", "r3", None)], row)
    llm = spark.createDataFrame([(11, 1, "f", "c", 10, "high", "llm", "m1", None), (12, 1, "f", "c", 92, "odd", "llm", "m2", "why"), (13, 1, "f", "c", 16, "low", "llm", "m3", None)], row)
    got = {r.id: (r.severity, r.regex_reasoning, r.llm_reasoning) for r in merge.merge(regex, llm).collect()}
    assert got == {
        11: ("high", "Pattern match at line 10: r1", "m1"), 12: ("low", "Pattern match at line 90: r2 (regex detected at line 90, LLM at line 92)", "why"),
        13: ("low", "Pattern match at line 13: r3 (regex detected at line 13, LLM at line 16)", "m3"),
    }


# What each rule reports.
REPORTED = {
    "R1": ("CC6.1", "high", "View function missing authentication decorator or check"),
    "R2": ("CC6.1", "high", "Hardcoded user ID should use request.user or current_user"),
    "R3": ("CC6.1", "critical", "Admin/sensitive operation missing permission check"),
    "R4": ("CC6.1", "high", "Express route missing authentication middleware"),
    "R5": ("CC6.1", "high", "FastAPI endpoint missing Depends(permission) check"),
    "R8": ("CC7.2", "medium", "Sensitive operation without audit logging"),
    "R10": ("CC7.2", "high", "Authentication event without logging"),
    "R11": ("CC7.2", "medium", "Database transaction without logging mechanism"),
    "R12": ("A1.2", "high", "External service call without error handling"),
    "R13": ("A1.2", "high", "External request without timeout configuration"),
    "R14": ("A1.2", "medium", "No retry logic for transient failures"),
    "R15": ("A1.2", "high", "Database operation without error handling"),
    "R16": ("A1.2", "medium", "Multiple external calls without circuit breaker pattern"),
}


def test_what_rules_report(spark):
    assert {r: (rules.RULES[r].control, rules.RULES[r].severity, rules.RULES[r].description) for r in REPORTED} == REPORTED
    files = corpus.with_lines(spark.createDataFrame([("a.py", "@app.route('/a')\nlogger.info(api_key)")], "path string, content string"))
    assert {(r.rule, r.severity, r.description) for r in rules.scan(files, ("R6", "R9")).collect()} == {
        ("R6", "high", "Flask route '/a' missing authentication decorator or check"), ("R9", "critical", "Sensitive data (API key) in logging statement"),
    }


def test_definition_spans_nested(spark):
    text = "class A:\n  def f(self):\n    x\n\n  def g(self):\n    if x:\n      y\nz = 1\ndef h(request):\n  db.execute(f'x')\n\n"
    files = corpus.with_lines(spark.createDataFrame([("a.py", text), ("b.py", ""), ("c.py", None)], "path string, content string"))
    found = corpus.spans(files)
    assert {(r.kind, r.name, r.start_line, r.end_line) for r in found.collect()} == {("class", "A", 1, 7), ("function", "f", 2, 3), ("function", "g", 5, 7), ("function", "h", 9, 10)}
    hits = spark.createDataFrame([(1, "a.py", 7), (2, "a.py", 8), (3, "a.py", 10)], "id long, path string, line_number long")
    assert {(r.id, r.function_name, r.class_name) for r in merge.enclosing(hits, found).collect()} == {(1, "g", "A"), (2, None, None), (3, "h", None)}
    assert {(r.name, r.rule) for r in corpus.span_rules(files, found).collect()} == {("h", "R17")}


def script_spans(spark, text, path="a.ts"):
    files = corpus.with_lines(spark.createDataFrame([(path, text)], "path string, content string"))
    return {(r.kind, r.name, r.start_line, r.end_line) for r in corpus.spans(files).collect()}


def test_spans_of_scripts(spark):
    text = "\n".join([
        "import x from 'y';", "export default async function pay(a, {b}) {", "  const s = '}' + \"{\" + `", "{ ${b} `;  // }", "  function inner(", "    q,", "  )", "  {", "    return [1, {}];", "  }", "}",
        "/* function no() {", " */", "class A extends B {", "  method() { return 1; }", "}", "function one() { return {}; }", "function sign(x): void;", "// function not() {}", "const f = function named() {};", "export class Open {", "  x = 1;",
    ])
    want = {("function", "pay", 2, 11), ("function", "inner", 5, 10), ("class", "A", 14, 16), ("function", "one", 17, 17), ("class", "Open", 21, 22)}
    for path in ("a.ts", "b.js", "c.tsx", "d.jsx"):
        assert script_spans(spark, text, path) == want
    assert script_spans(spark, text, "a.md") == set() and script_spans(spark, "", "a.js") == set() and script_spans(spark, "}}}\n)(", "a.js") == set()
    long = "function f() {\n  x = '" + "\\\\" * 200_000 + "';\n  /*" + "*x" * 200_000 + "*/\n}"
    assert script_spans(spark, long) == {("function", "f", 1, 4)}


def test_outermost_spans_hold_lines(spark):
    rng = random.Random(6)
    spans = [(f"p{rng.randrange(3)}", rng.choice(["function", "class"]), f"n{i}", a, a + rng.choice([0, 3, 40, 3000])) for i in range(120) for a in [rng.randint(1, 6000)]]
    spans = list({s[:2] + (s[3],): s for s in spans}.values())  # one for each start
    points = [(i, f"p{rng.randrange(4)}", rng.randint(0, 9500)) for i in range(800)]
    got = {r.id: (r.function_name, r.class_name) for r in merge.enclosing(spark.createDataFrame(points, "id long, path string, line_number long"), spark.createDataFrame(spans, "path string, kind string, name string, start_line long, end_line long")).collect()}
    first = lambda path, kind, line: min(((s[3], s[2]) for s in spans if s[:2] == (path, kind) and s[3] <= line <= s[4]), default=(0, None))[1]
    assert got == {i: (first(p, "function", n), first(p, "class", n)) for i, p, n in points}


def test_rules_by_blocks_equal_rules_by_files(spark):
    rng = random.Random(8)
    words = [r[1].split("\n") for r in test_rule_frames.pytestmark[0].args[1]]
    words = [w for ws in words for w in ws] + ["x = 1"] * 40 + ["@retry", "audit()", "BEGIN", "requests.get(u)", "breaker"]
    paths = {i: f"src/f{i}.{rng.choice(['py', 'js', 'md'])}" for i in range(30)}
    lines = [(p, n + 1, rng.choice(words[: rng.choice([12, 60, len(words)])])) for p in paths.values() for n in range(rng.choice([1, 7, 49, 50, 51, 230]))]
    table = spark.createDataFrame(lines, "path string, line_no long, line string")
    whole = sorted(map(tuple, rules.scan(corpus.gather_lines(table, ["path"])).collect()))
    assert len({r[1] for r in whole}) >= 10
    for size in (1, 3, 50, 1000):
        assert sorted(map(tuple, rules.scan_lines(table, size=size).collect())) == whole
    plan = rules.scan_lines(table, size=50)._jdf.queryExecution().executedPlan().toString()
    assert "block" in plan


def test_frameworks(spark):
    rows = [
        (1, "manage.py", ""), (1, "app.py", ""), (2, "app.py", ""), (3, "package.json", '{"dependencies": {"next": 1, "react": 2}}'), (4, "package.json", '"react": {}'),
        (5, "x/package.json", '"react": 1'), (6, "a/b/c/d/manage.py", ""), (7, "package.json", '{"name": "react"}'), (8, "requirements.txt", "flask==3"), (9, "package.json", '{"name": "react", "express": "1"}'),
    ]
    got = {r.project_id: r.framework for r in corpus.detect_frameworks(spark.createDataFrame(rows, "project_id long, path string, content string")).collect()}
    assert got == {1: "django", 2: "flask", 3: "nextjs", 4: "react", 5: None, 6: None, 7: None, 8: "flask", 9: "express"}


def stream_of(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def test_rescan_over_several_batches(spark, tmp_path):
    files = corpus.with_lines(spark.createDataFrame([("a.py", "user.save()"), ("b.py", "user.save()"), ("c.py", "x")], "path string, content string"))
    scanner = lambda f: rules.scan(f, ("R8",)).select("rule", "path", "line_number")
    old = spark.createDataFrame([("R8", "b.py", 9), ("R8", "c.py", 1), ("R8", "d.py", 1)], "rule string, path string, line_number long")
    schema = "event_id long, path string, event_type string, ts timestamp_ntz"
    from datetime import datetime as d

    stream = stream_of(spark, tmp_path, [[(1, "a.py", "created", d(2024, 1, 1)), (2, "d.py", "modified", d(2024, 1, 1))], [(3, "d.py", "deleted", d(2024, 1, 2)), (4, "b.py", "modified", d(2024, 1, 2))]], schema)
    got = {(r.path, r.line_number) for r in changes.rescan_stream(stream, old, files, scanner).collect()}
    assert got == {("a.py", 1), ("b.py", 1), ("c.py", 1)}


def test_a_batch_of_one_path_rewrites_one_partition(spark, tmp_path):
    from datetime import datetime as d

    files = corpus.with_lines(spark.createDataFrame([(f"f{i}.py", "user.save()") for i in range(40)], "path string, content string"))
    scanner = lambda f: rules.scan(f, ("R8",)).select("rule", "path", "line_number")
    old = spark.createDataFrame([("R8", f"f{i}.py", 9) for i in range(40)], "rule string, path string, line_number long")
    schema, folder = "event_id long, path string, event_type string, ts timestamp_ntz", f"file://{tmp_path}/work"
    written = lambda: {str(p.relative_to(tmp_path)) for p in (tmp_path / "work" / "findings").rglob("*.parquet")}
    stream = stream_of(spark, tmp_path, [[(1, "f3.py", "modified", d(2024, 1, 1))]], schema)
    table = changes.Findings(f"{folder}/findings", old, 8)
    before = written()
    got = {r.path: r.line_number for r in changes.rescan_stream(stream, old, files, scanner, folder, 8).collect()}
    assert got == {f"f{i}.py": 1 if i == 3 else 9 for i in range(40)}
    assert len({p.split("/")[2] for p in before ^ written()}) == 1
    # A restart goes on from the folder; a batch that comes again changes nothing; the last finding of a partition can go.
    stream_of(spark, tmp_path, [[], [(2, f"f{i}.py", "deleted", d(2024, 1, 2)) for i in range(39)]], schema)
    for _ in range(2):
        assert {(r.path, r.line_number) for r in changes.rescan_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), old, files, scanner, folder, 8).collect()} == {("f39.py", 9)}
    named, found = spark.createDataFrame([("f39.py",)], "path string"), spark.createDataFrame([("R8", "f39.py", 4)], old.schema)
    for _ in range(2):
        assert len(table.replace(named, found)) == 1 and [(r.path, r.line_number) for r in table.read().collect()] == [("f39.py", 4)]


def test_late_rows_are_kept(spark, tmp_path):
    from datetime import datetime as d

    schema = "event_id long, ts timestamp, event_type string"
    batches = [[(1, d(2024, 1, 1, 5), "view"), (2, d(2024, 1, 9), "view")], [(3, d(2024, 1, 1, 6), "view"), (4, d(2024, 1, 8, 1), "click"), (5, d(2024, 1, 12), "view")], [(6, d(2024, 1, 8), "view"), (7, None, "view")]]
    counts, late = changes.counts_and_late(stream_of(spark, tmp_path, batches, schema))
    assert {(r.event_id, r.batch_id) for r in late.collect()} == {(3, 1), (6, 2), (7, 2)}
    got = {(r.window_start, r.event_type): r.n for r in counts.collect()}
    assert got == {(d(2024, 1, 1), "view"): 1, (d(2024, 1, 9), "view"): 1, (d(2024, 1, 8), "click"): 1, (d(2024, 1, 12), "view"): 1}


def test_a_repeated_append_counts_once(spark, tmp_path):
    rows, folder = spark.createDataFrame([(1,), (2,)], "id long"), f"file://{tmp_path}/log"
    for batch in (0, 0, 1, 1):
        changes.append_once(rows.withColumn("id", F.col("id") + 10 * batch), folder, batch)
    assert sorted(r.id for r in changes.appended(spark, folder, "id long").collect()) == [1, 2, 11, 12]


def test_limits_over_several_batches_and_restarts(spark, tmp_path):
    from datetime import datetime as d, timedelta

    rows = [(k, i, d(2024, 1, 1) + timedelta(seconds=3 * i)) for k in (1, 2, None) for i in range(40)] + [(1, 100 + i, d(2024, 1, 4) + timedelta(seconds=i)) for i in range(14)]
    schema = "project_id long, event_id long, ts timestamp_ntz"
    parts = [[r for r in rows if r[1] < 15 and r[0] != 2], [r for r in rows if 15 <= r[1] < 100 and r[0] != 2], [r for r in rows if r[0] == 2], [r for r in rows if r[1] >= 100]]
    folder = f"file://{tmp_path}/limits"
    want = {(r.project_id, r.event_id): tuple(r)[2:] for r in changes.rate_limit(spark.createDataFrame(rows, schema)).collect()}
    for n in (2, 4):  # stops after two files, goes on with the rest
        for i, part in enumerate(parts[n - 2 : n]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{n + i}"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        got = {(r.project_id, r.event_id): tuple(r)[2:] for r in keyed.rate_limit_stream(stream, folder=folder).select("project_id", "event_id", "allowed", "wait_seconds", "limit_type").collect()}
        assert got == {k: v for k, v in want.items() if k in {r[:2] for p in parts[:n] for r in p}}
    stats = {r.project_id: tuple(r)[1:] for r in keyed.limiter_stats(stream, folder=folder).collect()}
    # After three days the buckets of the first key were full again.
    total = lambda key, least=0: sum(v[0] for (k, i), v in want.items() if k == key and i >= least)
    assert stats[1] == (0, 100 - total(1, 100), 500 - total(1, 100), total(1))
    assert stats[2][3] == total(2) and stats[None][3] == total(None)


def test_budgets_over_several_batches_and_restarts(spark, tmp_path):
    costs = [(s, n, None if n % 7 == 0 else 0.02 * s) for s in (1, 5, 9) for n in range(1, 61)]
    schema, folder = "scan_id long, file_no long, cost double", f"file://{tmp_path}/budget"
    kept = set()
    for i, part in enumerate(([r for r in costs if r[1] <= 25], [r for r in costs if 25 < r[1] <= 27], [r for r in costs if r[1] > 27])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        kept = {(r.scan_id, r.file_no) for r in keyed.budget_stream(stream, folder=folder).collect()}
    assert kept == {(r.scan_id, r.file_no) for r in reports.budget_cut(spark.createDataFrame(costs, schema))[0].collect()}


def test_repeated_events_count_once(spark, tmp_path):
    from datetime import datetime as d

    row = (1, d(2024, 1, 1), "view")
    stream = stream_of(spark, tmp_path, [[row, row], [row, (2, d(2024, 1, 1, 1), "view")]], "event_id long, ts timestamp, event_type string")
    assert {r.event_id for r in changes.drain(changes.once(stream), ["event_id"]).collect()} == {1, 2}


def test_times_and_quarantine(spark):
    texts = ["2025-02-01 10:00:00", "2025-02-01T10:00:00Z", "2025-02-01T12:00:00+02:00", "2025-02-01 12:00:00+0200", "junk", None]
    got = [r.t and r.t.isoformat() for r in spark.createDataFrame([(x,) for x in texts], "x string").select(sev.parse_time(F.col("x")).cast("timestamp_ntz").alias("t")).collect()]
    assert got == ["2025-02-01T10:00:00"] * 4 + [None] * 2
    settings = spark.createDataFrame([("cost_limit_per_scan", "-1"), ("llm_scan_mode", "all"), ("theme", "x")], "key string, value string")
    violations = spark.createDataFrame([(1, 1, "high", "open", "llm", 101), (2, 1, "odd", "open", "llm", None)], "id long, scan_id long, severity string, status string, detection_method string, confidence_score int")
    got = {(r.table_name, r.row_id, r.rule) for r in store.quarantined({"violations": violations, "settings": settings}).collect()}
    assert got == {("violations", "2", "severity not allowed"), ("violations", "1", "confidence_score out of 0 to 100"), ("settings", "cost_limit_per_scan", "cost_limit_per_scan below 0"), ("settings", "llm_scan_mode", "llm_scan_mode unknown")}


def test_no_window_spans_a_whole_table(spark):
    for name in ("violation_lookup", "status_updates", "hybrid_matches", "violation_detail", "cascade_delete"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        # A window's partition columns come first; one without any begins with a sort order.
        assert not re.search(r"windowspecdefinition\(\S+ (ASC|DESC)", plan), name


def applied(spark, files, fixes):
    files = spark.createDataFrame(files, "path string, content string")
    fixes = spark.createDataFrame(fixes, "id long, path string, original string, fixed string, line_number long")
    return {r.path: (r.content, {x.id: x.status for x in r.outcomes}) for r in remedy.apply_patches(files, fixes).collect()}


def test_patches(spark):
    files = [("a", 'x\npw = "secret"\ny'), ("b", "q q"), ("c", "q\nq"), ("d", "z"), ("e", "")]
    fixes = [(1, "a", '"secret"', "env()", 2), (2, "b", "q", "r", 9), (3, "c", "q", "r", 2), (4, "d", "q", "r", 1), (5, "e", "q", "r", 1), (6, "f", "q", "r", 1), (7, "d", "z", "r", 0), (8, "d", "", "r", 1)]
    assert applied(spark, files, fixes) == {
        "a": ("x\npw = env()\ny", {1: "applied"}), "b": ("q q", {2: "ambiguous"}), "c": ("q\nr", {3: "applied"}),
        "d": ("z", {4: "not found", 7: "bad line", 8: "not found"}), "e": ("", {5: "empty file"}), "f": (None, {6: "no file"}),
    }


def test_several_patches_of_a_file(spark):
    text = "a = 1\nß = 'x'\nb = a\nb = a\ntail \\E \\Q.*"
    fixes = [(1, "p", "b = a", "b = 2", 4), (2, "p", "ß = 'x'", "s = ''\n", 2), (3, "p", "x'\nb", "-", 2), (4, "p", "a = 1\nß", "no", 1), (5, "p", "\\E \\Q.*", "end", 5), (6, "p", "b = a", "c", 3), (7, "p", "gone", "c", 3), (8, "p", "= ", None, 1)]
    assert applied(spark, [("p", text)], fixes) == {"p": (
        "no = '- = a\nb = 2\ntail end",
        {1: "applied", 2: "deferred", 3: "applied", 4: "applied", 5: "applied", 6: "deferred", 7: "not found", 8: "deferred"},
    )}


def test_patches_against_a_loop(spark):
    rng = random.Random(4)
    files = [(f"f{i}", "".join(rng.choice("ab\né") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    fixes = [(n, f"f{rng.randrange(60)}", "".join(rng.choice("ab\né") for _ in range(rng.randint(1, 3))), rng.choice(["", "ZZ", "\n"]), rng.randint(1, 8)) for n in range(500)]
    want = {}
    for path, text in files:
        status, placed = {}, []
        for n, of, original, fixed, line in fixes:
            if of != path:
                continue
            at, k = [], text.find(original)
            while k >= 0:
                at.append(k)
                k = text.find(original, k + len(original))
            over = [k for k in at if text.count("\n", 0, k) + 1 <= line <= text.count("\n", 0, k) + 1 + original.count("\n")]
            status[n] = "empty file" if not text else "not found" if not at else "ambiguous" if not over and len(at) > 1 else "found"
            if status[n] == "found":
                placed.append(((over or at)[0], (over or at)[0] + len(original), n, fixed))
        out, upto = "", 0
        for start, end, n, fixed in sorted(placed):
            status[n] = "applied" if start >= upto else "deferred"
            if start >= upto:
                out, upto = out + text[upto:start] + fixed, end
        if status:
            want[path] = (out + text[upto:], status)
    assert applied(spark, files, fixes) == want


def test_replies(spark):
    one = '{"control_id":"CC6.1","severity":"weird","description":"d","line_number":3}'
    texts = [("array", f"[{one}]"), ("fence", f"```json\n[{one}]\n```"), ("object", f'{{"violations":[{one}]}}'), ("missing", '[{"control_id":"CC6.1"}]'), ("none", "[]"), ("junk", "sorry")]
    found, rejects = remedy.parse_replies(spark.createDataFrame(texts, "file_path string, response string"))
    assert {(r.file_path, r.severity) for r in found.collect()} == {("array", "medium"), ("fence", "medium"), ("object", "medium")}
    assert {r.file_path for r in rejects.collect()} == {"missing", "junk"}


def test_rate_limit(spark):
    events = spark.createDataFrame([(1, i) for i in range(12)], "project_id long, event_id long").withColumn("ts", F.timestamp_seconds(F.lit(0)))
    got = {r.event_id: (r.allowed, r.wait_seconds, r.limit_type) for r in changes.rate_limit(events).collect()}
    assert [got[i][0] for i in range(12)] == [True] * 10 + [False] * 2
    assert got[11] == (False, 6, "minute")


def test_costs_and_snippets(spark):
    row = "input_tokens long, output_tokens long, cache_read_tokens long, cache_write_tokens long, files_analyzed_with_llm long"
    rows = reports.with_cost(spark.createDataFrame([(10**6, 0, 0, 0, 0), (0, 10**6, 0, 0, 2), (10_000, 5_000, 0, 0, 1)], row)).collect()
    assert [round(r.total_cost_usd, 6) for r in rows] == [0.8, 4.0, 0.028]
    assert [r.cost_per_file for r in rows] == [0.0, 2.0, rows[2].total_cost_usd]
    shown = spark.createDataFrame([(["a", "b", "c", "d", "e"],)], "lines array<string>").select(remedy.snippet(F.col("lines"), F.lit(3), 1).alias("s")).first().s
    assert (shown.text, shown.rel) == ("   2 | b\n   3 | c\n   4 | d", 2)


def test_paths(spark):
    rows = spark.createDataFrame([("a/node_modules/b.js",), ("src/builder.py",), (".git/x.py",), ("src/a.py",)], "p string")
    got = [(r.s, r.w) for r in rows.select(sev.skip_path(F.col("p")).alias("s"), sev.watch_path(F.col("p")).alias("w")).collect()]
    assert got == [(True, False), (False, False), (True, False), (False, True)]


def test_upsert(spark):
    row = "key string, value string, updated_at long"
    out = store.upsert(spark.createDataFrame([("a", "1", 1), ("b", "1", 5)], row), spark.createDataFrame([("a", "2", 2), ("", "x", 9), ("c", "3", 1)], row), ["key"])
    assert {(r.key, r.value) for r in out.collect()} == {("a", "2"), ("b", "1"), ("c", "3")}


def test_read_corpus(spark, tmp_path):
    for name, content in (("d e/a.py", b"x\r\ny\n"), ("b.py", b"\xff\xfe"), ("node_modules/c.py", b"z"), ("d e/venv/e.py", b"\xff"), ("empty.py", b""), ("_f.py", b"z")):
        (tmp_path / "build" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "build" / name).write_bytes(content)
    root = str(tmp_path / "build")
    files, rejects = corpus.read_corpus(spark, root)
    assert {r.path.split("/")[-1]: r.lines for r in corpus.with_lines(files).collect()} == {"a.py": ["x", "y"]}
    assert [(r.path.split("/")[-1], r["size"], r.reason) for r in rejects.collect()] == [("b.py", 2, "not UTF-8")]
    assert {(r.below, r["size"], r.skipped) for r in corpus.list_corpus(spark, root).collect()} == {("d%20e/a.py", 5, False), ("b.py", 2, False), ("node_modules/c.py", 1, True), ("d%20e/venv/e.py", 1, True)}
    files.collect()
    scan = files._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 2  # skipped files are not even opened


def test_versions_of_tables(spark):
    first = spark.createDataFrame([(1, "x")], "id long, severity string")
    second = spark.createDataFrame([(2, "x", "llm", 7), (3, "x", None, None)], "id long, severity string, detection_method string, confidence_score int")
    fourth = spark.createDataFrame([(4, "f", "C", "x", "hybrid")], "id long, function_name string, class_name string, severity string, detection_method string")
    once = store.evolve("violations", [first, second, fourth])
    assert once.columns == ["id", "severity", "detection_method", "confidence_score", "llm_reasoning", "regex_reasoning", "function_name", "class_name"]
    assert {(r.id, r.detection_method, r.confidence_score, r.class_name) for r in once.collect()} == {(1, "regex", None, None), (2, "llm", 7, None), (3, "regex", None, None), (4, "hybrid", None, "C")}
    assert sorted(store.evolve("violations", [once]).collect()) == sorted(once.collect())
    assert "function_name" not in store.evolve("violations", [once], 2).columns
    scans, costs = spark.createDataFrame([(1, "regex_only"), (2, "analyze_all"), (3, None), (4, None)], "id long, scan_mode string"), spark.createDataFrame([(1,), (2,), (3,)], "scan_id long")
    modes = {1: "smart", 2: "analyze_all", 3: "smart", 4: "regex_only"}
    assert {r.id: r.scan_mode for r in store.evolve_scans(scans, costs).collect()} == modes
    assert {r.id: r.scan_mode for r in store.evolve_scans(store.evolve_scans(scans, costs), costs).collect()} == modes


def test_lookups_read_few_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(F.col("id"), (F.col("id") % 500).alias("scan_id"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    folder = f"file://{tmp_path}/t"
    store.save_clustered(rows.repartition(8), folder, ("scan_id", "id"), ("key",), 1 << 20)

    def read(**values):
        found = store.lookup(spark, folder, rows.schema, **values)
        out = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        assert "PushedFilters: [" in plan.toString() and f"{next(iter(values))}" in plan.toString().split("PushedFilters: [")[1].split("]")[0]
        return out, plan.collectLeaves().head().metrics().apply("numOutputRows").value()

    found, scanned = read(scan_id=77)
    assert {r.id for r in found} == set(range(77, 200_000, 500)) and scanned < 60_000
    key = rows.where("id = 4242").first().key
    found, scanned = read(key=key)
    assert [r.id for r in found] == [4242] and scanned < 60_000


@pytest.mark.parametrize("name", ["scan_severity", "scan_findings", "hybrid_matches", "project_health", "violation_trend", "budget_events", "constraint_audit", "stream_event_counts", "hybrid_reasoning", "fix_prompts", "analysis_prompts", "recorded_fixes", "rescanned_findings", "budget_over_stream", "definition_spans", "quarantined_rows", "span_rule_findings", "enriched_findings", "patched_files", "fix_outcomes", "project_frameworks", "rule_r11", "rule_r16", "violation_snippets", "new_fix_rows", "scan_summary", "scan_cost_rollup", "export_manifest", "scan_file_totals", "clustered_lookup", "evolved_violations", "scan_mode_backfill", "corpus_files", "watched_stream", "project_changes_stream", "stream_counts_without_loss"])
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = catalog.queries()[name](spark, SF)
    theirs = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    want = sorted(map(repr, ([round(v, 6) if isinstance(v, float) else v for v in r] for r in theirs.fetchall())))
    got = sorted(map(repr, ([round(v, 6) if isinstance(v, float) else v for v in r] for r in ours.select(*columns).collect())))
    assert got == want
