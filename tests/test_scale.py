"""Steps of the compliance operators that have to grow no faster than their tables: what their plans repeat or shuffle."""

import pytest

import corpus_pipeline
from auditlake.llm import langid
from auditlake.operators import corpus, prompts, remedy, store
from auditlake.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replies_are_parsed_once(spark):
    replies = spark.createDataFrame([("a", '```json\n[{"control_id": "CC6.1", "severity": "HIGH", "description": "d", "line_number": 3}]\n```'), ("b", "[{}]"), ("c", None)], "file_path string, response string")
    found, rejects = remedy.parse_replies(replies)
    assert [tuple(r)[:4] for r in found.collect()] == [("a", "CC6.1", "high", "d")]
    assert sorted(r.file_path for r in rejects.collect()) == ["b", "c"]
    assert plan(found).count("from_json(") == 2 and plan(rejects).count("from_json(") == 2  # as an array, as an object


def test_corpus_is_written_by_tasks_and_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "FOLDER_FILES", 2)
    rows = [("src", b"a\n"), ("src", b"bb\n"), ("src", b"\xff\n"), ("lib/venv", b"c\n")]
    corpus.write_files(spark.createDataFrame(rows, "below string, content binary").coalesce(1), str(tmp_path))
    corpus.write_files(spark.createDataFrame(rows, "below string, content binary").coalesce(1), str(tmp_path))  # again: the same names
    told = corpus.told_corpus(spark, str(tmp_path))
    assert sorted((r.path.split("/src/")[1], r.content, r["size"], r.reason) for r in told.collect()) == [("0-0/0.txt", "a\n", 2, None), ("0-0/1.txt", "bb\n", 3, None), ("0-1/2.txt", None, 2, "not UTF-8")]
    assert not [p for p in tmp_path.rglob(".*")]
    assert plan(catalog.queries()["corpus_files"](spark, SF)).count("content#") <= plan(told).count("content#") + 1  # one scan reads contents


ODD = ("a.py", "b c/d%20e.py", "b c/#f?g+h&i[1]{2}.py", "b c/j.py.gz", "venv/k.py", "l/.m/n.py", "l/_o/p.py", "l/_q=r/s.py", "_metadata/t.py", "l/u.py._COPYING_", "l/.v.py", "l/_w.py", "l/empty.py", "l/m/n/o/p/q.py")


def test_large_corpora_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    for name in ODD:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"\xff" if name == "a.py" else name.encode())
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    few = rows(corpus.told_corpus(spark, str(tmp_path)))
    monkeypatch.setattr(corpus, "_by_tasks", lambda top: False)
    scanned = rows(corpus.list_corpus(spark, str(tmp_path)))
    monkeypatch.undo()
    for name, value in (("SCANNED_FILES", 0), ("LISTED_ENTRIES", 2), ("LISTED_FOLDERS", 1), ("READ_FILES", 3), ("BATCH_BYTES", 9)):
        monkeypatch.setattr(corpus, name, value)
    files = corpus.list_corpus(spark, str(tmp_path))
    assert rows(files) == scanned and len(scanned) == 8
    told = corpus.told_corpus(spark, str(tmp_path), files)
    assert rows(told) == few and len(few) == 7 and told.rdd.getNumPartitions() == 3
    assert "binaryFile" not in plan(told) and "binaryFile" not in plan(files)


def test_files_of_a_corpus_are_no_tasks(spark, tmp_path):
    corpus.write_files(spark.range(1200).selectExpr("'src' AS below", "CAST(CAST(id AS STRING) AS BINARY) AS content").coalesce(1), str(tmp_path))
    told = corpus.told_corpus(spark, str(tmp_path))
    assert told.rdd.getNumPartitions() == 1
    assert sorted(int(r.content) for r in told.collect()) == list(range(1200))


def test_spans_are_found_where_files_are(spark):
    py = ["class A:", "  def f(self):", "    x", "", "  y", "async def g():", "\tpass", "\t"]
    js = ["class B {", "  /* {", " */ a(`", "{`) }", "function f(a, {b}) {", "}", "function sign(x);", "function open() {", "  class C {"]
    found = corpus.spans(spark.createDataFrame([("a.py", py), ("b.js", js), ("c.ts", []), ("d.md", py)], "path string, lines array<string>"))
    want = [("a.py", "class", "A", 1, 5), ("a.py", "function", "f", 2, 3), ("a.py", "function", "g", 6, 7), ("b.js", "class", "B", 1, 4), ("b.js", "class", "C", 9, 9), ("b.js", "function", "f", 5, 6), ("b.js", "function", "open", 8, 9)]
    assert sorted(map(tuple, found.collect())) == want
    assert "Window" not in plan(found) and "Join" not in plan(found)


def test_fixes_are_placed_once(spark):
    assert plan(catalog.queries()["fix_outcomes"](spark, SF)).count("aggregate(") == 2  # their places, the sweep


def test_versions_are_numbered_once(spark):
    assert "row_number()" not in plan(catalog.queries()["evolved_violations"](spark, SF))


def test_exports_are_compressed(spark, tmp_path):
    store.export({"t": spark.range(10), "u": spark.range(3)}, str(tmp_path / "e"))
    assert list((tmp_path / "e" / "t").glob("*.json.gz")) and not list((tmp_path / "e" / "t").glob("*.json"))


def test_blocks_stay_with_their_files(spark):
    for name in ("scan_findings", "enriched_findings", "fix_outcomes"):
        df = catalog.queries()[name](spark, SF)
        assert "Aggregate [file_id#" in plan(df) and ", path#" in plan(df)


def test_matches_are_made_once(spark):
    for name in ("merge_summary", "hybrid_reasoning"):
        assert "MapInArrow" not in plan(catalog.queries()[name](spark, SF))


def limits(monkeypatch, small):
    """Everything is sent to all tasks, or nothing is and keys of more than two rows are dealt to parts."""
    if not small:
        for name, value in (("SENT_ROWS", 0), ("DEALT", 2)):
            monkeypatch.setattr(corpus, name, value)


@pytest.mark.parametrize("small", [True, False])
def test_snippets_are_made_once_a_place(spark, monkeypatch, small):
    limits(monkeypatch, small)
    rows = [(i, "a", 2) for i in range(9)] + [(20, "a", 4), (21, "a", 5), (22, "b", 1), (23, "c", 1), (None, "a", 1), (24, None, 1), (25, "a", None)]
    findings = spark.createDataFrame(rows, "id long, path string, line_number long")
    lines = spark.createDataFrame([("a", n, f"a{n}") for n in (1, 2, 3, 4)] + [("b", 1, "b1"), ("d", 1, "d1")], "path string, line_no long, line string")
    found = remedy.line_snippets(findings, lines, 1, False)
    want = [(i, "a1\na2\na3", 2) for i in range(9)] + [(20, "a3\na4", 2), (21, None, None), (22, "b1", 1), *((i, None, None) for i in (23, 24, 25, None))]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert "Aggregate [id#" not in plan(found)


@pytest.mark.parametrize("small", [True, False])
def test_requests_meet_contents_last(spark, monkeypatch, small):
    limits(monkeypatch, small)
    files = spark.createDataFrame([(i, "a") for i in range(9)] + [(1, "b"), (1, "c"), (2, None)], "scan_id long, path string")
    contents = spark.createDataFrame([("a", "x\ny"), ("b", "z"), ("d", "w")], "path string, content string")
    findings = spark.createDataFrame([(3, "a", n, "d", "A1.2") for n in (2, 1)], "scan_id long, path string, line_number long, description string, control_id string")
    held = prompts.analysis_requests(files.join(contents, "path"), findings, ["scan_id", "path"])
    last = prompts.analysis_requests(files, findings, ["scan_id", "path"], contents)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, held.collect())) and last.count() == 10
    left = corpus.join_shared(files, contents, ["path"], "content", ["scan_id"], "left")
    assert sorted(map(tuple, left.collect()), key=str) == sorted(map(tuple, files.join(contents, "path", "left").collect()), key=str)
    assert "row_number()" not in plan(catalog.queries()["analysis_prompts"](spark, SF))  # contents are read, not made for each request


def test_language_stage_returns_no_texts_from_python(spark):
    rows = [(i, f"this is the text of a document {i} in english") for i in range(40)] + [(100 + i, f"dies ist der text von einem dokument {i} auf deutsch") for i in range(40)]
    rows += [(7, "1234"), (8, None), (None, "and another text in english"), (None, "..."), rows[0], rows[0], (9, "")]
    docs = spark.createDataFrame([(*r, "en" if (r[0] or 0) < 100 else "de") for r in rows], "doc_id long, text string, lang string")
    out = corpus_pipeline.identify_language(spark, docs, SF)
    want = langid.recognised(docs, langid.fit(docs), corpus_pipeline.LEAST_SCORE)
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and 70 < out.count() <= len(rows) - 4
    assert "MapInArrow" not in plan(out)
