"""Files as rows: reading, lines, spans of definitions, frameworks, and what goes to a model."""

from __future__ import annotations

import re
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import language, skip_path, trimmed
from ..streaming.changes import work_folder
from .rules import VIEW_AUTH

# Words that make a file relevant, by group; compared with the lower-cased text.
KEYWORDS = {
    "auth": (
        "login_required", "permission_required", "requires_auth", "authenticate", "authorize", "check_permission", "is_authenticated", "current_user",
        "session.get", "session.set", "request.user", "jwt.decode", "verify_token", "middleware", "passport", "auth0", "oauth", "saml", "role_required",
        "admin_required",
    ),
    "database": (
        "insert into", "update ", "delete from", "create table", "drop table", "alter table", "select ", ".execute(", ".query(", ".filter(", ".create(",
        ".update(", ".delete(", ".save(", "session.commit", "db.session", "connection.execute", "cursor.execute", "orm.", "sqlalchemy", "sequelize",
        "mongoose", "prisma",
    ),
    "endpoint": (
        "@app.route", "@api.route", "@router.", "router.get", "router.post", "router.put", "router.delete", "app.get(", "app.post(", "app.put(",
        "app.delete(", "express.router", "fastapi", "@blueprint", "flask.request", "request.method", "http.handlefunc", "@restcontroller",
        "@requestmapping", "@getmapping", "@postmapping",
    ),
    "secrets": (
        "password", "secret", "api_key", "apikey", "access_token", "private_key", "client_secret", "auth_token", "bearer", "credentials", "config.get(",
        "os.getenv(", "process.env", "vault", "aws_secret", "encryption", "decrypt",
    ),
    "file_io": ("open(", "file.read", "file.write", "fs.readfile", "fs.writefile", "path.join", "os.path", "upload", "download", "tmpfile", "tempfile"),
    "network": ("requests.", "http.get", "http.post", "fetch(", "axios.", "urllib", "httplib", "curl", "websocket", "socket"),
}


def _top(spark: SparkSession, root: str):
    """A folder by Spark's file systems, as a Java path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where)


def _below(spark: SparkSession, root: str) -> Column:
    """The path of a file below root, by the file's metadata, in URL encoding."""
    top = _top(spark, root).toUri().getRawPath().rstrip("/")
    file = F.col("_metadata.file_path")
    return F.substring(file, F.locate(f"{top}/", file) + len(top) + 1, F.char_length(file))


# What a Java URI encodes in a path.
_ENCODED = re.compile(r"[^!$&-;=@-Z_a-z~\x80-\U0010ffff]|[\s\x7f-\x9f]")


def _encoded(path: str) -> str:
    return _ENCODED.sub(lambda c: quote(c[0]), path)


def _store(top: str) -> tuple[fs.FileSystem, str]:
    """The store of a qualified folder, by Arrow, and the folder there."""
    if top.startswith("file:"):
        return fs.LocalFileSystem(), top.removeprefix("file:").rstrip("/")
    store, folder = fs.FileSystem.from_uri(_encoded(top))
    return store, folder.rstrip("/")


#: Files of a folder that write_files() makes.
FOLDER_FILES = 1000


def write_files(files: DataFrame, root: str) -> None:
    """Write each row (below, content), content binary, as a file of its own in a folder that begins with `below`, under root.

    Tasks write through Arrow: Spark's text writer with a file a row starts a process for each file to set its mode, and the
    driver moves the files one by one.  A task numbers its files, in folders of FOLDER_FILES, which a listing deals to tasks; a
    repeated task writes the same names, and a file gets its name when it is whole.
    """
    where = _top(files.sparkSession, root).toString()

    def write(batches):
        task, (store, top), made, n = TaskContext.get(), _store(where), set(), 0
        for batch in batches:
            for below, content in zip(batch.column(0), batch.column(1), strict=True):
                folder = f"{top}/{below}/{task.partitionId()}-{n // FOLDER_FILES}"
                if folder not in made:
                    store.create_dir(folder)
                    made.add(folder)
                with store.open_output_stream(f"{folder}/.{n}-{task.taskAttemptId()}", compression=None) as out:
                    out.write(content.as_buffer() or b"")
                store.move(f"{folder}/.{n}-{task.taskAttemptId()}", f"{folder}/{n}.txt")
                n += 1
        yield from ()

    files.select("below", "content").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


#: Files of a corpus that Spark's own scan reads: of more, the driver would hold a listing and a task for every 32.
SCANNED_FILES = 500
#: Folders dealt to a task that lists, and entries after which it leaves the folders that it finds to other tasks.
LISTED_FOLDERS, LISTED_ENTRIES = 64, 10_000
#: Files and bytes dealt to a task that reads, and bytes of a batch.
READ_FILES, READ_BYTES, BATCH_BYTES = 2000, 32 << 20, 4 << 20


def _hidden(name: str) -> bool:
    """Whether Spark's listing leaves out a file or folder of this name."""
    marked = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return marked and not name.startswith(("_metadata", "_common_metadata"))


def list_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, below, size, skipped) of the files below a folder, by a listing alone; `below` is the path from root on, in URL encoding.

    Tasks walk through folders, and write the files and the folders left to the next round of tasks, so that the driver holds none
    of them; what is in one folder is listed by one task.  As Spark's own listing does, which lists stores that Arrow
    can't open, this leaves out empty files and those with a part of their path that begins with a dot or an underscore.
    """
    top = _top(spark, root).toString().rstrip("/")
    if not _by_tasks(top):
        below = _below(spark, root)
        return _scanned(spark, root).select("path", below.alias("below"), F.col("length").alias("size"), skip_path(below).alias("skipped"))

    def listed(batches):
        store, there = _store(top)
        for batch in batches:
            given, found, seen = batch.column(0).to_pylist(), [], 0
            while given or found:
                folder = given.pop() if given else found.pop()
                rows = []
                for f in store.get_file_info(fs.FileSelector(f"{there}{folder.removeprefix(top)}" or "/")):
                    seen, path = seen + 1, f"{folder}/{f.base_name}"
                    if _hidden(f.base_name):
                        continue
                    if f.type == fs.FileType.Directory:
                        found.append(path)
                    elif f.size:
                        rows.append((path, _encoded(path[len(top) + 1 :]), f.size))
                if seen >= LISTED_ENTRIES:
                    rows += [(path, None, None) for path in found]
                    found = []
                for at in range(0, len(rows), 10_000):
                    yield _batch(rows[at : at + 10_000], {"path": pa.string(), "below": pa.string(), "size": pa.int64()})

    written, n, turn, columns = work_folder(spark, "listing"), 1, 0, "path string, below string, size long"
    folders = spark.range(1).select(F.lit(top).alias("path"))
    while n:
        folders.repartition(-(-n // LISTED_FOLDERS)).mapInArrow(listed, columns).write.parquet(f"{written}/turn={turn}")
        folders = spark.read.schema(columns).parquet(f"{written}/turn={turn}").where("size IS NULL").select("path")
        n, turn = folders.count(), turn + 1
    files = spark.read.schema(columns).option("recursiveFileLookup", True).parquet(written).where("size IS NOT NULL")
    return files.select("path", "below", "size", skip_path(F.col("below")).alias("skipped"))


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def _by_tasks(top: str) -> bool:
    """Whether Arrow opens a folder, so that tasks may list it."""
    try:
        store, there = _store(top)
        return store.get_file_info(there or "/").type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _scanned(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


def _contents(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(path, content, length) of the files of a listing that scans don't pass over; tasks read them, dealt by number and size."""
    top = _top(spark, root).toString().rstrip("/")
    passed = F.col("skipped")
    n, n_read, n_bytes = files.agg(F.count(F.lit(1)), F.count_if(~passed), F.coalesce(F.sum(F.when(~passed, F.col("size"))), F.lit(0))).first()
    if n <= SCANNED_FILES or not _by_tasks(top):
        return _scanned(spark, root).where(~skip_path(_below(spark, root))).select("path", "content", "length")

    def read(batches):
        (store, there), rows, held = _store(top), [], 0
        types = {"path": pa.string(), "content": pa.binary(), "length": pa.int64()}
        for batch in batches:
            for path, size in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                with store.open_input_file(f"{there}{path.removeprefix(top)}") as file:
                    content = file.readall()
                rows.append((path, content, size))
                held += len(content)
                if held >= BATCH_BYTES:
                    yield _batch(rows, types)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, types)

    parts = max(-(-n_read // READ_FILES), -(-n_bytes // READ_BYTES), 1)
    return files.where(~passed).select("path", "size").repartition(parts).mapInArrow(read, "path string, content binary, length long")


def told_corpus(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """(path, content, size, reason) of the files below a folder that scans don't pass over, read once: content where it is UTF-8, else a reason.

    `files` is what list_corpus() gave, if it was called before.
    """
    found = _contents(spark, root, list_corpus(spark, root) if files is None else files)
    whole = F.is_valid_utf8(F.col("content").cast("string"))
    return found.select("path", F.when(whole, F.col("content").cast("string")).alias("content"), F.col("length").alias("size"), F.when(~whole, "not UTF-8").alias("reason"))


def read_corpus(spark: SparkSession, root: str, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, rejects): (path, content, size) of the UTF-8 files below a folder, and (path, size, reason) of those that aren't.

    Files that scans pass over, by their path from root on, are dropped from the listing: they are never read.
    Files may have any size that a row can hold; empty ones aren't listed, and none whose path has a part with `.` or `_` before it.
    """
    told = told_corpus(spark, root, files)
    return told.where("reason IS NULL").select("path", "content", "size"), told.where("reason IS NOT NULL").select("path", "size", "reason")


def with_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """Lines of a text: a carriage return before a line end goes, and so does an empty last line."""
    split = F.split(text, "\r?\n")
    return files.withColumn("lines", F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split))


def explode_lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode("lines").alias("at", "line")).select("path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def gather_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Files with line arrays from rows (keys, line_no, line)."""
    each = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy(*keys).agg(F.transform(each, lambda s: s["line"]).alias("lines"))


#: Rows, and bytes of text, that are sent to all tasks rather than shuffled.
SENT_ROWS, SENT_BYTES = 50_000, 8 << 20
#: Rows of one key that a join deals to a part.
DEALT = 100_000


def few(rows: DataFrame, *texts: str) -> bool:
    """Whether rows, with texts of these columns, may be sent to all tasks."""
    size = sum((F.octet_length(t) for t in texts), F.lit(0))
    n, n_bytes = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= SENT_ROWS and n_bytes <= SENT_BYTES


def of_paths(lines: DataFrame, paths: DataFrame) -> DataFrame:
    """The lines (path, ...) of these paths (path, each once); where paths are few, other lines are dropped where they are."""
    return lines.join(F.broadcast(paths) if few(paths, "path") else paths, "path", "left_semi")


def join_shared(rows: DataFrame, shared: DataFrame, keys: list[str], text: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with what many of them share: `shared` has each of keys once, and a text; `spread` tells rows of a key apart.

    A small `shared` is sent to all tasks.  Of a larger one, a row that more than DEALT rows need goes to as many parts as they are
    dealt to, so that no task gets all rows of a key; such keys, 1 in DEALT rows at most, are sent to all tasks.
    """
    if few(shared, *keys, text):
        return rows.join(F.broadcast(shared), keys, how)
    often = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / DEALT).alias("_parts")).where("_parts > 1")
    part = F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).alias("_part")
    dealt = rows.join(F.broadcast(often), keys, "left").select(*rows.columns, part)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
    copies = shared.join(F.broadcast(often), keys, "left").select(*shared.columns, each)
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def select_for_model(files: DataFrame, mode: str, text: Column) -> DataFrame:
    """Files with a flag for each keyword group, and whether the mode selects them."""
    low = F.lower(text)
    for group, words in KEYWORDS.items():
        files = files.withColumn(f"has_{group}", F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    relevant = F.greatest(*(F.col(f"has_{g}").cast("int") for g in KEYWORDS)) == 1
    known = language(F.col("path")).isNotNull()
    chosen = {"analyze_all": known, "smart": known & relevant}.get(mode, F.lit(False))
    return files.withColumn("selected", chosen)


def spans(files: DataFrame) -> DataFrame:
    """(path, kind, name, start_line, end_line) of the definitions in files (path, lines), by the language of the path.

    Python: by indentation.  JavaScript and TypeScript: declared functions and classes, by brackets.  Other files have none.
    """
    kind = language(F.col("path"))
    return indented_spans(files.where(kind == "python")).unionByName(bracket_spans(files.where(kind.isin("javascript", "typescript"))))


SPAN = "path string, kind string, name string, start_line long, end_line long"


def indented_spans(files: DataFrame) -> DataFrame:
    """Spans of Python definitions, by indentation.

    A definition ends with the last line that isn't blank before the next one indented no deeper.  A file is one pass over the
    indents of its lines, with a stack of the definitions that are open, where the file is: nothing is shuffled.  Approximate
    where strings or comments span lines.
    """
    indents = F.transform("lines", lambda x: F.coalesce(F.when(trimmed(x) == "", -1).otherwise(F.char_length(F.regexp_extract(x, r"^(\s*)", 1))), F.lit(-1)))
    held = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda s: s["line"].rlike(r"^\s*(async\s+)?(def|class)\s+\w+"))
    kind = lambda line: F.when(line.rlike(r"^\s*class\s"), "class").otherwise("function")
    heads = F.transform(held, lambda s: F.struct(s["at"].alias("at"), kind(s["line"]).alias("kind"), F.regexp_extract(s["line"], r"(?:def|class)\s+(\w+)", 1).alias("name")))
    return files.select("path", indents.alias("indents"), heads.alias("heads")).mapInArrow(_spans_by(_indented), SPAN)


def _spans_by(spans_of):
    """Batches of (path, ...) as batches of spans: spans_of yields (kind, name, start, end) of what a row has after its path."""

    def run(batches):
        names = ["path", "kind", "name", "start_line", "end_line"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            found = [(path, *s) for i, path in enumerate(batch.column(0).to_pylist()) for s in spans_of(*(batch.column(k)[i].as_py() for k in range(1, batch.num_columns)))]
            columns = zip(*found, strict=True) if found else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _indented(indents, heads):
    named, open_, last = {h["at"]: h for h in heads or ()}, [], 0  # without lines, both are null
    for at, indent in enumerate(indents if named else ()):
        if indent < 0:
            continue
        while open_ and open_[-1][0] >= indent:
            _, h = open_.pop()
            yield h["kind"], h["name"], h["at"] + 1, last
        last = at + 1
        if at in named:
            open_.append((indent, named[at]))
    for _, h in open_:
        yield h["kind"], h["name"], h["at"] + 1, last


#: What counts in JavaScript and TypeScript, in the order in which it is looked for: comments, strings and templates, which may hold
#: anything, line ends, headers of declarations at the start of a line, brackets and semicolons.
TOKENS = (
    r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", r"//[^\n]*", r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'", r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"', r"`[^`\\]*(?:\\[\s\S][^`\\]*)*`", r"\n",
    r"(?m:^)[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]+[A-Za-z_$][A-Za-z0-9_$]*",
    r"(?m:^)[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?class[ \t]+[A-Za-z_$][A-Za-z0-9_$]*", r"[{}()\[\];]",
)
TOKEN = "|".join(TOKENS)
# In Java, repeated groups recurse unless they are possessive; what follows them can't begin what they hold, so that is the same.
_JAVA_TOKEN = TOKEN.replace(")*", ")*+")
HEADER = r"(function|class)[ \t]+([A-Za-z_$][A-Za-z0-9_$]*)$"
_HEADER = re.compile(HEADER)


def bracket_spans(files: DataFrame) -> DataFrame:
    """Spans of declared functions and classes of JavaScript and TypeScript, by a running sum of brackets outside strings and comments.

    A declaration is open from the first brace at its own depth, unless a semicolon comes first (a signature without a body), and
    ends with the brace that brings the depth back; without one, with the last line.  Approximate: headers count at the
    start of a line only, `${}` inside templates and regular expressions are text like the rest, and a braced return type
    is taken for the body.  Work grows with brackets and lines; a file is one pass over its tokens, where the file is: nothing is shuffled.
    """
    found = F.regexp_extract_all(F.array_join("lines", "\n"), F.lit(_JAVA_TOKEN), 0)
    # Of comments and templates only the line ends count, of strings nothing.
    tokens = F.transform(found, lambda t: F.when(F.substring(t, 1, 1).isin("/", "'", '"', "`"), F.regexp_replace(t, "[^\n]+", "")).otherwise(t))
    return files.select("path", F.size("lines").alias("n_lines"), F.filter(tokens, lambda t: t != "").alias("tokens")).mapInArrow(_spans_by(_bracketed), SPAN)


def _bracketed(n_lines, tokens):
    # By depth: declarations that wait for a body, those among them whose depth a brace has brought back before, and those that have a body.
    line, depth, waiting, ended, bodies = 1, 0, {}, {}, {}
    for token in tokens or ():
        if token == "{":
            bodies.setdefault(depth, []).extend(waiting.pop(depth, ()))
            yield from ended.pop(depth, ())
            depth += 1
        elif token == "}":
            depth -= 1
            yield from ((*head, line) for head in bodies.pop(depth, ()))
            ended.setdefault(depth, []).extend((*head, line) for head in waiting.pop(depth, ()))
        elif token in "([":
            depth += 1
        elif token in ")]":
            depth -= 1
        elif token == ";":
            waiting.pop(depth, None)
            ended.pop(depth, None)
        elif token[0] == "\n":
            line += len(token)
        else:
            waiting.setdefault(depth, []).append((*_HEADER.search(token).groups(), line))
    yield from ((*head, n_lines) for heads in bodies.values() for head in heads)


def import_lines(files: DataFrame) -> DataFrame:
    return explode_lines(files).where(F.col("line").rlike(r"^\s*(import|from)\s"))


def span_rules(files: DataFrame, found: DataFrame) -> DataFrame:
    """Findings over whole Python functions: views without authentication, SQL by interpolation, unescaped HTML."""
    python = files.where(language(F.col("path")) == "python")
    held = found.where("kind = 'function'").join(python.select("path", "lines"), "path")
    body = F.array_join(F.slice("lines", F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")
    above = F.slice("lines", F.greatest(F.col("start_line") - 5, F.lit(1)).cast("int"), F.least(F.lit(5), F.col("start_line") - 1).cast("int"))
    held = held.withColumn("body", body).withColumn("guarded", F.exists(above, lambda x: x.rlike(r"^\s*" + VIEW_AUTH)))
    has = lambda *words: [F.contains("body", F.lit(w)) for w in words]
    request, run, fmt, dot, reply, html, plus = has("(request", ".execute(", 'f"', '".format(', "HttpResponse(", "<html", "+")
    rules = F.array(
        F.when(request & ~F.col("guarded"), F.lit("R17")), F.when(run & (fmt | dot), F.lit("R18")), F.when(reply & html & (fmt | plus), F.lit("R19"))
    )
    return held.select("path", "name", "start_line", F.explode(F.array_compact(rules)).alias("rule"))


def detect_frameworks(files: DataFrame) -> DataFrame:
    """(project_id, framework) of files (project_id, path, content): django, flask, nextjs, express, react, in this order.

    A package counts if package.json names it as a key followed by a colon and a space, wherever that is.
    """
    name = F.element_at(F.split("path", "/"), -1)
    depth = F.size(F.split("path", "/"))
    low = F.lower("content")
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    near = depth <= 4
    package = (name == "package.json") & (depth == 1)
    flask = F.contains("content", F.lit("Flask")) | F.contains("content", F.lit("flask"))
    flags = files.groupBy("project_id").agg(
        any_of(near & (name.isin("manage.py", "settings.py") | ((name == "requirements.txt") & F.contains(low, F.lit("django"))))).alias("django"),
        any_of((depth == 1) & (name.isin("app.py", "routes.py") | ((name == "requirements.txt") & flask))).alias("flask"),
        *(any_of(package & F.contains("content", F.lit(f'"{x}": '))).alias(x) for x in ("next", "react", "express")),
    )
    choice = F.when(F.col("django"), "django").when(F.col("flask"), "flask").when(F.col("next") & F.col("react"), "nextjs").when(F.col("express"), "express").when(F.col("react"), "react")
    return flags.select("project_id", choice.alias("framework"))
