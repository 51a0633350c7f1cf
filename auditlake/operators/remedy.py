"""Model replies, snippets, patches and fix requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .corpus import few, join_shared, of_paths

# Sentences by control, the sentence of any other control, and the trust that a new fix has.
EXPLANATIONS = {
    "CC6.1": "Added access control protection to ensure only authorized users can access this resource.",
    "CC6.7": "Moved hardcoded secret to environment variable. Use secure secret management in production.",
    "CC7.2": "Added audit logging to track this sensitive operation for compliance monitoring.",
    "A1.2": "Added error handling with proper recovery logic to improve system resilience.",
}
EXPLANATION = "Applied security fix to address compliance violation."
NEW_FIX_TRUST = "review"
REPLY = "array<struct<control_id:string,severity:string,description:string,line_number:bigint,code_snippet:string,confidence_score:int,reasoning:string>>"


def strip_fences(text: Column) -> Column:
    """The code inside the first fence; without a whole fence, the text without fence lines and outer line ends."""
    inside = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_+-]*[ \t]*\r?\n(.*?)\r?\n?```", 1)
    lone = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.btrim(x).startswith("```")), "\n")
    code = F.when(~F.contains(text, F.lit("```")), text).when(inside != "", inside).otherwise(lone)
    return F.btrim(code, F.lit("\r\n"))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a column worked out once a row: Spark copies a plain column into each expression and filter that reads it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, rejects) of (file_path, response): an array, or an object with one; all or nothing for each reply."""
    rows = _once(replies, "body", F.btrim(strip_fences(F.col("response")), F.lit(" \t\r\n")))
    body = F.col("body")
    parsed = F.coalesce(F.from_json(F.when(body.startswith("["), body), REPLY), F.from_json(F.when(body.startswith("{"), body), f"struct<violations:{REPLY}>")["violations"])
    rows = _once(rows, "items", F.when(body.isin("", "[]"), F.expr(f"cast(array() as {REPLY})")).otherwise(parsed))
    whole = F.forall("items", lambda x: x["control_id"].isNotNull() & x["severity"].isNotNull() & x["description"].isNotNull() & x["line_number"].isNotNull())
    good = F.coalesce(F.col("items").isNotNull() & whole, F.lit(False))
    found = rows.where(good).select("file_path", F.inline("items"))
    level = F.when(F.lower("severity").isin("critical", "high", "medium", "low"), F.lower("severity")).otherwise("medium")
    return found.withColumn("severity", level), rows.where(~good).select("file_path", "response")


def snippet(lines: Column, line_no: Column, around: int, numbered: bool = True) -> Column:
    """struct<text, rel> of the lines around a line; the line is clamped to the file, rel counts from 1."""
    at = F.greatest(F.least(line_no.cast("int"), F.size(lines)), F.lit(1))
    low, high = F.greatest(at - around, F.lit(1)), F.least(at + around, F.size(lines))
    part = F.slice(lines, low, high - low + 1)
    shown = F.transform(part, lambda x, i: F.format_string("%4d | %s", low + i, x)) if numbered else part
    return F.struct(F.array_join(shown, "\n").alias("text"), (at - low + 1).alias("rel"))


def line_snippets(findings: DataFrame, lines: DataFrame, around: int = 5, numbered: bool = True, keep=lambda df, name: df) -> DataFrame:
    """(id, text, rel) of the lines (path, line_no, line) around each finding (id, path, line_number), null where its line isn't in the file.

    A place (path, line_number) has one snippet, however many findings are there; findings meet it once, and only lines near a
    place meet places, by path and number, so that files may have any length.  keep: writes a table (df, name) that is read several times.
    """
    places = keep(findings.select("path", "line_number").where("path IS NOT NULL AND line_number IS NOT NULL").distinct(), "places")
    near = places.select("path", "line_number", F.explode(F.sequence(F.col("line_number") - around, F.col("line_number") + around)).alias("line_no"))
    held = of_paths(lines.select("path", "line_no", "line"), keep(places.select("path").distinct(), "paths"))
    met = held.join(F.broadcast(near) if few(places, "path") else near, ["path", "line_no"])
    shown = lambda s: F.format_string("%4d | %s", s["line_no"], s["line"]) if numbered else s["line"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), shown), "\n")
    told = met.groupBy("path", "line_number").agg(text.alias("text"), (F.col("line_number") - F.min("line_no") + 1).alias("rel"), F.bool_or(F.col("line_no") == F.col("line_number")).alias("inside"))
    told = keep(told.where("inside").select("path", "line_number", "text", "rel"), "snippets")
    rows = join_shared(findings.select("id", "path", "line_number"), told, ["path", "line_number"], "text", ["id"], "left")
    own = lambda c: F.when(F.col("id").isNotNull(), F.col(c)).alias(c)
    return rows.select("id", own("text"), own("rel"))


OUTCOMES = "array<struct<id:bigint,status:string,start:bigint,end:bigint>>"
# The place of a fix x in content: non-overlapping literal matches are walked once, with the line and the byte they begin at.
_PLACE = r"""
  aggregate(split(content, concat('\\Q', replace(x.original, '\\E', '\\E\\\\E\\Q'), '\\E'), -1),
    cast(struct(1L, 0L, null, null, 0L) as struct<line:bigint,at:bigint,covering:bigint,first:bigint,n:bigint>),
    (a, p) -> struct(
      a.line + char_length(p) - char_length(replace(p, '\n', '')) + x.breaks as line,
      a.at + octet_length(p) + x.size as at,
      if(a.at + octet_length(p) + x.size <= total and a.covering is null
           and x.line_number between a.line + char_length(p) - char_length(replace(p, '\n', '')) and a.line + char_length(p) - char_length(replace(p, '\n', '')) + x.breaks,
         a.at + octet_length(p), a.covering) as covering,
      if(a.first is null and a.at + octet_length(p) + x.size <= total, a.at + octet_length(p), a.first) as first,
      a.n + if(a.at + octet_length(p) + x.size <= total, 1L, 0L) as n))"""
_FOUND = f"""transform(fixes, x -> struct(x.id as id, x.fixed as fixed, x.size as size,
    if(content is null, 'no file', if(x.line_number < 1, 'bad line', if(content = '', 'empty file', if(x.size = 0, 'not found', null)))) as refused,
    if(content is null or content = '' or x.size = 0 or x.line_number < 1, null, {_PLACE}) as place))"""
_TOLD = """transform(found, x -> struct(x.id as id, x.fixed as fixed,
    coalesce(x.refused, if(x.place.n = 0, 'not found', if(x.place.covering is null and x.place.n > 1, 'ambiguous', 'found'))) as status,
    coalesce(x.place.covering, if(x.place.n = 1, x.place.first, null)) as start,
    coalesce(x.place.covering, if(x.place.n = 1, x.place.first, null)) + x.size as end))"""
_SWEEP = """aggregate(array_sort(transform(filter(told, x -> x.status = 'found'), x -> struct(x.start as start, x.end as end, x.id as id, x.fixed as fixed))),
    cast(struct(0L, array()) as struct<upto:bigint,taken:array<struct<start:bigint,end:bigint,id:bigint,fixed:string>>>),
    (a, y) -> if(y.start >= a.upto, struct(y.end as upto, concat(a.taken, array(y)) as taken), a)).taken"""
_SPLICED = """concat(array_join(transform(taken, (y, i) -> concat(cast(substring(raw, cast(if(i = 0, 0L, taken[i - 1].end) + 1 as int), cast(y.start - if(i = 0, 0L, taken[i - 1].end) as int)) as string), y.fixed)), ''),
    cast(substring(raw, cast(if(size(taken) = 0, 0L, element_at(taken, -1).end) + 1 as int)) as string))"""


def apply_patches(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """Files (path, content) under all of their fixes (id, path, original, fixed, line_number): (path, content, outcomes).

    A fix replaces one of the non-overlapping literal matches of `original`: the first whose lines cover line_number, or else
    the only one.  All places are found in the content as given; a sweep over them, by start, end and id, takes each that
    begins at or after the end of the last one taken, and the content is spliced once.  outcomes has a row for each fix:
    applied, deferred (it overlaps an applied one: to be tried on the new content), not found, ambiguous, bad line,
    empty file, no file; start and end are bytes of the content as given.  Ids are unique within a file; an empty original is not
    found; a null `fixed` deletes.  Only files with fixes are returned.  The content is read once, whatever the matches.
    """
    size, breaks = F.octet_length("original").cast("long"), (F.char_length("original") - F.char_length(F.replace(F.col("original"), F.lit("\n"), F.lit("")))).cast("long")
    fix = F.struct(F.col("id").cast("long").alias("id"), "original", F.coalesce("fixed", F.lit("")).alias("fixed"), F.col("line_number").cast("long").alias("line_number"), size.alias("size"), breaks.alias("breaks"))
    rows = fixes.where("path IS NOT NULL AND original IS NOT NULL").groupBy("path").agg(F.collect_list(fix).alias("fixes")).join(files.select("path", "content"), "path", "left")
    rows = rows.withColumn("total", F.octet_length("content").cast("long")).withColumn("raw", F.col("content").cast("binary"))
    rows = _once(_once(_once(rows, "found", F.expr(_FOUND)), "told", F.expr(_TOLD)), "taken", F.expr(_SWEEP))
    applied = "array_contains(transform(taken, y -> y.id), x.id)"
    outcomes = F.expr(f"transform(told, x -> struct(x.id as id, if(x.status = 'found', if({applied}, 'applied', 'deferred'), x.status) as status, x.start as start, x.end as end))")
    return rows.select("path", F.expr(_SPLICED).alias("content"), outcomes.alias("outcomes"))


def patch_impact(before: Column, after: Column) -> Column:
    """Lines that differ by position, and lines appended."""
    a, b = F.split(before, "\n"), F.split(after, "\n")
    both = F.least(F.size(a), F.size(b))
    changed = F.size(F.filter(F.arrays_zip(F.slice(a, 1, both).alias("a"), F.slice(b, 1, both).alias("b")), lambda p: p["a"] != p["b"]))
    return (changed + F.greatest(F.size(b) - F.size(a), F.lit(0))).cast("long")


def explanation(control: Column) -> Column:
    out = F.lit(EXPLANATION)
    for name, text in EXPLANATIONS.items():
        out = F.when(control == name, text).otherwise(out)
    return out


def new_fixes(violations: DataFrame, replies: DataFrame) -> DataFrame:
    """(violation_id, original_code, fixed_code, explanation, trust_level) of replies (violation_id, response)."""
    joined = violations.select(F.col("id").alias("violation_id"), "control_id", F.col("code_snippet").alias("original_code")).join(replies, "violation_id")
    return joined.select("violation_id", "original_code", strip_fences(F.col("response")).alias("fixed_code"), explanation(F.col("control_id")).alias("explanation"), F.lit(NEW_FIX_TRUST).alias("trust_level"))


def regex_context(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(scan_id, file_path, bullets): pattern findings of each file, as the context of a request."""
    bullet = F.format_string("- line %06d %s %s", "line_number", "control_id", "severity")
    lists = findings.where("detection_method = 'regex'").groupBy("scan_id", "file_path").agg(F.array_join(F.sort_array(F.collect_list(bullet)), "\n").alias("bullets"))
    return files.join(lists, ["scan_id", "file_path"], "left").withColumn("bullets", F.coalesce("bullets", F.lit("")))
