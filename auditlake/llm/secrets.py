"""Secret scans with corpus-wide ownership of candidates, in DataFrame operations only.

Candidates are found by pattern in each text.  Their hashes are aggregated over the corpus by distinct repositories and
owners: a value that many owners have is an example that was copied about; one that stays with few is a live-looking
credential.  Live-looking values are then also found where they stand without the words that gave them away.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import may_be_in, row_key, split_by, staged


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # for Java and RE2 alike
    group: int  # whose text is the candidate value
    least: int  # characters of that group


# Patterns of candidates.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds in the order of their spans; `owned` are further places of live-looking values.
ORDER = (*(k.name for k in KINDS), "owned")
#: The further places that the DuckDB SQL knows: long runs with a digit in them.
BARE = r"[A-Za-z0-9+/_=-]{16,}"
#: What texts are searched for: whole runs of letters and digits, and two of them with what joins them.
PIECE = r"[A-Za-z0-9]+|[+/_.=-]{6,}"
PAIR = r"(?<![A-Za-z0-9])(?=([A-Za-z0-9]+[+/_.=-]+[A-Za-z0-9]+))"
#: Elements of a group of a running total.
GROUP = 256
#: Code points of a segment of a text: parts of a text are cut from segments, not counted off from its beginning.
SEGMENT = 1024
SEGMENTS = f"(?s).{{1,{SEGMENT}}}"
#: Values that stand for another.
PLACEHOLDER = r"(?i)(example|placeholder|changeme|change_me|dummy|your[_-]|redacted|x{6,}|\*{3,}|0{12,}|1234567890)"
#: A value that more owners than this have is an example.
MOST_OWNERS = 2


def _bound(value: Column, use) -> Column:
    """use(value), with the value worked out once although use() may name it inside a loop over an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, step, zero: int = 0) -> Column:
    """The running totals of an array of longs under an associative step, of those before each element.

    The array is cut into groups of GROUP elements: totals of groups first, then elements within their group, so that no
    step touches the whole array for each element.
    """
    fold = lambda part: F.aggregate(part, F.lit(zero).cast("long"), step)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / GROUP).cast("int")), lambda g: F.slice(v, g * GROUP + 1, F.lit(GROUP)))
    first = lambda gs: F.aggregate(F.transform(gs, fold), F.array(F.lit(zero).cast("long")), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    within = lambda g, before: F.transform(g, lambda _, i: step(before, fold(F.slice(g, F.lit(1), i))))
    each = lambda gs, before: F.flatten(F.transform(gs, lambda g, k: within(g, F.get(before, k))))
    return _bound(values, lambda v: _bound(cut(v), lambda gs: _bound(first(gs), lambda before: each(gs, before))))


def _cut(segments: Column, start: Column, n: Column) -> Column:
    """n code points from `start` on, counted from 0, of a text given as its segments."""
    k = F.floor(start / SEGMENT).cast("int")
    held = F.array_join(F.slice(segments, k + 1, (F.floor((start + n) / SEGMENT) - k + 1).cast("int")), "")
    return F.substring(held, (start - k * SEGMENT + 1).cast("int"), n.cast("int"))


def _spans(text: Column, pattern: str, group: int) -> Column:
    """array<struct<start, end, value>> of all matches of a pattern, in code points.

    split() gives the pieces between the matches that regexp_extract_all() gives, so lengths add up to positions.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    length = lambda c: F.coalesce(F.char_length(c), F.lit(0)).cast("long")
    lengths = lambda ps: F.transform(ps, lambda p: length(p["piece"]) + length(p["match"]))

    def place(ps: Column, before: Column) -> Column:
        start = lambda p, i: F.get(before, i) + length(p["piece"])
        spans = F.transform(ps, lambda p, i: F.when(p["match"].isNotNull(), F.struct(start(p, i).alias("start"), (start(p, i) + length(p["match"])).alias("end"), p["value"].alias("value"))))
        return F.array_compact(spans)

    found = _bound(parts, lambda ps: _bound(running(lengths(ps), lambda x, y: x + y), lambda before: place(ps, before)))
    return F.when(text.rlike(pattern), found).otherwise(F.expr("cast(array() as array<struct<start:bigint,end:bigint,value:string>>)"))


def _ranked(text: Column, rank: int, kind: Kind) -> Column:
    whole = F.filter(_spans(text, kind.pattern, kind.group), lambda s: F.char_length(s["value"]) >= kind.least)
    return F.transform(whole, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"], s["value"]))


def _count(rank: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")


def owner_of(repo: Column) -> Column:
    """The owner of a repository: its name without the last part (OWNER/NAME), or all of it."""
    return F.regexp_replace(repo, "/[^/]*$", "")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """(doc_id, row_key, repo, owner, base) for each row: spans (start, rank, end, value) of the kinds."""
    owner = F.col(owner_col) if owner_col else owner_of(F.col(repo_col))
    return docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.col(repo_col).alias("repo"), owner.alias("owner"), _base(F.col(text_col)).alias("base"))


def _base(text: Column) -> Column:
    return F.array_sort(F.concat(*(_ranked(F.coalesce(text, F.lit("")), rank, kind) for rank, kind in enumerate(KINDS))))


def _occurrences(text: Column) -> Column:
    """array<struct<start, end, value>> of the runs of a text, and of the pairs of joined runs; a pair's end isn't its own."""
    pairs = F.transform(_spans(F.concat(F.lit("\x00"), text), PAIR, 1), lambda s: F.struct((s["start"] - 1).alias("start"), (s["end"] - 1).alias("end"), s["value"].alias("value")))
    return F.concat(_spans(text, PIECE, 0), pairs)


def _apart(places: DataFrame, base: DataFrame) -> DataFrame:
    """The places (row_key, start, end, value) that overlap no base span (row_key, start, end) of their row, by running bounds."""
    both = places.withColumn("is_base", F.lit(False)).union(base.select("row_key", "start", "end", F.lit(None).cast("string").alias("value"), F.lit(True).alias("is_base")))
    row = Window.partitionBy("row_key").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.max(F.when(F.col("is_base"), F.col("end"))).over(row.orderBy("start", F.desc("is_base")))
    following = F.min(F.when(F.col("is_base"), F.col("start"))).over(row.orderBy(F.desc("start"), "is_base"))
    told = both.withColumn("upto", upto).withColumn("following", following).where(~F.col("is_base"))
    return told.where("coalesce(upto <= start, true) and coalesce(following >= end, true)").select("row_key", "start", "end", "value")


def further_places(docs: DataFrame, values: DataFrame, base: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, start, end, value): all places of the values, one column, that overlap no base span (row_key, start, end).

    A place doesn't begin or end within a run of letters and digits (of joining characters, for a value of these alone).
    Texts are searched for one part of each value, its longest pair of joined runs or its only run; where a part stands apart
    from base spans, the whole value is looked for around it.
    """
    extract = lambda c, p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    pairs, runs = extract(F.col("value"), PAIR, 1), extract(F.col("value"), "[A-Za-z0-9]+", 0)
    longest = F.array_max(F.transform(pairs, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("part"))))["part"]
    parts = values.select("value", F.coalesce(longest, F.get(runs, F.lit(0)), F.col("value")).alias("part"))
    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Which texts hold a part at all; only in those are places counted off.
    words = rows.select("row_key", F.explode(F.array_distinct(F.concat(extract(F.col("text"), PIECE, 0), extract(F.col("text"), PAIR, 1)))).alias("piece"))
    met = may_be_in(words, "piece", parts, "part").join(parts.select(F.col("part").alias("piece")), "piece", "left_semi")
    met = staged(met.select(F.col("row_key").alias("met_key")).distinct(), "met")
    pieces = may_be_in(rows, "row_key", met, "met_key").select("row_key", F.explode(_occurrences(F.col("text"))).alias("o")).select("row_key", F.col("o.start").alias("pos"), F.col("o.value").alias("piece"))
    start = F.col("pos") + 1 - F.expr("locate(part, value)")
    hits = may_be_in(pieces, "piece", parts, "part").join(parts, F.col("piece") == F.col("part")).select("row_key", start.alias("start"), (start + F.char_length("value")).alias("end"), "value")
    apart = _apart(hits.where("start >= 0"), base)
    sought = staged(apart.groupBy("row_key").agg(F.collect_set(F.struct("start", "end", "value")).alias("places")), "sought").withColumnRenamed("row_key", "sought_key")
    # Texts move only if they may hold a value.
    held = may_be_in(rows, "row_key", sought, "sought_key").join(sought, F.col("row_key") == F.col("sought_key"))
    segments = F.regexp_extract_all("text", F.lit(SEGMENTS), F.lit(0))

    def stands(segs: Column, p: Column) -> Column:
        """Whether the value is there, apart from what joins its ends; only the place and its neighbours are cut out."""
        kind = F.when(p["value"].rlike("[A-Za-z0-9]"), F.lit("^[A-Za-z0-9]{2}$")).otherwise(F.lit("^[+/_.=-]{2}$"))
        lead, n = F.least(p["start"], F.lit(1)).cast("int"), F.char_length(p["value"])
        joined = lambda two: F.coalesce(F.regexp_like(two, kind), F.lit(False))
        whole = lambda x: (F.substring(x, lead + 1, n) == p["value"]) & ~((lead == 1) & joined(F.substring(x, F.lit(1), F.lit(2)))) & ~joined(F.substring(x, lead + n, F.lit(2)))
        return _bound(_cut(segs, p["start"] - lead, p["end"] - p["start"] + lead + 1), whole)

    return held.select("row_key", F.inline(_bound(segments, lambda segs: F.filter("places", lambda p: stands(segs, p))))).distinct()


def ownership(found: DataFrame, most_owners: int = MOST_OWNERS) -> DataFrame:
    """(value_hash, n_repos, n_owners, live): candidates of the whole corpus by distinct repositories and owners.

    Each (value, repository, owner) counts once whatever the number of its copies; null owners count as one owner.  A value
    is live-looking if few owners have it and nothing in it says that it stands for another (PLACEHOLDER).
    """
    values = found.select("repo", "owner", F.explode("base.value").alias("value")).select(F.sha2("value", 256).alias("value_hash"), F.col("value").rlike(PLACEHOLDER).alias("stands_for"), "repo", "owner")
    # Once to the distinct triples, pre-aggregated in each task, so that a value with very many copies is no large group.
    each = values.groupBy("value_hash", "repo", "owner").agg(F.first("stands_for").alias("stands_for"))
    none = F.lit("\x00")
    counted = each.groupBy("value_hash").agg(F.count_distinct(F.coalesce("repo", none)).alias("n_repos"), F.count_distinct(F.coalesce("owner", none)).alias("n_owners"), F.bool_or("stands_for").alias("stands_for"))
    return counted.withColumn("live", (F.col("n_owners") <= most_owners) & ~F.col("stands_for")).drop("stands_for")


def _common(found: DataFrame, places: DataFrame, most_owners: int) -> DataFrame:
    """(value_hash, common): values that more owners have than most_owners, counting those of their further places (row_key, value_hash).

    So an ordinary word that someone's key word is followed by is no credential, as the texts of many owners have it.
    """
    keys = places.select(F.col("row_key").alias("place_key"), "value_hash").distinct()
    rows = may_be_in(found.select("row_key", "owner").distinct(), "row_key", keys, "place_key")
    where = keys.join(rows, F.col("place_key") == F.col("row_key")).select("value_hash", "owner").distinct()
    told = found.select(F.explode("base.value").alias("value"), "owner").distinct().select(F.sha2("value", 256).alias("value_hash"), "owner")
    told = told.join(where.select("value_hash").distinct(), "value_hash", "left_semi")
    counted = told.union(where).groupBy("value_hash").agg(F.count_distinct(F.coalesce("owner", F.lit("\x00"))).alias("n"))
    return counted.where(F.col("n") > most_owners).select("value_hash", F.lit(True).alias("common"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, most_owners: int = MOST_OWNERS) -> DataFrame:
    """(doc_id, row_key, spans) for each row; a span is (start, rank, end, live, n_repos): kind ORDER[rank], code points, end exclusive.

    Null and empty texts have no spans; rows are told apart by row_key, the hash of id and text, so repeated rows have
    equal spans and other texts of an id their own; null repositories and owners count as one of their own; without an
    owner column, owners are read from the repositories' names; further columns are ignored; no rows give none.
    A value is live if few owners have it wherever it stands; further places are reported of live values only.
    """
    found = staged(candidates(docs, id_col, text_col, repo_col, owner_col), "secrets")
    owners = staged(ownership(found, most_owners), "owners")
    base = found.where("size(base) > 0").select("row_key", F.explode("base").alias("s")).select("row_key", "s.start", "s.rank", "s.end", F.sha2("s.value", 256).alias("value_hash")).distinct()
    live = found.select(F.explode("base.value").alias("value")).distinct().join(owners.where("live").select("value_hash"), F.sha2("value", 256) == F.col("value_hash"))
    places = further_places(docs, staged(live.select("value"), "live"), base, id_col, text_col)
    places = staged(places.select("row_key", "start", F.lit(len(KINDS)).alias("rank"), "end", F.sha2("value", 256).alias("value_hash")), "places")
    owners = staged(owners.join(_common(found, places, most_owners), "value_hash", "left").select("value_hash", "n_repos", (F.col("live") & F.col("common").isNull()).alias("live")), "owners")
    told = base.join(owners.select("value_hash", "live", "n_repos"), "value_hash")
    told = told.union(places.select(base.columns).join(owners.where("live").select("value_hash", "live", "n_repos"), "value_hash"))
    spans = told.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "end", "live", "n_repos"))).alias("spans"))
    joined = found.select("doc_id", "row_key").join(spans, "row_key", "left")
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,live:boolean,n_repos:bigint>>)")
    return joined.select("doc_id", "row_key", F.coalesce("spans", none).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans of scan()."""
    names = F.array(*map(F.lit, ORDER))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] < len(KINDS))
    counts = [_count(rank).alias(f"n_{kind.name}") for rank, kind in enumerate(KINDS)]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live")
    return scanned.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), live)


def mask(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with the live-looking spans of their texts replaced by a mark each, overlapping ones by one; copied examples stay.

    scanned: scan() of the same rows.  Only texts with such spans move.
    """
    live = F.filter("spans", lambda s: s["live"])
    spans = scanned.where(F.exists("spans", lambda s: s["live"])).groupBy("row_key").agg(F.first(live).alias("_masked")).withColumnRenamed("row_key", "_masked_key")
    keyed = docs.withColumn("_row_key", row_key(id_col, text_col))
    may, clean = split_by(keyed, "_row_key", spans, "_masked_key")
    touched = may.join(spans, F.col("_row_key") == F.col("_masked_key"), "left")
    # With where the spans before each one end.
    pieces = lambda upto: F.transform("_masked", lambda m, i: F.struct(m["start"].alias("start"), F.get(upto, i).alias("upto")))
    heads = F.filter(_bound(running(F.col("_masked.end"), lambda x, y: F.greatest(x, y)), pieces), lambda p: p["start"] >= p["upto"])
    segments = F.regexp_extract_all(F.col(text_col), F.lit(SEGMENTS), F.lit(0))
    told = lambda segs: F.array_join(F.transform(heads, lambda p: F.concat(_cut(segs, p["upto"], p["start"] - p["upto"]), F.lit(mark))), "")
    last = F.array_max("_masked.end")
    masked = _bound(segments, lambda segs: F.concat(told(segs), _cut(segs, last, F.char_length(text_col) - last)))
    touched = touched.withColumn(text_col, F.when(F.col("_masked").isNull(), F.col(text_col)).otherwise(masked))
    return clean.select(*docs.columns).union(touched.select(*docs.columns))
