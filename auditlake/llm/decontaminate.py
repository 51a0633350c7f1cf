"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index holds postings of corpus words: term, row, position.  Which terms are worth storing follows from corpus
frequencies: a benchmark phrase is looked up by its rarest words, so their postings are enough.  A posting at position p of
a phrase's word number o says that the phrase can only start at p - o: the offset-adjusted lists of the rarest words are
intersected first, and the lists of the other words only for the rows and starts that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import may_be_in, row_key, staged

# A word is a run of ASCII letters and digits and of all that isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of phrases or terms up to which they are sent to all tasks; beyond, joins shuffle both sides.
BROADCAST_BYTES = 64 << 20
#: Rarest words of a phrase whose postings are stored.
ANCHORS = 2


def lower_ascii(word: F.Column) -> F.Column:
    """A-Z in lower case, other letters as they are."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words_of(text: F.Column) -> F.Column:
    """The words of a text, as written; null for a null text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows, as text, take at most BROADCAST_BYTES."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def phrases_of(items: DataFrame, length: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(phrase, words, item_id): each run of `length` words of an item; all words of an item of fewer; none without words."""
    words = F.transform(words_of(F.col(text_col)), lower_ascii)
    split = items.select(F.col(id_col).alias("item_id"), words.alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - length + 1, F.lit(1)))
    runs = split.select("item_id", "all", F.explode(starts).alias("at")).select("item_id", F.slice("all", F.col("at"), F.lit(length)).alias("words"))
    return runs.distinct().withColumn("phrase", F.sha2(F.to_json("words"), 256))


def term_frequencies(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): how often each of the given terms occurs in the whole corpus."""
    tokens = docs.select(F.explode(words_of(F.col(text_col))).alias("w")).select(lower_ascii(F.col("w")).alias("term"))
    return tokens.join(_bounded(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, doc_id, row_key, pos) of the given terms, stored in the shared folder; pos counts words from 0.

    Each row of docs also has a posting of the empty term behind its last word, so that its position is the number of words.
    Only positions and words ride on the exploded rows.
    """
    spark = docs.sparkSession
    wanted = _bounded(staged(terms.select("term").union(spark.sql("SELECT '' AS term")).distinct(), "terms"))
    end = F.array(F.lit(""))
    words = F.coalesce(F.concat(words_of(F.col(text_col)), end), end)
    tokens = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("row_key"), F.posexplode(words).alias("pos", "w"))
    return staged(tokens.withColumn("term", lower_ascii(F.col("w"))).join(wanted, "term", "left_semi").select("term", "doc_id", "row_key", "pos"), "postings")


def anchors_of(phrases: DataFrame, frequencies: DataFrame, n: int = ANCHORS) -> DataFrame:
    """(term, offset, phrase, words, rank, ranks): each phrase by its n rarest words in the corpus (all, if it has fewer).

    Phrases that have a word that the corpus lacks are left out.
    """
    each = phrases.select("phrase", "words").distinct().select("phrase", "words", F.posexplode("words").alias("offset", "term"))
    rated = each.join(frequencies, "term", "left").groupBy("phrase", "words").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset"))).alias("rated"))
    chosen = rated.where("rated[0].n > 0").withColumn("rated", F.slice("rated", 1, n))
    return chosen.select("phrase", "words", F.size("rated").alias("ranks"), F.posexplode("rated").alias("rank", "r")).select("r.term", "r.offset", "phrase", "words", "rank", "ranks")


def _starts(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row_key, phrase, start): where the offset-adjusted postings of all anchors of a phrase agree; one partial aggregation."""
    sought = _bounded(anchors.select("term", "offset", "phrase", "rank", "ranks"))
    met = index.join(sought, "term").where("pos >= offset").select("row_key", "phrase", (F.col("pos") - F.col("offset")).alias("start"), F.expr("shiftleft(1L, rank)").alias("bit"), "ranks")
    agreed = met.groupBy("row_key", "phrase", "start").agg(F.bit_or("bit").alias("bits"), F.max("ranks").alias("ranks"))
    return agreed.where("bits = shiftleft(1L, ranks) - 1").select("row_key", "phrase", "start")


def held_rows(docs: DataFrame, keys: DataFrame, key: str, id_col: str, text_col: str) -> DataFrame:
    """(row_key, words) of the rows whose key may be among the keys: pruned by a broadcast table of BITS bits at most."""
    rows = docs.select(row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    return may_be_in(rows, "row_key", keys, key).select("row_key", F.transform(words_of(F.col("text")), lower_ascii).alias("words"))


def phrase_matches(docs: DataFrame, index: DataFrame, anchors: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, phrase, start, n): exact occurrences of phrases, by word positions; phrases of at most 62 words.

    The words of the rows that are left after the anchors are listed by position, and intersected with the words that the
    phrases need there.
    """
    starts = staged(_starts(index, anchors), "starts")
    sought = _bounded(anchors.where("rank = 0").select("phrase", "words"))
    need = starts.join(sought, "phrase").select("row_key", "phrase", "start", F.size("words").alias("n"), F.posexplode("words").alias("k", "word"))
    need = need.withColumn("pos", F.col("start") + F.col("k"))
    have = held_rows(docs, starts, "row_key", id_col, text_col).select("row_key", F.posexplode("words").alias("pos", "word"))
    met = need.join(have, ["row_key", "pos", "word"])
    whole = met.groupBy("row_key", "phrase", "start", "n").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("bits"))
    return whole.where("bits = shiftleft(1L, n) - 1").select("row_key", "phrase", "start", "n")


def proximity_matches(docs: DataFrame, index: DataFrame, anchors: DataFrame, slop: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, phrase, pos): where all words of a phrase, each as often as in the phrase, occur in any order.

    They lie within a run of consecutive words that has at most `slop` words more than the phrase and holds the phrase's
    rarest word at pos.  Rows whose rarest words are close to each other are looked at, whole runs of words then decide.
    """
    sought = anchors.select("term", "phrase", "rank", "ranks", F.size("words").alias("n"))
    met = index.join(_bounded(sought), "term").select("row_key", "phrase", "pos", "rank", "ranks", "n")
    # The last place of each other anchor before, and the first one after, by one sort.
    by_place = Window.partitionBy("row_key", "phrase").orderBy("pos")
    other = F.when(F.col("rank") > 0, F.col("pos"))
    before = F.last(other, ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(other, ignorenulls=True).over(Window.partitionBy("row_key", "phrase").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    reach = F.col("n") + slop - 1
    near = F.coalesce(F.col("pos") - before <= reach, F.lit(False)) | F.coalesce(after - F.col("pos") <= reach, F.lit(False))
    places = staged(met.withColumn("near", near).where("rank = 0 AND (ranks = 1 OR near)").select("row_key", "phrase", "pos").distinct(), "near")
    rows = held_rows(docs, places, "row_key", id_col, text_col).dropDuplicates(["row_key"])
    words = _bounded(anchors.where("rank = 0").select("phrase", F.col("words").alias("sought")))
    run = F.size("sought") + slop
    low = F.greatest(F.col("pos") - run + 1, F.lit(0))
    met = places.join(words, "phrase").join(rows, "row_key").select("row_key", "phrase", "pos", "sought", run.alias("run"), (F.col("pos") - low + 1).alias("own"), F.slice("words", low + 1, F.col("pos") - low + run).alias("near"))
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    holds = lambda part: F.forall(F.array_distinct("sought"), lambda w: times(part, w) >= times(F.col("sought"), w))
    whole = F.exists(F.sequence(F.lit(1), F.col("own")), lambda a: holds(F.slice("near", a, F.col("run"))))
    return met.where((F.size(F.array_except("sought", "near")) == 0) & whole).select("row_key", "phrase", "pos")


def contamination(docs: DataFrame, items: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs.

    A word is hit if it lies in an occurrence of a phrase of `length` words (62 at most) of an item (an item of fewer words is
    one phrase); a document is contaminated if at least a twentieth of its words, and at least one, are hit.  Null or empty
    texts have no words, rows are told apart by row_key, the hash of id and text, so that texts that share an id are judged
    each for itself and repeated rows alike; further columns are ignored, no items hit nothing, no rows give none.
    """
    phrases = staged(phrases_of(items, length), "phrases")
    terms = staged(phrases.select(F.explode("words").alias("term")).distinct(), "phrase-terms")
    anchors = staged(anchors_of(phrases, term_frequencies(docs, terms, text_col)), "anchors")
    index = build_index(docs, anchors, id_col, text_col)
    found = phrase_matches(docs, index, anchors, id_col, text_col).join(_bounded(phrases.select("phrase", "item_id")), "phrase")
    found = found.groupBy("row_key").agg(F.array_sort(F.collect_set(F.struct("start", "n"))).alias("runs"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    covered = F.expr(
        """aggregate(runs, named_struct('hit', 0L, 'upto', 0L),
             (s, r) -> named_struct('hit', s.hit + greatest(r.start + r.n - greatest(cast(r.start as bigint), s.upto), 0L), 'upto', greatest(s.upto, cast(r.start + r.n as bigint))),
             s -> s.hit)"""
    )
    hits = found.select("row_key", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))
    sized = index.where("term = ''").select("doc_id", "row_key", F.col("pos").cast("long").alias("n_words"))
    joined = sized.join(hits, "row_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "row_key", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
