"""Corpus pipeline: language ID, near duplicates, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written to the shared
folder and read again as the next one's docs.  All but the last return the columns of documents, whatever else they hold.

Rows are told apart by row_key, the hash of their id and text: rows that share an id but not the text are judged each for
itself, a null id is an id like others.  No stage drops a row for its id alone.  Empty tables give empty ones.
"""

from __future__ import annotations

from public_tokenizers import path as vocabulary
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm import decontaminate, langid, packing, secrets, signature_tree
from auditlake.llm.common import TEXT_ROWS, row_key, split_by, staged
from auditlake.sources import table

#: A document stays if the classifier names its language at least this surely.
LEAST_SCORE = 0.4


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose row_key isn't in gone (one column, gone_key); of rows whose row_key is in `once` (once_key) one stays.

    Only rows that one of the two may name are shuffled, pruned by a table of bits of fixed size; the others stay where they are.
    """
    named = gone.select(F.col("gone_key").alias("named_key"), F.lit(False).alias("_single"))
    if once is not None:
        named = named.union(once.select(F.col("once_key"), F.lit(True)))
    told, clean = split_by(docs.withColumn("_row_key", row_key("doc_id", "text")), "_row_key", named, "named_key")
    judged = told.join(named, F.col("_row_key") == F.col("named_key"), "left").where("_single OR named_key IS NULL")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy("named_key").orderBy(*(F.col(c).cast("string") for c in rest), "text") if rest else Window.partitionBy("named_key").orderBy("text")
    several = judged.where("_single").withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    return clean.select(*docs.columns).union(judged.where("named_key IS NULL").select(*docs.columns)).union(several.select(*docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that is named surely enough; those of no language (no letter, null) go; repeated rows are kept each.

    Judged in small batches, as JVM and worker hold a batch of whole texts for each task; texts don't come back from Python.
    """
    told = langid.predict(docs.select(row_key("doc_id", "text").alias("key"), "text"), langid.fit(docs), id_col="key")
    gone = told.where(f"NOT (lang_pred <> 'und' AND score >= {LEAST_SCORE})").select(F.col("doc_id").alias("gone_key")).distinct()
    return without(docs, staged(gone, "unrecognised", TEXT_ROWS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at Jaccard 0.8, one: the smallest id, then the smallest row_key.

    Ids that are null come last; of repeated rows one stays; texts without words are linked with nothing and stay.
    """
    groups = staged(signature_tree.near_duplicates(docs, words=5, percent=80).where("root IS NOT NULL").select("root", "doc_id", "row_key"), "near-groups")
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = groups.join(first.select("root", F.col("first.row_key").alias("kept_key")), "root")
    gone = several.where("row_key <> kept_key").select(F.col("row_key").alias("gone_key")).distinct()
    once = several.where("row_key = kept_key").groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("row_key").alias("once_key"))
    return without(docs, staged(gone, "near-gone"), staged(once, "near-once"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages; repeated rows stay or go together."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = judged.where("contaminated").select(F.col("row_key").alias("gone_key")).distinct()
    return without(docs, staged(gone, "contaminated"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials masked and n_chars counted again; null texts stay null."""
    masked = secrets.mask(docs, secrets.scan(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 ids; each row is packed, whatever its id."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

#: Classifiers, components and tokenizers can't be expressed in SQL; tests/llm holds run() against a brute-force version of
#: all stages but the classifier's, whose answers it takes from langid.predict().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
