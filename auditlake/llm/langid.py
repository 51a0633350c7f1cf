"""Language ID by hierarchical discrimination: the family first, then pairs of languages within it.

Texts become frequencies of hashed character n-grams (words bounded by spaces, over the whole text).
Linear support vector machines are trained by averaged stochastic subgradient steps on a bounded sample: one against the
rest for families, one against one for the languages of a family.  Prediction is a map over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, may_be_in, row_key, staged, text_buffer

# Families of languages by ISO 639-1 code. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn pa gu mr ne",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: Features: hash buckets of byte n-grams.
DIMS = 1 << 13
#: Texts of each language that the classifiers are fitted on, at most; texts in all, beyond which languages get fewer each, but LEAST.
SAMPLE_PER_LANGUAGE = 400
SAMPLE, LEAST = 20_000, 20
BLOCK = 1 << 17


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    family_weights: np.ndarray  # families x (DIMS + 1)
    pairs: dict[int, list[tuple[int, int, np.ndarray]]]  # by family: languages a, b and weights > 0 for a

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and score of each row of features."""
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        margin = x @ self.family_weights.T
        family = margin.argmax(1)
        p = 1 / (1 + np.exp(-4 * margin))
        score = p[np.arange(len(x)), family] / np.maximum(p.sum(1), 1e-9) if len(self.families) > 1 else np.ones(len(x))
        of = [FAMILY_OF.get(code, code) for code in self.languages]
        lang = np.array([of.index(f) for f in self.families])[family] if self.families else family
        for f, pairs in self.pairs.items():
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(self.languages)))
            for a, b, w in pairs:
                q = 1 / (1 + np.exp(-4 * (x[rows] @ w)))
                votes[:, a] += q
                votes[:, b] += 1 - q
            lang[rows] = votes.argmax(1)
            members = sum(x == self.families[f] for x in of)
            score[rows] *= votes.max(1) / max(members - 1, 1)
        return lang, np.clip(score, 0, 1)


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of the frequencies of hashed 1- to 4-grams of lower-cased bytes, a row for each text."""
    n = len(at) - 1
    out = np.zeros((n, DIMS), np.float32)
    low = raw | np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    low = np.where((low < 97) | ((low > 122) & (low < 128)), np.uint8(32), low)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        row = np.zeros(DIMS, np.int64)
        for c in range(a, b, BLOCK):
            x = np.concatenate([low[max(a, c - 3) : min(b, c + BLOCK)], [32] if c + BLOCK >= b else []]).astype(np.uint32)
            if c == a:
                x = np.concatenate([[32], x]).astype(np.uint32)
            skip = c - max(a, c - 3)
            code = x
            for k in range(1, 4):
                code = (code[:-1] << np.uint32(8)) | x[k:] if k < 4 else code
                row += np.bincount((code[max(skip - k, 0) :] * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(32 - 13), minlength=DIMS)
        if total := row.sum():
            out[i] = np.sqrt(row / total)
    return out


def has_letter(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text has a letter: an ASCII one, or else one of Unicode's."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~found & (np.diff(at) > 0)):
        found[i] = any(map(str.isalpha, raw[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")))
    return found


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, row_key, text) to (lang, row_key, at, x): the features that aren't 0, as 16-bit places and values."""
    for whole in batches:
        for batch in (whole.slice(i, 64) for i in range(0, len(whole), 64)):
            x = features(*text_buffer(batch.column(2)))
            at = [np.flatnonzero(r) for r in x]
            values = [r[k].astype(np.float16).tobytes() for r, k in zip(x, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k.astype(np.uint16).tobytes() for k in at], pa.binary()), pa.array(values, pa.binary())], names=["lang", "row_key", "at", "x"])


class Sample:
    """Sparse rows of features with a constant 1; some of them at once as a dense matrix."""

    def __init__(self, at: list[np.ndarray], x: list[np.ndarray]):
        self.at, self.x = at, x

    def __len__(self) -> int:
        return len(self.at)

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), DIMS + 1), np.float32)
        out[:, DIMS] = 1
        for i, r in enumerate(rows):
            out[i, self.at[r]] = self.x[r]
        return out

    def of(self, rows: np.ndarray) -> Sample:
        return Sample([self.at[r] for r in rows], [self.x[r] for r in rows])


def _svm(x: Sample, y: np.ndarray, steps: int = 12, penalty: float = 2e-4) -> np.ndarray:
    """Linear support vector machines by averaged subgradient steps over minibatches, one for each row of y; y is 1 or -1."""
    positive = (y > 0).sum(1, keepdims=True)
    weight = y.shape[1] / (2 * np.maximum(np.where(y > 0, positive, y.shape[1] - positive), 1))
    w, mean, t = np.zeros((len(y), DIMS + 1)), np.zeros((len(y), DIMS + 1)), 0
    rng = np.random.default_rng(7)
    for _ in range(steps):
        for some in np.array_split(rng.permutation(len(x)), max(len(x) // 32, 1)):
            t += 1
            rate = 4 / (1 + 4 * penalty * t)
            rows = x.dense(some)
            wrong = y[:, some] * (w @ rows.T) < 1
            w *= 1 - rate * penalty
            w += rate / len(some) * ((wrong * y[:, some] * weight[:, some]) @ rows)
            mean += (w - mean) / t
    return mean.astype(np.float32)


def sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, row_key, text) of the rows with the smallest hashes of id and text, per_language of each label at most.

    Rows that share an id go in or out each for itself, repeated rows count once.  With more labels than SAMPLE / per_language
    there are fewer of each, down to LEAST.  Only labels and keys are shuffled for the choice, and of each label no more
    of them than that by each task; then the texts chosen.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    keys = rows.select("lang", "row_key").distinct()
    first = Window.partitionBy("lang").orderBy("row_key")
    keys = staged(keys.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= per_language), "language-sample")
    each = max(SAMPLE // max(keys.where("rank = 1").count(), 1), LEAST)
    chosen = keys.where(F.col("rank") <= each).select(F.col("lang").alias("chosen_lang"), F.col("row_key").alias("chosen_key"))
    held = may_be_in(rows, "row_key", chosen, "chosen_key").dropDuplicates(["lang", "row_key"])
    return held.join(chosen, (F.col("row_key") == F.col("chosen_key")) & (F.col("lang") == F.col("chosen_lang")), "left_semi")


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample() of the rows that have a label and a text; every label is learned.

    The driver holds the sample as sparse features, some 2 to 16 KB a text of which there are SAMPLE, or LEAST for each label if
    those are more, and the weights, 128 KB a family while they are fitted.
    """
    some = sample(labelled, per_language, id_col, text_col, lang_col).select("lang", "row_key", "text")
    found = sorted(some.mapInArrow(lean(_sample_features), "lang string, row_key long, at binary, x binary").collect(), key=lambda r: (r.lang, r.row_key))
    if not found:
        return Model([], [], np.zeros((0, DIMS + 1), np.float32), {})
    x = Sample([np.frombuffer(r["at"], np.uint16) for r in found], [np.frombuffer(r.x, np.float16) for r in found])
    languages = sorted({r.lang for r in found})
    number = {lang: i for i, lang in enumerate(languages)}
    y = np.array([number[r.lang] for r in found])
    of = [FAMILY_OF.get(code, code) for code in languages]
    families = sorted(set(of))
    family = np.array([families.index(f) for f in of])[y]
    weights = _svm(x, np.where(family == np.arange(len(families))[:, None], 1, -1)) if len(families) > 1 else np.ones((1, DIMS + 1), np.float32)
    pairs: dict[int, list] = {}
    for f, name in enumerate(families):
        own = [i for i, k in enumerate(of) if k == name]
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                both = np.flatnonzero((y == a) | (y == b))
                pairs.setdefault(f, []).append((a, b, _svm(x.of(both), np.where(y[both] == a, 1, -1)[None])[0]))
    return Model(languages, families, weights, pairs)


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, len(whole), 64)):
                raw, at = text_buffer(batch.column(1))
                known = has_letter(raw, at) & (len(model.languages) > 0)
                lang, score = np.full(len(batch), "und", object), np.zeros(len(batch))
                if known.any():
                    number, p = model.predict(features(raw, at)[known])
                    lang[known], score[known] = np.array(model.languages, object)[number], p
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row; `und` with score 0 where the text is null or has no letter, or nothing was learned.

    Whole texts are read; equal texts get equal answers; ids may be null or repeated; further columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(_predict(model)), "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is named with a score of at least `least`; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 64) for i in range(0, len(whole), 64)):
                text = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at)], names=["doc_id", "text"])
                for judged in _predict(model)([text]):
                    yield batch.filter(pc.and_(pc.not_equal(judged["lang_pred"], "und"), pc.greater_equal(judged["score"], least)))

    return docs.mapInArrow(lean(run), docs.schema)
