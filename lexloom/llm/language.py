"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside the family.

Texts become vectors of hashed byte n-grams of their letters without case. For the family, one linear SVM per family
against the rest decides; inside it, every pair of languages has an SVM of its own and the languages' votes decide
(ties by the sum of margins, then by name). Each margin is calibrated to a probability on the training rows; the
score is the family's times the smallest of the winner's pair probabilities.

Fitting takes about ``FIT_ROWS`` labelled rows (chosen by a hash of id and text), but about ``FIT_LEAST`` of every language
at least, or all that it has, so that rare languages are learned at any size; every text is scored whole.

Cases. A text that is null or has no letter is ``und`` with score 0. With one language in the training rows every
other text gets it, with score 1; with no training rows all are ``und``. Repeated rows and ids stay; an empty table
gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, small_batches
from .grams import gathered, letters, platt, sigmoid

FIT_ROWS = 4000
FIT_LEAST = 200
UNKNOWN = "und"
#: Families of common languages by ISO 639-1 code. Other languages are families of their own.
FAMILIES = {
    "germanic": "af da de en is lb nl no sv".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "indo-iranian": "bn fa gu hi mr ne pa ur".split(),
    "turkic": "az kk ky tr uz".split(),
    "dravidian": "kn ml ta te".split(),
    "semitic": "ar he mt".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def linear_svm(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, steps: int = 250) -> np.ndarray:
    """Weights (the last is the intercept) of a linear SVM with squared hinge loss, classes weighed alike."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x1.shape[1], np.float32)
    rate = 1 / (2 * float((share * (x1 * x1).sum(axis=1)).sum()) + penalty)
    for k in range(steps):  # Nesterov's accelerated gradient
        gap = np.maximum(0, 1 - y * (x1 @ v))
        slope = -2 * (x1.T @ (share * gap * y)) + penalty * v
        new = v - rate * slope
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


class LanguageModel:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs.tolist()))
        family = {c: FAMILY_OF.get(c, c) for c in self.langs}
        self.families = sorted(set(family.values()))
        self.members = [[c for c in self.langs if family[c] == f] for f in self.families]
        own = np.array([family[c] for c in langs.tolist()])
        self.family_w = [self.fitted(x, own == f) for f in self.families] if len(self.families) > 1 else []
        self.pair_w = {}
        for group in self.members:
            for a, b in combinations(group, 2):
                rows = (langs == a) | (langs == b)
                self.pair_w[a, b] = self.fitted(x[rows], langs[rows] == a)

    @staticmethod
    def fitted(x: np.ndarray, yes: np.ndarray) -> tuple[np.ndarray, float, float]:
        w = linear_svm(x, np.where(yes, 1, -1).astype(np.float32))
        return w, *platt(margin(x, w), yes.astype(np.float64))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if len(self.families) > 1:
            odds = np.stack([sigmoid(a * margin(x, w) + b) for w, a, b in self.family_w], axis=1)
            family = odds.argmax(axis=1)
            score = odds.max(axis=1) / odds.sum(axis=1)
        else:
            family, score = np.zeros(len(x), dtype=int), np.ones(len(x))
        langs = np.empty(len(x), dtype=object)
        for f, group in enumerate(self.members):
            at = np.flatnonzero(family == f)
            votes, sums, least = np.zeros((len(at), len(group))), np.zeros((len(at), len(group))), np.ones((len(at), len(group)))
            for a, b in combinations(range(len(group)), 2):
                w, slope, shift = self.pair_w[group[a], group[b]]
                m = margin(x[at], w)
                p = sigmoid(slope * m + shift)
                for k, wins, way, q in ((a, p >= 0.5, m, p), (b, p < 0.5, -m, 1 - p)):
                    votes[:, k] += wins
                    sums[:, k] += way
                    least[:, k] = np.minimum(least[:, k], q)
            best = (votes + 0.5 * sigmoid(sums)).argmax(axis=1) if len(at) else np.empty(0, dtype=int)
            langs[at] = np.array(group, dtype=object)[best]
            score[at] *= least[np.arange(len(at)), best]
        return langs.tolist(), np.clip(score, 0, 1)


def sample(known: DataFrame, rows: int, least: int = FIT_LEAST) -> DataFrame:
    """About ``rows`` rows of (id, text, lang) by seeded hashes, and about ``least`` (or all) of every language."""
    found = known.groupBy("lang").agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n")).first()[0] or 0
    if total <= rows:
        return known
    grain = 1 << 30
    rates = found.select("lang", F.greatest(F.lit(rows / total), F.lit(least) / F.col("n")).alias("rate"))
    # One row per language: as many as the model has.
    return known.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64(F.lit(11), "id", "text"), F.lit(grain)) < F.col("rate") * grain)


def fit(train: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel | None:
    """A model from labelled rows; None if there are none."""
    small_batches(train.sparkSession)
    known = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    known = known.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    chosen = sample(known, rows).select("text", "lang")
    x, langs = gathered(chosen, letters, "lang")
    return LanguageModel(x, langs) if len(x) else None


def predict(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns named by ``keep``, lang_pred, score."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # a few weights per pair of languages, whatever the size of the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            langs, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = np.flatnonzero(batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool))
            if m is not None and len(at):
                found, score[at] = m.predict(np.array([letters(texts[k]) for k in at]))
                for k, lang in zip(at, found, strict=True):
                    langs[k] = lang
            names = [n for n in batch.schema.names if n not in ("text", "lettered")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(langs, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return rows.mapInArrow(run, f"{kept}, lang_pred string, score double")


def languages(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learning from the documents whose fold of 4 is not 2."""
    model = fit(docs.where(fold("doc_id", 4) != 2), rows)
    return predict(docs.withColumn("held_out", fold("doc_id", 4) == 2), model, keep=("held_out",))
