"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that the model is learned from; labelled negatives are not used. The
class prior is estimated from these two as well: a logistic model tells positives from unlabelled rows, each half of
the sample scored by the model of the other half, and the prior is the share of unlabelled rows past a cut over the
share of positives past it, at the cut where this ratio and its sampling error are least (best bin estimation, Garg,
Wu, Smola, Balakrishnan, Lipton, 2021), among cuts that ``LEAST_PAST`` of the positives pass.

A linear model on hashed byte n-grams and the shape of the text then minimises the non-negative unbiased risk (Kiryo,
Niu, du Plessis, Sugiyama, 2017) with sigmoid loss, whose errors are weighed for the threshold at which rows are kept:
(1 - t) pi R+(positives) + t max(0, R-(unlabelled) - pi R-(positives)). Its margin is 0 where the score is t.

Fitting takes about ``FIT_POSITIVE`` positives and ``FIT_UNLABELLED`` unlabelled rows, chosen by hashes of the ids; every
text is scored whole.

Cases. Null counts as empty; an empty text has a vector of its own (zeros and shape) and a score like any other; texts
of any length become one vector, whole. With no positives or no unlabelled rows the score is the share of positives
among the labelled rows (1 without labels). Ids labelled more than once count once for each label. Repeated rows stay;
an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import about, fold, small_batches
from .grams import counts, gathered, sigmoid

FIT_POSITIVE = 3000
FIT_UNLABELLED = 5000
LEAST_PAST = 0.9
THRESHOLD = 0.7
BITS = 11
UPPER = bytes(1 if 65 <= b <= 90 else 0 for b in range(256))
DIGIT = bytes(1 if 48 <= b <= 57 else 0 for b in range(256))
SYMBOL = bytes(1 if 33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ",.'-" else 0 for b in range(256))


def shape(raw: bytes) -> list[float]:
    """Shares of capitals, digits and symbols, length of words, repetition of words and lines, length."""
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = max(len(raw), 1)
    share = lambda table: sum(raw.translate(table)) / n
    sizes = [len(w) for w in words] or [0]
    return [
        share(UPPER), share(DIGIT), share(SYMBOL), min(sum(sizes) / len(sizes), 40) / 20, len(set(words)) / max(len(words), 1),
        len(set(lines)) / max(len(lines), 1), np.log1p(len(words)) / 10, raw.count(b"\n") / n * 20, float(len(words) < 20),
        sum(w[-1:] in b".!?" for w in words) / max(len(words), 1), sum(w.isupper() for w in words) / max(len(words), 1),
    ]


def features(text: str) -> np.ndarray:
    raw = text.encode()
    x = np.sqrt(counts(raw, (1, 2, 3), BITS))
    return np.concatenate([x / max(float(np.linalg.norm(x)), 1e-9), np.array(shape(raw), np.float32)])


def adam(slope: Callable[[np.ndarray], np.ndarray], size: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros((3, size), np.float32)
    for k in range(1, steps + 1):
        g = slope(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = (w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return w


def with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1), np.float32)])


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, cut: float = 0.5, steps: int = 400, rate: float = 0.05, penalty: float = 1e-5) -> np.ndarray:
    """Weights (intercept last) that minimise the non-negative risk for decisions at probability ``cut``."""
    p, u = with_one(positive), with_one(unlabelled)

    def slope(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        # Sigmoid loss: 1 - s for class +, s for class -.
        negative = su.mean() - prior * sp.mean()
        g_pos = -prior * (p.T @ (sp * (1 - sp))) / len(p)
        g_neg = (u.T @ (su * (1 - su))) / len(u) + g_pos
        return ((1 - cut) * g_pos + cut * g_neg if negative >= 0 else -cut * g_neg) + penalty * w

    return adam(slope, p.shape[1], steps, rate)


def told_apart(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model of positive against unlabelled rows, both classes alike in weight."""
    p, u = with_one(positive), with_one(unlabelled)
    return adam(lambda w: -(p.T @ (1 - sigmoid(p @ w))) / len(p) + (u.T @ sigmoid(u @ w)) / len(u) + penalty * w, p.shape[1], steps, 0.05)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = LEAST_PAST, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled rows, from positive and unlabelled rows alone."""
    if min(len(positive), len(unlabelled)) < 2:
        return 1.0
    mp, mu = [], []
    for a, b in ((0, 1), (1, 0)):
        w = told_apart(positive[a::2], unlabelled[a::2])
        spread = float(np.std(unlabelled[a::2] @ w[:-1])) or 1.0
        mp.append((positive[b::2] @ w[:-1] + w[-1]) / spread)
        mu.append((unlabelled[b::2] @ w[:-1] + w[-1]) / spread)
    mp, mu = np.sort(np.concatenate(mp)), np.sort(np.concatenate(mu))
    cuts = mp[: max(1, int((1 - least) * len(mp)))]
    past_p = 1 - np.searchsorted(mp, cuts) / len(mp)
    past_u = 1 - np.searchsorted(mu, cuts) / len(mu)
    error = np.sqrt(np.log(4 / delta) / (2 * len(mu))) + (1 + gamma) * np.sqrt(np.log(4 / delta) / (2 * len(mp)))
    k = int(np.argmin((past_u + error) / past_p))
    return float(min(1.0, past_u[k] / past_p[k]))


class QualityModel:
    def __init__(self, weights: np.ndarray | None, shift: float, prior: float):
        """shift: of the log odds where the margin is 0."""
        self.weights, self.shift, self.prior = weights, shift, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        m = np.zeros(len(x)) if self.weights is None else x @ self.weights[:-1] + self.weights[-1]
        return sigmoid(m + self.shift)


def log_odds(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit(train: DataFrame, labels: DataFrame, n_positive: int = FIT_POSITIVE, n_unlabelled: int = FIT_UNLABELLED, threshold: float = THRESHOLD) -> QualityModel:
    """A model from documents (doc_id, text) and labels (doc_id, quality) of the training folds."""
    small_batches(train.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    docs = train.where("doc_id is not null").select("doc_id", text)
    marks = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = marks.agg(F.count("*").alias("n"), F.sum("quality").alias("good")).first()
    # The ids chosen are few; the documents are read for them by a semi-join and never shuffled where Spark sees that.
    positive = about(marks.where("quality = 1"), "doc_id", n_positive, seed=21, total=share["good"] or 0)
    xp, _ = gathered(docs.join(positive, "doc_id"), features, "quality")
    xu, _ = gathered(about(docs, "doc_id", n_unlabelled, seed=23).withColumn("quality", F.lit(0)), features, "quality")
    if not len(xp) or not len(xu):
        known = (share["good"] or 0) / share["n"] if share["n"] else 1.0
        return QualityModel(None, log_odds(known), known)
    # gathered() sorts rows by their vectors; halves of the sample take every other one of a fixed shuffle.
    shuffle = np.random.default_rng(24)
    prior = min(max(class_prior(shuffle.permutation(xp), shuffle.permutation(xu)), 0.01), 0.99)
    return QualityModel(nnpu(xp, xu, prior, threshold), log_odds(threshold), prior)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with score and predicted under the given names, which replace columns of these names."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            s = shared.value.score(np.array([features(t or "") for t in texts])) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, *names])

    rows = docs.drop(*[c for c in names if c in docs.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{names[0]}` double, `{names[1]}` int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learning from the rows whose fold of 4 is not 2."""
    model = fit(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2))
    return score(docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out")), model).drop("text")
