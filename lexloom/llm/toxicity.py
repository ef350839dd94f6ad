"""Toxicity by compression distance.

Two zstandard dictionaries are learned from labelled text. The ordinary one is trained on windows of ordinary texts.
The toxic one continues it with what is particular to toxic texts: runs of letters made of 5- and 8-byte pieces that at
least ``LEAST`` toxic documents hold, that significantly more of them hold than of the ordinary ones (signed root of the
likelihood ratio, ``SIGNIFICANT``), and that are ``RATIO`` times as frequent by occurrences in a document. Counts are
absolute, so that words of a small group among the toxic texts (a rare language) stay. Every piece that qualifies is in
the dictionary, whose size follows from them; the most frequent runs stand last (the end is cheapest to point at).
Every window, which is one word, is compressed with both dictionaries, in front of bytes that both of them end with:
zstandard seeks no match in the last 8 bytes of its input, which would hide short words. The bytes that the toxic
dictionary saves are the distance. Counts of windows past several savings (thresholds), the largest and the mean are
weighed by a logistic model. Its calibration is by cross-fitting: each of ``FOLDS`` parts of the sample is measured with
a dictionary of the others.

Copies and near copies in the sample would make every piece of their text significant, so documents that share the
smallest or the largest hash of their ``RUN``-word runs with one before them do not count for the fit.

Fitting takes about ``FIT_TOXIC`` toxic and ``FIT_ORDINARY`` ordinary rows, chosen by hashes of the ids; what the fit
needs of a text (its words with their numbers, up to ``FIT_WINDOWS`` windows by hash) is made in the tasks. Every text
is scored whole.

Cases. Null and blank texts have one empty word and a score like any other; texts of any length are scored whole, in
memory of their distinct words. Without toxic or without ordinary rows to learn from, the score is the share of toxic
rows among the labelled (0 without labels). Repeated rows stay; an empty table gives an empty result; further columns
are carried through, whatever their names, but those named ``score`` and ``predicted``, which are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import about, fold, fresh, small_batches
from .grams import LETTERS, sigmoid

FIT_TOXIC = 1500
FIT_ORDINARY = 3000
THRESHOLD = 0.5
WINDOW = 8
PIECES = (5, 8)
LEAST = 3
SIGNIFICANT = 4.5
RATIO = 3
LEVEL = 6
ORDINARY_BYTES = 8192
PAST = (1, 2, 3, 4, 5, 6)
FOLDS = 4
RUN = 8
FIT_WINDOWS = 1024
#: What no text matches, at the end of both dictionaries and of all that is compressed with them.
PAD = np.random.default_rng(1).integers(0, 9, 16, dtype=np.uint8).tobytes()
#: Words whose savings a worker remembers.
REMEMBERED = 1 << 16


def tokens(text: str) -> list[bytes]:
    return text.lower().encode().translate(LETTERS).split()


@dataclass
class Sampled:
    """What the fit needs of a document."""

    words: Counter
    runs: frozenset[int]
    windows: list[bytes]


def sampled(text: str) -> Sampled:
    words = tokens(text)
    runs = [zlib.crc32(b" ".join(words[k : k + RUN])) for k in range(max(1, len(words) - RUN + 1))]
    cut = [b" " + b" ".join(words[k : k + WINDOW]) + b" " for k in range(0, max(len(words), 1), WINDOW)]
    return Sampled(Counter(words), frozenset((min(runs), max(runs))), cut if len(cut) <= FIT_WINDOWS else sorted(cut, key=zlib.crc32)[:FIT_WINDOWS])


class Samples(Sequence):
    """Sampled documents in the memory of the Arrow table that they came in; each is made when it is asked for, as all of
    them as Python's objects take many times as much."""

    def __init__(self, table: pa.Table, at: np.ndarray):
        self.table, self.at = table, at

    @classmethod
    def of(cls, table: pa.Table) -> Samples:
        """In order of their ids."""
        table = table.combine_chunks()
        ids, runs, sizes = table.column("doc_id").to_pylist(), table.column("runs").to_pylist(), pa.compute.list_value_length(table.column("words")).to_pylist()
        return cls(table, np.array(sorted(range(len(ids)), key=lambda k: (ids[k], runs[k], sizes[k])), dtype=np.int64))

    def __len__(self) -> int:
        return len(self.at)

    def __getitem__(self, k):
        if isinstance(k, (slice, list)):
            return Samples(self.table, self.at[k])
        words, n, runs, windows = (self.table.column(c)[int(self.at[k])].as_py() for c in ("words", "n", "runs", "windows"))
        return Sampled(Counter(dict(zip(words, n, strict=True))), frozenset(runs), windows)


def distinct(docs: Sequence[Sampled]) -> Sequence[Sampled]:
    """The first of each group of copies and near copies."""
    seen, kept = set(), []
    for k, d in enumerate(docs):
        if not d.runs & seen:
            kept.append(k)
        seen |= d.runs
    return docs[kept] if isinstance(docs, Samples) else [docs[k] for k in kept]


def trained(samples: list[bytes], size: int) -> bytes:
    """The content (its last ``size`` bytes) of a dictionary trained on samples; their end where they are too few."""
    try:
        return zstandard.train_dictionary(2 * size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def pieces(word: bytes) -> list[bytes]:
    """The pieces of a word, which begins and ends with a space."""
    b = b" " + word + b" "
    return [b[i : i + size] for size in PIECES for i in range(len(b) - size + 1)]


def excerpts(word: bytes, particular: set[bytes]) -> list[bytes]:
    """The longest runs inside a word that particular pieces cover."""
    found, b, begin, end = [], b" " + word + b" ", -1, -1
    for i in range(len(b)):
        for size in PIECES:
            if i + size <= len(b) and b[i : i + size] in particular:
                if begin >= 0 and i > end:
                    found.append(b[begin:end])
                    begin = i
                begin = i if begin < 0 else begin
                end = max(end, i + size)
    return [*found, b[begin:end]] if begin >= 0 else found


def significance(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Signed root of the likelihood ratio of a among n against b among m; 0 where a's share is not the larger one."""
    p = (a + b) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log(x / e), 0) for x, e in ((a, n * p), (n - a, n * (1 - p)), (b, m * p), (m - b, m * (1 - p)))]
    return np.where(a * m > b * n, np.sqrt(np.maximum(0, 2 * sum(parts))), 0)


class Tallies:
    """Numbers of documents that hold a piece, and of its occurrences, by class and part of the sample."""

    def __init__(self, toxic: Sequence[Sampled], ordinary: Sequence[Sampled]):
        self.docs = toxic, ordinary
        self.number: dict[bytes, int] = {}
        number = self.number
        for d in toxic:
            for word in d.words:
                for p in pieces(word):
                    number.setdefault(p, len(number))
        self.holders, self.times = np.zeros((2, 2, FOLDS, len(number)), dtype=np.int32)
        for c, docs in enumerate(self.docs):
            for k, d in enumerate(docs):
                found = [(number[p], n) for word, n in d.words.items() for p in pieces(word) if p in number]
                if found:
                    at, n = np.array(found).T
                    self.holders[c, k % FOLDS, np.unique(at)] += 1
                    np.add.at(self.times[c, k % FOLDS], at, n)
        self.size = [[len(docs[k::FOLDS]) for k in range(FOLDS)] for docs in self.docs]
        self.base = trained([w for d in ordinary for w in d.windows], ORDINARY_BYTES)

    def particular(self, without: int | None) -> set[bytes]:
        """Pieces that mark toxic documents, leaving one part of the sample out."""
        parts = [k for k in range(FOLDS) if k != without]
        (a, b), (ta, tb) = self.holders[:, parts].sum(axis=1), self.times[:, parts].sum(axis=1)
        n, m = (max(1, sum(s[k] for k in parts)) for s in self.size)
        good = (a >= LEAST) & (significance(a, n, b, m) >= SIGNIFICANT) & (ta / n >= RATIO * (tb + 1) / (m + 1))
        names = list(self.number)
        return {names[k] for k in np.flatnonzero(good)}

    def dictionaries(self, without: int | None = None) -> tuple[bytes, bytes]:
        particular = self.particular(without)
        times = Counter()
        for k, d in enumerate(self.docs[0]):
            if k % FOLDS != without:
                times.update(d.words)
        found = Counter()
        for word, n in times.items():
            for e in excerpts(word, particular):
                found[e] += n
        chosen, held = [], set()
        for e, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            inside = {e[i : i + size] for size in PIECES for i in range(len(e) - size + 1)} & particular
            if not inside <= held:
                held |= inside
                chosen.append(e)
        own = b"".join(reversed(chosen))
        # What no text matches, as long as the toxic part: so both point at the base over the same distances, and what
        # a word saves comes from the toxic part alone.
        filler = np.random.default_rng(0).integers(0, 9, len(own), dtype=np.uint8).tobytes()
        return self.base + filler + PAD, self.base + own + PAD


class Distance:
    """Measures of a text under an ordinary and a toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.raw = ordinary, toxic
        self.compress = [self.compressor(d) for d in self.raw]
        self.known: dict[bytes, int] = {}

    @staticmethod
    def compressor(raw: bytes):
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def __reduce__(self):
        return Distance, self.raw

    def saved(self, word: bytes) -> int:
        got = self.known.get(word)
        if got is None:
            plain, toxic = self.compress
            padded = b" " + word + b" " + PAD
            got = len(plain(padded)) - len(toxic(padded))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = got
        return got

    def measures(self, words: Counter) -> np.ndarray:
        """Of a document, by its words and their numbers."""
        saved = np.array([self.saved(w) for w in words or [b""]], dtype=np.float64)
        n = np.array(list(words.values()) or [1], dtype=np.float64)
        past = np.array([n[saved >= t].sum() for t in PAST])
        return np.concatenate([[saved.max(), (saved * n).sum() / n.sum(), np.log(n.sum())], np.log1p(past), past, past / n.sum()])


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights (intercept last) of a ridge logistic regression by damped Newton steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = sigmoid(x1 @ w)
        slope = x1.T @ (p - y) + penalty * w
        step = np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + penalty * np.eye(len(w)), slope)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


class ToxicityModel:
    def __init__(self, toxic: Sequence[Sampled], ordinary: Sequence[Sampled], share: float):
        """share: of toxic rows among all labelled; the sample is weighed back to it."""
        self.distance, self.share = None, share
        toxic, ordinary = distinct(toxic), distinct(ordinary)
        if not toxic or not ordinary:
            return
        tallies = Tallies(toxic, ordinary)
        self.distance = Distance(*tallies.dictionaries())
        x, y = [], []
        for k in range(FOLDS):
            d = Distance(*tallies.dictionaries(without=k))
            for label, docs in ((1.0, toxic[k::FOLDS]), (0.0, ordinary[k::FOLDS])):
                x += [d.measures(doc.words) for doc in docs]
                y += [label] * len(docs)
        x, y = np.array(x), np.array(y)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = logistic((x - self.mean) / self.spread, y)
        odds = lambda p: np.log(p / (1 - p))
        self.shift = odds(min(max(share, 1e-4), 1 - 1e-4)) - odds(y.mean())

    def score(self, text: str) -> float:
        if self.distance is None:
            return self.share
        x = (self.distance.measures(Counter(tokens(text))) - self.mean) / self.spread
        return float(sigmoid(x @ self.weights[:-1] + self.weights[-1] + self.shift))


def _sampling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sampled(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([list(d.words) for d in found], pa.list_(pa.binary())), pa.array([list(d.words.values()) for d in found], pa.list_(pa.int64())), pa.array([sorted(d.runs) for d in found], pa.list_(pa.int64())), pa.array([d.windows for d in found], pa.list_(pa.binary()))],
            names=["doc_id", "words", "n", "runs", "windows"],
        )


def fit(train: DataFrame, labels: DataFrame, n_toxic: int = FIT_TOXIC, n_ordinary: int = FIT_ORDINARY) -> ToxicityModel:
    """A model from documents (doc_id, text) and labels (doc_id, toxic) of the training folds."""
    small_batches(train.sparkSession)
    marks = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = marks.agg(F.count("*").alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = share["n"], share["bad"] or 0
    docs = train.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def sample(of: int, rows: int, seed: int, total: int) -> Samples:
        chosen = about(marks.where(F.col("toxic") == of), "doc_id", rows, seed=seed, total=total).select("doc_id")
        made = docs.join(chosen, "doc_id").mapInArrow(_sampling, "doc_id long, words array<binary>, n array<long>, runs array<long>, windows array<binary>")
        return Samples.of(made.toArrow())

    return ToxicityModel(sample(1, n_toxic, 31, bad), sample(0, n_ordinary, 32, n - bad), bad / n if n else 0.0)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with score and predicted."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (text_col, "score", "predicted")]
    text = fresh("text__", kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([shared.value.score(t) for t in batch.column(text).to_pylist()], dtype=np.float64)
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    rows = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, learning from the rows whose fold of 5 is not 0."""
    model = fit(docs.where(fold("doc_id", 5) != 0), labels.where(fold("doc_id", 5) != 0))
    return score(docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out")), model)
