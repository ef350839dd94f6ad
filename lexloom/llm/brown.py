"""Language-model scores from class-based bigrams, with classes by exchange clustering.

log10 P(text) = sum over tokens of log10 P(class of the word | context class before) + log10 P(word | its class). Words
are the lower-cased words of a text (A-Z only), then one end token; the context before the first word is the end
token's.

Every word of the training texts gets its class by exchange. A word whose relative frequency is ``UNIT_SHARE`` or more is
a unit of its own (1 / UNIT_SHARE words at most, the only ones that tasks hold); all others share ``SLOTS`` units by the
hash of their last three bytes, so that every word, also an unseen one, has a context class. First the units are
clustered in rounds: bigram counts of units, a distributed table over all training texts, are summed by the present
classes; in parallel slices each unit moves to the class that raises the likelihood of the class bigrams most (a hashed
half of the units per round, so that moves do not collide); rounds end when two of them raise the likelihood by less
than ``LITTLE`` of it. Then each of the other words is moved out of its slot, into the class that raises the likelihood
of its own occurrences most (and of ``ALIKE`` more in contexts like its slot's, as a word seen once has but one context),
against the class bigrams as they stand: words and the contexts before them are shuffled by word and never leave the
tasks. What a word is as a context stays with its slot, so that no word's class hangs on
another rare word's; P(class | context) and P(word | class) each sum to 1.

To score, tokens of units and of other words of a relative frequency of ``SENT_SHARE`` or more (1 / SENT_SHARE words at most,
some 100 MB in a worker) are looked up, which only spares the shuffle their tokens; all others are joined, by the word itself, to the table of words with their
classes and counts; a row's tokens find their row again by a number that its task gave it.

Smoothing: P(word | class) = (c + 0.5) / (n + 0.5 (v + 1)) with c the word's count, n the class's tokens, v its distinct
words and one place for all unseen words of the class. P(class | before) = (n(before, class) + K q) / (n(before) + K)
with q the class's own (add-half) share.

Cases. Null and blank texts are one end token; texts of any length are scored whole. With no training rows all counts
are 0, N = V = 0, and one class is left. Repeated rows are scored each by itself and count each in training; a null id
trains as the empty string's fold says. An empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, size_of, small_batches

END = b"\n"  # no word holds a separator
CLASSES = 64  # 256 at most
ROUNDS = 8
LITTLE = 1e-3
UNIT_SHARE = 2e-5
SENT_SHARE = 1e-6
SLOTS = 4096
K = 20.0
ALIKE = 30.0
FLUSH = 500_000
SLICES = 48
SHIFT = 32


def tokens(text: bytes) -> list[bytes]:
    found = text.lower().split()
    found.append(END)
    return found


def slot(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SLOTS


class Line:
    """The tokens of a batch of texts (binary) in a row, as numbers of its distinct words: cut and numbered by Arrow, so
    that only distinct words are looked up one by one."""

    def __init__(self, texts: pa.Array):
        compute = pa.compute
        lists = compute.ascii_split_whitespace(compute.ascii_lower(texts.cast(pa.large_string())))
        offsets = lists.offsets.to_numpy()
        found = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
        real = compute.greater(compute.binary_length(found), 0)  # separators at a text's edge leave empty strings
        kept = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[offsets - offsets[0]]
        numbered = found.filter(real).dictionary_encode()
        self.distinct = pa.concat_arrays([numbered.dictionary.cast(pa.large_binary()), pa.array([END], pa.large_binary())])
        self.words: list[bytes] = self.distinct.to_pylist()
        #: Where each text's tokens begin, and the number of all tokens; an end stands behind every text.
        self.begun = kept + np.arange(len(kept))
        self.at = np.insert(numbered.indices.to_numpy().astype(np.int64), kept[1:], len(self.words) - 1)

    def looked_up(self, table: dict[bytes, int]) -> np.ndarray:
        """What a table gives for each distinct word."""
        return np.fromiter((table[w] for w in self.words), np.int64, len(self.words))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        if not batch.num_rows:
            continue
        line = Line(batch.column("text"))
        for word, n in zip(line.words, np.bincount(line.at, minlength=len(line.words)).tolist(), strict=True):
            counts[word] += n
        if len(counts) > FLUSH:
            yield out()
    yield out()


class Lexicon(dict):
    """Word to its unit; any other word to its slot's."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        super().__init__((w, k) for k, w in enumerate(words))
        self.words, self.counts = words, counts

    def __missing__(self, word: bytes) -> int:
        return len(self.words) + slot(word)

    def __reduce__(self):
        return Lexicon, (self.words, self.counts)

    @property
    def units(self) -> int:
        return len(self.words) + SLOTS


def _bigrams(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        keys, sums, held = [], [], 0

        def out() -> pa.RecordBatch:
            code, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(sums)).astype(np.int64)
            keys.clear(), sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(code >> SHIFT), pa.array(code & ((1 << SHIFT) - 1)), pa.array(n)], names=["u", "v", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            line = Line(batch.column("text"))
            units = np.append(lexicon[END], line.looked_up(lexicon)[line.at])
            code, n = np.unique(units[:-1] << SHIFT | units[1:], return_counts=True)
            keys.append(code), sums.append(n)
            held += len(code)
            if held > 4 * FLUSH:
                yield out()
                held = 0
        if keys:
            yield out()

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def likelihood(m: np.ndarray) -> float:
    return float(_xlogx(m).sum() - _xlogx(m.sum(axis=1)).sum() - _xlogx(m.sum(axis=0)).sum())


def best_moves(unit: np.ndarray, now: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each unit the class that it would best be in, all others staying where they are.

    right, left: counts of the classes after and before the unit, without its bigrams with itself (own).
    """
    best = now.copy()
    c = len(m)
    each = np.arange(c)
    for k in range(0, len(unit), 64):
        a, r, x, s = now[k : k + 64], right[k : k + 64], left[k : k + 64], own[k : k + 64]
        i = np.arange(len(a))
        rest = np.repeat(m[None], len(a), axis=0)
        rest[i, a, :] -= r
        rest[i, :, a] -= x
        rest[i, a, a] -= s
        rest = np.maximum(rest, 0)
        gain = (_xlogx(rest + r[:, None, :]) - _xlogx(rest)).sum(axis=2) + (_xlogx(rest + x[:, :, None]) - _xlogx(rest)).sum(axis=1)
        diagonal = rest[:, each, each]
        gain += _xlogx(diagonal + r + x + s[:, None]) - _xlogx(diagonal + r) - _xlogx(diagonal + x) + _xlogx(diagonal)
        after, before = rest.sum(axis=2), rest.sum(axis=1)
        gain -= _xlogx(after + (r.sum(axis=1) + s)[:, None]) - _xlogx(after)
        gain -= _xlogx(before + (x.sum(axis=1) + s)[:, None]) - _xlogx(before)
        better = gain.argmax(axis=1)
        best[k : k + 64] = np.where(gain[i, better] > gain[i, a] + 1e-9, better, a)
    return best


def exchange(bigrams: DataFrame, units: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, class bigram counts) from bigram counts (u, v, n) of ``units`` units.

    A round's changes are not seen by the other moves of the round, so the likelihood may fall; the best round is kept.
    """
    spark = bigrams.sparkSession
    now = np.arange(units) % classes
    best, fits = None, []
    slices = int(min(SLICES, max(1, units // 64)))

    def moved(shared):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            assigned, m = shared.value
            unit, at = np.unique(rows["unit"].to_numpy(), return_inverse=True)
            side, other, n = rows["side"].to_numpy(), rows["class"].to_numpy(), rows["n"].to_numpy(dtype=np.float64)
            vectors = np.zeros((3, len(unit), len(m)))
            np.add.at(vectors, (side, at, other), n)
            to = best_moves(unit, assigned[unit], vectors[0], vectors[1], vectors[2, :, 0], m)
            return pd.DataFrame({"unit": unit, "to": to})

        return run

    for k in range(rounds + 1):
        # At most 1 / UNIT_SHARE + SLOTS units: their classes are a table of bounded size.
        table = F.broadcast(spark.createDataFrame(pd.DataFrame({"unit": np.arange(units), "class": now})))
        both = bigrams.join(table.toDF("v", "cv"), "v").join(table.toDF("u", "cu"), "u")
        # One scan gives all that a round needs: per unit its classes after (side 0) and before (1), and itself (2).
        side = lambda unit, other, k_: F.struct(F.col(unit).alias("unit"), other.cast("long").alias("class"), F.lit(k_).alias("side"))
        facts = F.when(F.col("u") == F.col("v"), F.array(side("u", F.lit(0), 2))).otherwise(F.array(side("u", F.col("cv"), 0), side("v", F.col("cu"), 1)))
        sides = both.select(F.explode(facts).alias("x"), "n").groupBy("x.unit", "x.class", "x.side").agg(F.sum("n").alias("n")).persist()
        m = np.zeros((classes, classes))
        of = F.when(F.col("side") == 2, F.col("cu")).otherwise(F.col("class")).alias("cv")
        for r in sides.where("side <> 1").join(table.toDF("unit", "cu"), "unit").select("cu", of, "n").groupBy("cu", "cv").agg(F.sum("n").alias("n")).collect():
            m[r["cu"], r["cv"]] = r["n"]
        fit = likelihood(m)
        if best is None or fit > best[0]:
            best = fit, now.copy(), m
        fits.append(fit)
        if k == rounds or k >= 2 and fit - fits[-3] < LITTLE * abs(fit):
            sides.unpersist()
            break
        half = F.pmod(F.xxhash64("unit", F.lit(k // 2)), F.lit(2)) == k % 2
        new = sides.where(half).withColumn("slice", F.col("unit") % slices).groupBy("slice").applyInPandas(moved(spark.sparkContext.broadcast((now, m))), "unit long, to long")
        for r in new.toArrow().to_batches():
            now[r.column("unit").to_numpy()] = r.column("to").to_numpy()
        sides.unpersist()
    return best[1], best[2]


def steps(m: np.ndarray) -> np.ndarray:
    """log10 P(class | context) from counts."""
    q = (m.sum(axis=0) + 0.5) / (m.sum() + 0.5 * m.shape[1])
    return np.log10((m + K * q[None, :]) / (m.sum(axis=1, keepdims=True) + K))


def _contexts(shared):
    """(word, context class before, n) of all words that are no units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, context = shared.value
        size = len(lexicon.words)
        for batch in batches:
            if not batch.num_rows:
                continue
            line = Line(batch.column("text"))
            units = line.looked_up(lexicon)[line.at]
            before = context[np.append(lexicon[END], units[:-1])]
            rare = units >= size
            code, n = np.unique(line.at[rare] << 8 | before[rare], return_counts=True)  # 256 classes at most
            yield pa.RecordBatch.from_arrays([line.distinct.take(pa.array(code >> 8)).cast(pa.binary()), pa.array((code & 255).astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "before", "n"])

    return run


def _assigning(shared):
    """The class of each word, from its contexts in order of words; at the end the counts of (context, class) as rows
    without a word, context * classes + class in the place of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, level, like_slot = shared.value
        classes = len(level)
        moved = np.zeros((classes, classes), dtype=np.int64)
        held: pa.Table | None = None

        def out(rows: pa.Table) -> pa.RecordBatch:
            word = rows.column("word").combine_chunks()
            before, n = rows.column("before").to_numpy(), rows.column("n").to_numpy()
            starts = np.flatnonzero(np.append(True, pa.compute.not_equal(word[1:], word[:-1]).to_numpy(zero_copy_only=False)))
            total = np.add.reduceat(n, starts)
            slots = [slot(w) for w in word.take(pa.array(starts)).to_pylist()]
            gain = np.add.reduceat(n[:, None] * fit[before], starts, axis=0) + ALIKE * like_slot[slots] - (total[:, None] + ALIKE) * level
            to = gain.argmax(axis=1)
            np.add.at(moved, (before, np.repeat(to, np.diff(np.append(starts, len(n))))), n)
            return pa.RecordBatch.from_arrays([word.take(pa.array(starts)), pa.array(to, pa.int32()), pa.array(total)], names=["word", "class", "c"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            held = None
            if rows.num_rows:
                word = rows.column("word")
                last = word[rows.num_rows - 1]
                whole = pa.compute.index(pa.compute.equal(word, last), True).as_py()  # sorted: where the last word begins
                held = rows.slice(whole)
                if whole:
                    yield out(rows.slice(0, whole))
        if held is not None and held.num_rows:
            yield out(held)
        code = np.flatnonzero(moved)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.binary()), pa.array(code, pa.int32()), pa.array(moved.ravel()[code])], names=["word", "class", "c"])

    return run


class ClassModel:
    """What a task needs to score a text but for the words that are no units."""

    def __init__(self, lexicon: Lexicon, class_of_unit: np.ndarray, m: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray, sent: pa.Table):
        self.lexicon, self.class_of_unit = lexicon, class_of_unit
        #: Words that are no units, but looked up all the same: their places behind the units'.
        self.more = {w: k for k, w in enumerate(sent.column("word").to_pylist(), len(lexicon.words))}
        #: log10 P(class | context) less the logarithm of the class's mass; with log10(c + 0.5) the token's score.
        self.step = steps(m) - np.log10(class_tokens + 0.5 * (class_words + 1))[None, :]
        self.log_count = np.log10(np.concatenate([lexicon.counts, sent.column("c").to_numpy()]) + 0.5)
        self.own_class = np.concatenate([class_of_unit[: len(lexicon.words)], sent.column("class").to_numpy()]).astype(np.int64)

    def measures(self, line: Line) -> tuple[np.ndarray, ...]:
        """For each text its tokens, those looked up, and their sums of log10(count + 0.5) and of all else; for each
        other token its text, its word (by number), the context before it, and its class if it was never seen."""
        lexicon, more = self.lexicon, self.more
        units = line.looked_up(lexicon)
        known = np.where(units < len(lexicon.words), units, -1)
        if more:
            rare = np.flatnonzero(known < 0)
            known[rare] = [more.get(line.words[k], -1) for k in rare.tolist()]
        classes = self.class_of_unit[units][line.at]
        before = np.append(self.class_of_unit[lexicon[END]], classes[:-1])
        place = known[line.at]
        own, first = place >= 0, line.begun[:-1]
        logs, rest = np.zeros(len(place)), np.zeros(len(place))
        logs[own], rest[own] = self.log_count[place[own]], self.step[before[own], self.own_class[place[own]]]
        sums = [np.add.reduceat(x, first) for x in (own.astype(np.int64), logs, rest)]
        other = np.flatnonzero(~own)
        return np.diff(line.begun), *sums, np.searchsorted(line.begun, other, "right") - 1, line.at[other], before[other], classes[other]


SCORED = "row long, word binary, before int, unseen int, id long, held_out boolean, n_tokens long, known long, logs double, rest double"


def _measuring(shared):
    """Per document one row, under a word that no text has, and one row for each token that is no unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << SHIFT
        for batch in batches:
            if not batch.num_rows:
                continue
            line, texts = Line(batch.column("text")), batch.num_rows
            n, known, logs, rest, of, words, before, unseen = shared.value.measures(line)
            rows = np.arange(number, number + texts)
            number += texts
            names = pa.concat_arrays([pa.array([END + str(k).encode() for k in rows.tolist()], pa.large_binary()), line.distinct.take(pa.array(words))]).cast(pa.binary())
            front = lambda x, t: pa.concat_arrays([pa.array(x, t) if not isinstance(x, pa.Array) else x, pa.nulls(len(of), t)])  # noqa: E731, B023
            behind = lambda x: pa.concat_arrays([pa.nulls(texts, pa.int32()), pa.array(x.astype(np.int32))])  # noqa: E731, B023
            columns = [pa.array(np.concatenate([rows, rows[of]])), names, behind(before), behind(unseen)]
            columns += [front(x, t) for x, t in ((batch.column("id"), pa.int64()), (batch.column("held_out"), pa.bool_()), (n, pa.int64()), (known, pa.int64()), (logs, pa.float64()), (rest, pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def counted(train: DataFrame, unit_share: float = UNIT_SHARE) -> tuple[int, int, Lexicon]:
    """Tokens, distinct words, and the words that are units."""
    n = train.agg(F.coalesce(F.sum(size_of(F.decode("text", "UTF-8")) + 1), F.lit(0)).alias("n")).first()["n"]
    counts = train.mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    frequent = F.when(F.col("c") >= max(1.0, n * unit_share), F.struct("word", "c"))
    found = counts.agg(F.count("*").alias("v"), F.collect_list(frequent).alias("units")).first()  # 1 / unit_share at most
    units = sorted(((bytes(w), c) for w, c in found["units"]), key=lambda x: (-x[1], x[0]))
    return n, found["v"], Lexicon([w for w, _ in units], np.array([c for _, c in units], dtype=np.int64))


def word_classes(train: DataFrame, lexicon: Lexicon, class_of_unit: np.ndarray, m: np.ndarray, bigrams: DataFrame, table: DataFrame) -> DataFrame:
    """(word, class, c) of all words that are no units, and the rows that ``_assigning`` adds."""
    spark = train.sparkSession
    rows = train.mapInArrow(_contexts(spark.sparkContext.broadcast((lexicon, class_of_unit))), "word binary, before int, n long")
    # Contexts before the words of each slot: SLOTS times classes rows at most.
    size, seen = len(lexicon.words), np.zeros((SLOTS, len(m)))
    for r in bigrams.where(F.col("v") >= size).join(table.toDF("u", "cu"), "u").groupBy("v", "cu").agg(F.sum("n").alias("n")).toLocalIterator():
        seen[r["v"] - size, r["cu"]] = r["n"]
    fit = steps(m)
    like_slot = (seen / np.maximum(seen.sum(axis=1, keepdims=True), 1)) @ fit
    # First-order gain of a small move: log P(class | contexts) less the words that the class has already.
    shared = spark.sparkContext.broadcast((fit, np.log10(m.sum(axis=0) + 1), like_slot))
    in_order = rows.repartition("word").sortWithinPartitions("word")
    return materialize(in_order.mapInArrow(_assigning(shared), "word binary, class int, c long"))


def language_model_scores(docs: DataFrame, folds: int = 5, held: int = 1, classes: int = CLASSES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    train = docs.where(fold(id_col, folds) != held).select(text)

    n, v, lexicon = counted(train)
    bigrams = materialize(train.mapInArrow(_bigrams(spark.sparkContext.broadcast(lexicon)), "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n")))
    class_of_unit, m = exchange(bigrams, lexicon.units, classes, rounds)
    table = F.broadcast(spark.createDataFrame(pd.DataFrame({"unit": np.arange(lexicon.units), "class": class_of_unit})))
    classed = word_classes(train, lexicon, class_of_unit, m, bigrams, table)

    # Counts of (context, class): of units from their bigrams, of all other words from their moves.
    size = len(lexicon.words)
    own = bigrams.where(F.col("v") < size).join(table.toDF("v", "cv"), "v").join(table.toDF("u", "cu"), "u").groupBy("cu", "cv").agg(F.sum("n").alias("n"))
    m = np.zeros((classes, classes))
    for r in own.collect():
        m[r["cu"], r["cv"]] += r["n"]
    for r in classed.where("word is null").groupBy("class").agg(F.sum("c").alias("n")).collect():
        m[divmod(r["class"], classes)] += r["n"]
    class_words = np.bincount(class_of_unit[:size], minlength=classes).astype(np.float64)
    class_tokens = np.bincount(class_of_unit[:size], weights=lexicon.counts, minlength=classes)
    others = classed.where("word is not null")
    for r in others.groupBy("class").agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect():
        class_words[r["class"]] += r["words"]
        class_tokens[r["class"]] += r["tokens"]
    few = F.col("c") < max(2.0, n * SENT_SHARE)
    model = ClassModel(lexicon, class_of_unit, m, class_tokens, class_words, others.where(~few).toArrow())
    others = others.where(few)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(id_col, folds) == held).alias("held_out"), text)
    measured = rows.mapInArrow(_measuring(spark.sparkContext.broadcast(model)), SCORED)
    # Classes squared rows.
    step = spark.createDataFrame(pd.DataFrame({"before": np.repeat(np.arange(classes), classes).astype(np.int32), "class": np.tile(np.arange(classes), classes).astype(np.int32), "step": model.step.ravel()}))
    met = measured.join(others, "word", "left").withColumn("class", F.coalesce("class", "unseen")).join(F.broadcast(step), ["before", "class"], "left")
    token = F.col("before").isNotNull()
    sums = met.groupBy("row").agg(
        *[F.max(c).alias(c) for c in ("id", "held_out", "n_tokens", "known")], F.count(F.when(token, F.col("c"))).alias("more_known"),
        F.sum(F.when(token, F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).otherwise(F.col("logs"))).alias("logs"), F.sum(F.coalesce("step", "rest")).alias("rest"),
    )
    return sums.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.col("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"), (F.col("logs") + F.col("rest")).alias("score"),
    )
