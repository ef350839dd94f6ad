"""Spelling variants of words by wildcard groups, without pairs.

Words are runs of letters, counted over all texts. Two words are near if one code point inserted, deleted or replaced
makes one the other. Each word of n code points joins n wildcard groups (position, prefix, suffix), which hold what
differs from it in that place only, and n deletion groups, named by what is left of it, where it meets the word that is
exactly that. A group keeps its size and its top two words: that gives each member its number of near words there and
the most frequent of them, so that no pair is written. A wildcard group has at most one word for each letter of the
alphabet (90), a deletion group 90 for each place, so none can be hot, whatever the texts.

A word's form is its near word of largest count (ties: smallest in code-point order) if that count is at least
``factor`` times its own; its root is the last word on the way from form to form. Counts grow by the factor at every
step, so ways are short; roots are handed down from the words without a form, level by level, where a word joins its at
most 180 n + 90 near words and nothing more.

Words have numbers in code-point order, and groups hold numbers. Groups are named by their text up to ``EXACT`` code
points, and by the position, the length and two 61-bit polynomial hashes of prefix and suffix beyond (which take the
time of the word's length for all its groups, and put unlike texts into one group once in 2^100 pairs).

Some runs are misspelt on the way, as the contract of the query asks (``noise``): if the crc32 of ``<id>:<run>`` divides
by it, the run loses one code point.

Cases. Null texts have no runs, empty ones neither. Texts and runs of any length are taken whole. Rows that repeat an id
are rows of their own and count again; a null id counts as the empty string. An empty table gives an empty result. Only
the id and text columns are read; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

RUN = "[A-Za-zÀ-ÿ]+"
NOISE, LEAST, SHORTEST, FACTOR = 199, 5, 6, 5
#: Distinct words that a task counts before it hands their counts on (some 50 MB).
KEPT_WORDS = 300_000
#: Code points up to which groups are named by their text.
EXACT = 64
#: Groups in one Arrow batch, about.
CHUNK = 50_000
PRIME = (1 << 61) - 1
BASES = (911_382_323_000_003, 972_663_749_000_017)


def runs(doc_id: int | None, text: str, noise: int) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text, each distinct run once."""
    lowered = text.encode().lower().decode()  # bytes: A-Z only
    if not noise:
        yield from Counter(re.findall(RUN, lowered)).items()
        return
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(re.findall(RUN, lowered)).items():
        h = zlib.crc32(run.encode(), begun)
        if h % noise == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        yield run, n


def _counting(noise: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in counts if len(w) >= shortest]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in runs(doc_id, text, noise):
                    counts[word] += n
                if len(counts) >= KEPT_WORDS:
                    yield out()
                    counts.clear()
        yield out()

    return run


def vocabulary(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, noise: int = NOISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(at, word, n): words of at least so many code points and occurrences, numbered in code-point order."""
    small_batches(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = texts.mapInArrow(_counting(noise, shortest), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # Ranges by the first code points only, as sampled keys go to the driver and words have no bound.
    ordered = words.repartitionByRange(F.substring("word", 1, EXACT)).sortWithinPartitions(F.substring("word", 1, EXACT), "word")
    return materialize(ordered.select(F.monotonically_increasing_id().alias("at"), "word", "n"))


def _hashes(word: str) -> tuple[list[list[int]], list[list[int]]]:
    """For each base, the hashes of all prefixes and of all suffixes of a word."""
    points = [ord(c) + 1 for c in word]
    before, after = [], []
    for base in BASES:
        h, ahead = 0, [0]
        for p in points:
            h = (h * base + p) % PRIME
            ahead.append(h)
        h, power, behind = 0, 1, [0]
        for p in reversed(points):
            h = (h + p * power) % PRIME
            power = power * base % PRIME
            behind.append(h)
        before.append(ahead)
        after.append(behind[::-1])
    return before, after


def group_names(word: str, exact: int = EXACT) -> tuple[list[str], list[str], str]:
    """The wildcard groups and the deletion groups that a word joins, and the deletion group that is its own text."""
    size = len(word)
    short, left, own = size <= exact, size - 1 <= exact, word
    wild = [f"{word[:k]}*{word[k + 1 :]}" for k in range(size)] if short else []
    less = {word[:k] + word[k + 1 :] for k in range(size)} if left else set()
    if not (short and left):
        before, after = _hashes(word)
    if not short:
        wild = [f"*{size}:{k}:" + ":".join(f"{a[k]:x}:{b[k + 1]:x}" for a, b in zip(before, after, strict=True)) for k in range(size)]
        own = f"#{size}:" + ":".join(f"{a[size]:x}" for a in before)
    if not left:
        powers = [1, 1]
        less = set()
        for k in reversed(range(size)):  # the hash of what is left: prefix, moved on by the suffix's length, and suffix
            less.add(f"#{size - 1}:" + ":".join(f"{(a[k] * p + b[k + 1]) % PRIME:x}" for a, b, p in zip(before, after, powers, strict=True)))
            powers = [p * base % PRIME for p, base in zip(powers, BASES, strict=True)]
    return wild, sorted(less), own


def _grouping(exact: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        ats: list[int] = []
        ns: list[int] = []
        owns: list[bool] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ats, pa.int64()), pa.array(ns, pa.int64()), pa.array(owns, pa.bool_())], names=["name", "at", "n", "own"])
            for x in (names, ats, ns, owns):
                x.clear()
            return made

        for batch in batches:
            for at, word, n in zip(*(batch.column(c).to_pylist() for c in ("at", "word", "n")), strict=True):
                wild, less, own = group_names(word, exact)
                names += wild + less + [own]
                ats += [at] * (len(wild) + len(less) + 1)
                ns += [n] * (len(wild) + len(less) + 1)
                owns += [False] * (len(wild) + len(less)) + [True]
                if len(names) >= CHUNK:
                    yield out()
        yield out()

    return run


def near_words(words: DataFrame, exact: int = EXACT) -> DataFrame:
    """(at, n_near, top): for each word with near words their number and (-count, number) of the first of them."""
    rows = words.select("at", "word", "n").mapInArrow(_grouping(exact), "name string, at long, n long, own boolean")
    # Members in order of count, then text; the group's own word is none of them.
    member = F.when(~F.col("own"), F.struct((-F.col("n")).alias("r"), "at"))
    groups = rows.groupBy("name").agg(F.sort_array(F.collect_list(member)).alias("m"), F.max(F.when(F.col("own"), F.struct((-F.col("n")).alias("r"), "at"))).alias("own"))
    told = lambda at, n, top: F.struct(at.alias("at"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n"), top.alias("top"))
    m, own, size = F.col("m"), F.col("own"), F.size("m")
    wild = F.transform(m, lambda x: told(x["at"], size - 1, F.when(x["at"] == m[0]["at"], F.get(m, F.lit(1))).otherwise(m[0])))
    less = F.concat(F.array(told(own["at"], size, m[0])), F.transform(m, lambda x: told(x["at"], 1, own)))
    # A name with the wildcard has no word of its own; what is left of a word is of use only where it is a word.
    star = F.contains("name", F.lit("*"))
    useful = groups.where((star & (size > 1)) | (F.col("own").isNotNull() & (size > 0)))
    rows = useful.select(F.explode(F.when(star, wild).otherwise(less)).alias("x")).select("x.*")
    return rows.groupBy("at").agg(F.sum("n").alias("n_near"), F.min("top").alias("top"))


def roots(forms: DataFrame) -> DataFrame:
    """(at, root) for (at, form): the last word on the way from form to form; ways must not be circles."""
    found = None
    level = materialize(forms.join(forms.select(F.col("at").alias("form")), "form", "left_anti").select("at", F.col("form").alias("root")))
    while level.take(1):
        found = level if found is None else found.unionByName(level)
        level = materialize(forms.join(level.select(F.col("at").alias("form"), "root"), "form").select("at", "root"))
    return level if found is None else found


def spelling_variants(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, factor: int = FACTOR, noise: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n (null without a form), root (the word itself without a form)."""
    words = vocabulary(docs, least, shortest, noise, id_col, text_col)
    near = near_words(words)
    joined = materialize(words.join(near, "at", "left").select("at", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(-F.col("top.r") >= factor * F.col("n"), x).alias(k) for k, x in (("form", F.col("top.at")), ("form_n", -F.col("top.r"))))))
    linked = joined.where("form is not null").select("at", "form")
    found = joined.join(roots(linked), "at", "left")
    text = lambda k: words.select(F.col("at").alias(k), F.col("word").alias(f"{k}_word"))
    # A word that is the form or the root of very many meets them by a join that Spark can split.
    named = found.join(text("at"), "at").join(text("form"), "form", "left").join(text("root"), "root", "left")
    return named.select(F.col("at_word").alias("word"), "n", "n_near", F.col("form_word").alias("form"), "form_n", F.coalesce("root_word", "at_word").alias("root"))
