"""Verifying quotes against clause text: exact containment, then near-identical runs of words.

Only quotes that miss exactly, and that the multiset bound does not rule out, are searched. Words of a pair are numbered
and written as single characters, so that the engine's own character edit distance is the edit distance of words; the
windows of one clause are tried inside its row, so that verification is one projection behind the join of claims and
clauses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.rows import once
from ..functions.text import moved, normalize, origin_range, tokens

THRESHOLD = 0.9
SLACK = 2
#: One character for each of a pair's distinct words; two texts of 2,000 words have 4,000 at most.
ALPHABET = "".join(chr(0x4E00 + k) for k in range(2 * LIMITS.fuzzy_tokens + 64))


def edit_budget(size: Column) -> Column:
    """Most edits that a window of ``size`` words, or its quote if longer, may need and still reach the threshold."""
    return F.ceil(size * F.lit(1 - THRESHOLD))


def with_claims(claims: DataFrame, clauses: DataFrame) -> DataFrame:
    """Claims with their clause's text; a claim whose clause does not exist keeps null text."""
    return claims.join(clauses.select("doc_id", "clause_id", "text"), ["doc_id", "clause_id"], "left")


def place(norm: Column, needle: Column) -> Column:
    """Where the quote stands in the text (normalised, from 1), 0 if nowhere; null for quotes too short and for no text."""
    return F.when((F.length(needle) >= LIMITS.quote_min) & (F.length(norm) > 0), F.instr(norm, needle))


def _prepared(pairs: DataFrame) -> DataFrame:
    pairs = once(pairs, norm=normalize(F.col("text")), needle=normalize(F.col("quote"), trim=True))
    return pairs.withColumn("at", place(F.col("norm"), F.col("needle")))


def verify_exact(pairs: DataFrame) -> DataFrame:
    """Adds status (verified or unverified), start and end (normalised, from 0) to rows with text and quote."""
    found = F.coalesce(F.col("at") > 0, F.lit(False))
    return _prepared(pairs).select(*pairs.columns, F.when(found, "verified").otherwise("unverified").alias("status"), F.when(found, F.col("at") - 1).alias("start"), F.when(found, F.col("at") - 1 + F.length("needle")).alias("end"))


def shared_words(needle: Column, hay: Column) -> Column:
    """Words in common, counted with multiplicity."""
    distinct = F.array_distinct(needle)
    count = lambda array, w: F.size(F.filter(array, lambda x: x == w))
    return F.aggregate(F.transform(distinct, lambda w: F.least(count(needle, w), count(hay, w))), F.lit(0), lambda a, x: a + x)


def fuzzy_candidates(misses: DataFrame, prune: bool = True) -> DataFrame:
    """Rows with word arrays ``q_words`` and ``h_words``, null where no window may reach the threshold; pruning never changes answers."""
    seek = (F.length("needle") >= LIMITS.quote_min) & F.col("norm").isNotNull() & ~F.coalesce(F.col("at") > 0, F.lit(False))
    rows = once(misses, q_words=F.when(seek, tokens(F.col("needle"))), h_words=F.when(seek, tokens(F.col("norm"))))
    may = F.size("h_words").between(1, LIMITS.fuzzy_tokens) & (F.size("q_words") > 0)
    if prune:
        # Words that the text lacks altogether are counted first: that is one pass, and rules out most pairs.
        may = may & (F.size(F.array_except("q_words", "h_words")) <= edit_budget(F.size("q_words") + SLACK))
        may = may & (F.size("q_words") - shared_words(F.col("q_words"), F.col("h_words")) <= edit_budget(F.size("q_words") + SLACK))
    rows = once(rows, may_match=F.col("q_words").isNotNull() & may)
    return rows.withColumn("q_words", F.when(F.col("may_match"), F.col("q_words"))).withColumn("h_words", F.when(F.col("may_match"), F.col("h_words"))).drop("may_match")


def best_window(rows: DataFrame) -> DataFrame:
    """Rows of ``fuzzy_candidates`` with ``best``: struct<score, start, end> of the best window that reaches the
    threshold (start and end are words), null without one. A projection: a clause's windows stay in its row."""
    words = F.array_distinct(F.concat("q_words", "h_words"))
    code = lambda array: F.array_join(F.transform(array, lambda t: F.substring(F.lit(ALPHABET), F.array_position("all_words", t).cast("int"), F.lit(1))), "")
    made = once(rows.withColumn("all_words", words), q_code=code(F.col("q_words")), h_code=code(F.col("h_words")), q_size=F.size("q_words"), h_size=F.size("h_words"))
    n, hn = F.col("q_size"), F.col("h_size")

    def window(start: Column, size: Column) -> Column:
        longest = F.greatest(size, n)
        # With the edit budget as its bound the engine walks a band of the table only, and gives -1 beyond it.
        distance = F.call_function("levenshtein", F.col("q_code"), F.substring(F.col("h_code"), start + 1, size), edit_budget(longest).cast("int"))
        # Beyond the bound that is more than 1; asking for the sign would work out the distance twice.
        score = F.lit(1.0) - distance / longest
        # Ties: higher score, length nearest the quote's, earliest start, smaller size.
        return F.struct(score.alias("score"), (-F.abs(size - n)).alias("gap"), (-start).alias("s"), (-size).alias("z"))

    def windows(start: Column) -> Column:
        sizes = F.sequence(F.greatest(F.lit(1), n - SLACK), F.least(n + SLACK, hn - start))
        return F.transform(F.when(F.least(n + SLACK, hn - start) >= F.greatest(F.lit(1), n - SLACK), sizes).otherwise(F.array().cast("array<int>")), lambda z: window(start, z))

    every = F.flatten(F.transform(F.sequence(F.lit(0), hn - 1), windows))
    made = once(made, top_window=F.when(F.col("q_code").isNotNull(), F.array_max(F.filter(every, lambda w: w["score"].between(THRESHOLD, 1.0)))))
    top = F.col("top_window")
    best = F.when(top.isNotNull(), F.struct(top["score"].alias("score"), (-top["s"]).alias("start"), (-top["s"] - top["z"]).alias("end")))
    return made.withColumn("best", best).select(*[c for c in rows.columns if c not in ("q_words", "h_words")], "best")


def best_windows(rows: DataFrame, key: list[str], prune: bool = True) -> DataFrame:
    """(key, start, end, score): the best window of each prepared row that misses exactly and reaches the threshold."""
    return best_window(fuzzy_candidates(rows, prune)).where("best is not null").select(*key, "best.start", "best.end", "best.score")


def _judged(candidates: DataFrame) -> DataFrame:
    """Adds status, score and best window to rows of ``fuzzy_candidates``."""
    made = best_window(candidates)
    status = F.when(F.col("at") > 0, "verified").when(F.col("best").isNotNull(), "fuzzy").otherwise("unverified")
    score = F.when(F.col("at") > 0, 1.0).otherwise(F.coalesce("best.score", F.lit(0.0)))
    return made.select("*", status.alias("status"), score.alias("score"))


def judged(rows: DataFrame, prune: bool = True) -> DataFrame:
    """Adds status and score to rows with ``norm`` and ``needle`` (normalised text and quote) and ``at`` (of ``_prepared``)."""
    return _judged(fuzzy_candidates(rows, prune)).select(*rows.columns, "status", "score")


def word_range(norm: Column, start: Column, end: Column) -> Column:
    """struct<first, after>: the characters of a run of words (from 0, half open). Composition may leave blanks in front of
    words or several between them, so that words are counted among the parts that blanks set apart."""
    parts = F.split(norm, " ")
    words = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.get(parts, k) != "")
    before = lambda text, blanks: F.length(F.call_function("substring_index", text, F.lit(" "), blanks + 1))
    return F.struct(before(F.concat(F.lit(" "), norm), F.get(words, start)).alias("first"), before(norm, F.get(words, end - 1)).alias("after"))


def verified(pairs: DataFrame, prune: bool = True) -> DataFrame:
    """Rows with text and quote, their status (verified, fuzzy or unverified) and score, and the range of the original text
    that was matched (start and end, from 0; null for unverified quotes)."""
    rows = _prepared(pairs).withColumn("moved_text", moved(F.col("text"))).withColumn("needle_size", F.length("needle"))
    # The windows' rows hold only what ranges are made from: normalised texts of candidates, and texts that need their map.
    made = _judged(fuzzy_candidates(rows, prune).withColumn("norm", F.when(F.col("q_words").isNotNull(), F.col("norm"))))
    exact = F.struct((F.col("at") - 1).alias("first"), (F.col("at") - 1 + F.col("needle_size")).alias("after"))
    made = made.withColumn("norm_range", F.when(F.col("at") > 0, exact).when(F.col("best").isNotNull(), word_range(F.col("norm"), F.col("best.start"), F.col("best.end"))))
    made = made.withColumn("text_range", origin_range(F.col("moved_text"), F.col("norm_range.first"), F.col("norm_range.after")))
    return made.select(*pairs.columns, "status", "score", "text_range.start", "text_range.end")


def verify(pairs: DataFrame, key: list[str], prune: bool = True) -> DataFrame:
    """(key, status, score) of rows with text and quote."""
    return verified(pairs, prune).select(*key, "status", "score")


def presentable(status: Column) -> Column:
    return status.isin("verified", "fuzzy")


def stats(verified: DataFrame, by: list[str]) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return verified.groupBy(*by).agg(count("verified"), count("fuzzy"), count("unverified"))
