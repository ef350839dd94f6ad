"""Quotes as they are shown: trimmed, with the range of the original text that they were found in, against a plain search."""

import random
import re

from lexloom.functions import text as T
from lexloom.operators import verify
from lexloom.plans import q_verify
from pyspark.sql import functions as F

WORDS = "The employee shall give notice of ninety days before leaving, and the Company may waive it… in “writing” at any time ﬁnally ¨ नोटिस co­operate İn".split()
GAPS = [" ", " ", " ", "  ", "\t", " ​ ", " "]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain(text, quote):
    """Status, score, start and end, window by window."""
    none = ("unverified", 0.0, None, None)
    if text is None or quote is None:
        return none
    needle = T.normalized_with_origin(quote.strip("".join(T.SPACES)))[0]
    norm, start, end = T.normalized_with_origin(text)
    if len(needle) < 12 or not norm:
        return none
    at = norm.find(needle)
    if at >= 0:
        return "verified", 1.0, start[at], end[at + len(needle) - 1]
    q, h, best = re.findall("[^ ]+", needle), list(re.finditer("[^ ]+", norm)), None
    for k in range(len(h)):
        for size in range(max(1, len(q) - 2), min(len(q) + 2, len(h) - k) + 1):
            score, gap = 1 - distance(q, [m[0] for m in h[k : k + size]]) / max(size, len(q)), abs(size - len(q))
            if score >= 0.9 and (best is None or (score, -gap) > best[:2]):
                best = score, -gap, start[h[k].start()], end[h[k + size - 1].end() - 1]
    return ("fuzzy", best[0], *best[2:]) if best else none


def odd_pairs():
    rng, rows = random.Random(11), []
    joined = lambda words: "".join(w + rng.choice(GAPS) for w in words)
    for _ in range(250):
        h = [rng.choice(WORDS[: rng.choice((16, len(WORDS)))]) for _ in range(rng.randrange(20, 50))]
        at = rng.randrange(len(h) - 15)
        q = h[at : at + rng.randrange(9, 25)]
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(q))
            q[k : k + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
        rows.append((rng.choice(["", " ", "\n"]) + joined(h), rng.choice(["", "  ", "\t", "​ "]) + joined(q).upper()))
    rows += [(None, "a quote of some length"), ("some text", None), ("", "a quote of some length"), ("  \t", "a quote of some length"), ("short quote", " short "), (" notice period applies", " notice period applies ")]
    rows += [("the notice period applies", " ́notice period applies"), ("a ́notice period applies", "notice period applies"), ("Notice  Period…  Applies", "﻿notice period... applies\n"), ("nine words", "ten words that are not there at all, never")]
    return list(enumerate(rows))


def test_ranges_match_a_plain_search(spark):
    rows = odd_pairs()
    pairs = spark.createDataFrame([(k, t, q) for k, (t, q) in rows], "k int, text string, quote string")
    for prune in (True, False):
        got = {r.k: (r.status, round(r.score, 9), r.start, r.end) for r in verify.verified(pairs, prune).collect()}
        for k, (text, quote) in rows:
            status, score, start, end = plain(text, quote)
            assert got[k] == (status, round(score, 9), start, end), (text, quote)
    assert min(sum(x[0] == s for x in got.values()) for s in ("verified", "fuzzy", "unverified")) > 20
    assert sum(x[0] == "fuzzy" and x[2] > 0 for x in got.values()) > 20


def test_claims_are_built_with_ranges(spark):
    sf = "/root/testdata/sf0.001"
    texts = {(r.doc_id, r.clause_id): r.text for r in q_verify.clauses(spark, sf).collect()}
    got = q_verify.vq_build(spark, sf).collect()
    for r in got:
        assert (r.start is None) == (r.end is None) == (r.status == "unverified")
        if r.status == "verified":
            assert T.normalized_with_origin(texts[r.doc_id, r.clause_id][r.start : r.end])[0] == T.normalized_with_origin(r.quote)[0]
    assert {r.status for r in got if r.start is not None} == {"verified", "fuzzy"}


def test_quotes_are_trimmed_of_all_white_space(spark):
    said = ["  liquidated damages  ", "\t liquidated\ndamages　﻿", "liquidated", " ", "", None]
    got = [r.q for r in spark.createDataFrame(list(enumerate(said)), "k int, q string").orderBy("k").select(T.trimmed(F.col("q")).alias("q")).collect()]
    assert got == ["liquidated damages", "liquidated\ndamages", "liquidated", "", "", None]


def test_statuses_alone_need_no_map(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    sf = "/root/testdata/sf0.001"
    assert "normalize_exact" in plan(q_verify.vq_build(spark, sf)) and "normalize_exact" not in plan(q_verify.vq_stats(spark, sf))
