"""Origins of normalised characters: whole maps, made at once for a batch, against the plain version."""

import random

import pyarrow as pa
from lexloom.functions import text as T
from lexloom.plans import q_verify
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PIECES = [*"aB  \t\nÉΣ…“–​ ﻿́İऩ　\x1c\x85¨", "ﬁ", "\U0001d400", "abc", "The end. "]


def texts():
    rng = random.Random(5)
    some = ["".join(rng.choice(PIECES[: rng.choice((5, 14, len(PIECES)))]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    return [*some, None, "", " ", "plain text", "plain text ", " in front", "trailing \t", *(f"A{chr(c)}b" for c in range(0x3100)), *(f"A{chr(c)}́" for c in range(0x3100))]


def test_every_clause_has_its_whole_map(spark):
    said = {(r.doc_id, r.clause_id): r.text for r in q_verify.clauses(spark, SF).collect()}
    got = q_verify.txt_normalize_map(spark, SF).collect()
    assert len(got) == len(said) and any(r.start != list(range(len(r.start))) for r in got)
    for r in got:
        assert (r.norm, r.start, r.end) == T.normalized_with_origin(said[r.doc_id, r.clause_id])
        assert len(r.start) == len(r.end) == len(r.norm)


def test_maps_of_odd_texts(spark):
    rows = list(enumerate(texts()))
    for r in spark.createDataFrame(rows, "k int, text string").select("k", T.normalize_last(F.col("text")).alias("m")).select("k", "m.*").collect():
        want = T.normalized_with_origin(rows[r.k][1]) or (None, None, None)
        assert (r.text, r.start, r.end) == want and r.last == (want[2][-1] if want[2] else None), rows[r.k][1]


def test_a_batch_is_mapped_as_its_texts():
    every = texts()
    for batch in (every, [], [None], [""], ["ﬁ"], [None, "a  b", "é"]):
        got = T.normalize_exact.func(pa.array(batch, pa.string())).to_pylist()
        assert [g and (g["text"], g["start"], g["end"]) for g in got] == [T.normalized_with_origin(t) for t in batch]
