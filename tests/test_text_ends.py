"""Normalised texts with their last place, and word sets, against plain loops."""

import re
import unicodedata

from lexloom.functions import text as T
from pyspark.sql import functions as F

ODD = [
    "", " ", "​", "a", "Abc  \t", "abc​ ﻿", "  x … ", "“Quoted” — it’s ", "café ", "é", "ﬁn Ａ　", "नोटिस ",
    "tab\x1c ", "a​́ b", "line\none\r\n", "été ", "x" * 500 + " " * 500, "\U0001d400 bold", None, "a-b c_d 12,5 don't The (the) no. ééé",
]


def test_last_places_are_those_of_the_map(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "k int, text string").select("k", T.normalize_last(F.col("text")).alias("m")).select("k", "m.text", "m.last").collect()
    for r in rows:
        text, _, end = T.normalized_with_origin(ODD[r["k"]]) or (None, None, None)
        assert (r["text"], r["last"]) == (text, end[-1] if end else None), ODD[r["k"]]


def test_plain_texts_need_no_map(spark):
    """Only rare texts go to the exact version; the function sees null for all others."""
    df = spark.createDataFrame([(t,) for t in ODD], "text string")
    plain = [r["text"] for r in df.where(~F.coalesce(T.is_rare(F.col("text")), F.lit(False))).collect()]
    assert {"Abc  \t", "“Quoted” — it’s ", "été "} <= set(plain) and "café " not in plain


def test_word_sets_cleaned_as_one_text(spark):
    texts = [t for t in ODD if t is not None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", T.token_set(F.col("text")).alias("w")).collect()
    for r in rows:
        words = ["".join(c for c in t if unicodedata.category(c)[0] in "LN") for t in re.split(" ", texts[r["k"]])]
        assert r["w"] == list(dict.fromkeys(w for w in words if len(w) > 2 and w not in T.STOP_WORDS)), texts[r["k"]]
