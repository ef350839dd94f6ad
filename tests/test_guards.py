"""Cheap tests in front of expressions: they are true wherever the expression matches, and results do not change."""

import random
import re

import pytest
from lexloom.functions import extract, text
from lexloom.functions.patterns import may_match, matches, needed
from lexloom.operators import catalog, responder
from pyspark.sql import functions as F

PATTERNS = [p for r in catalog.RULES for p in (*r.has, *r.lacks)] + [g.pattern for g in catalog.GAPS] + list(catalog.SALARY_PARTS) + [p for *_, p in responder.CLASSES] + [p for t in responder.TOPICS for p in t[:2]]


def test_literals_of_a_pattern():
    assert needed("probation|confirm(ed)?") == ("probation", "confirm")
    assert needed(r"not be (kept|held)") == ("not be ",)
    assert needed(r"a?|bc") == () and needed(r"(x)*y?") == () and needed(r"\p{L}+") == ()
    assert needed(r"(foo|ba+r)\d") == ("foo", "a") or set(needed(r"(foo|ba+r)\d")) <= {"foo", "b", "a", "r"}
    assert sum(not needed(p) for p in PATTERNS) == 0


def test_a_guard_holds_for_all_that_matches(spark):
    pool = ["Notice period", "NOTICE of  resignation", "non-competing", "non compete", "ctc", "CTC.", "basic pay", "salary", "hra", "original marksheet", "İnvention", "work product", "Keep", "keep", "with immediate effect", "without notice", "liquidated damages", "", "paid leave", "2 weeks of leave", "no more than", "extended once", " ", "based at", "joins as a clerk"]
    rng = random.Random(3)
    rows = [(" ".join(rng.sample(pool, rng.randint(0, 4))),) for _ in range(400)] + [(None,)]
    df = spark.createDataFrame(rows, "text string")
    for ignore in (False, True):
        plain = [F.col("text").rlike(("(?i)" if ignore else "") + p.replace(r"\b", r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")) for p in PATTERNS]
        both = df.select(F.array(*plain).alias("a"), F.array(*[matches(F.col("text"), p, ignore) for p in PATTERNS]).alias("b"))
        assert both.where("not (a <=> b)").count() == 0
        assert any(any(x for x in r.a if x) for r in both.collect())
    plan = df.where(may_match(F.col("text"), "probation|confirm") & matches(F.col("text"), "probation|confirm"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" in plan or "contains" in plan.lower()


@pytest.mark.parametrize("value", ["a  b", " a\tb ", "a\r\n b", "A b", "\x0b\x0ca", "", " ", "café  x", None])
def test_white_space_of_ascii_texts(spark, value):
    got = spark.createDataFrame([(value,)], "t string").select(text.normalize(F.col("t")).alias("n")).first().n
    assert got == (None if value is None else re.sub(r"\s+", " ", value).strip().lower())


def test_notice_is_read_once_for_all_sides(spark):
    """The periods of a text are found once, not once for each side that is asked for."""
    df = spark.createDataFrame([("you give 3 months notice; the company gives 30 days notice. notice of two weeks",)], "t string").select(extract.notice(F.col("t")).alias("n"))
    n = df.first().n
    assert (n.employee.days, n.employer.days, n.unattributed.days) == (90, 30, 14)
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
