"""Responders, the report through them, the preparation sheet's lists, and texts cut at marks."""

import json
import random
import threading
import time

import pytest
from lexloom.operators import calls, prepare, report, responder
from lexloom.plans import contracts, q_report
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_calls_are_bounded_and_in_order():
    running, most, lock = 0, 0, threading.Lock()

    def run(k):
        nonlocal running, most
        with lock:
            running += 1
            most = max(most, running)
        time.sleep(0.002 * (k % 5))
        with lock:
            running -= 1
        return k * k

    assert calls.in_order(list(range(60)), 4, run) == [k * k for k in range(60)] and 1 < most <= 4
    assert calls.in_order([], 4, run) == []


def test_failures_are_rows(spark):
    def service(payload):
        """Fails in each of the ways that a service may, by the payload."""
        n = int(payload)
        if n % 6 == 0:
            raise calls.Blocked
        if n % 6 == 1:
            raise TimeoutError
        if n % 6 == 2:
            raise OSError("no route")
        if n % 6 == 3:
            return "no JSON"
        return json.dumps({"findings": [{"clauseId": "c001", "category": "GENERAL" if n % 6 == 4 else "NO SUCH", "risk": "LOW", "quote": "q"}]})

    asked = spark.range(120).selectExpr("CAST(id AS STRING) AS request_id", "id AS doc_id", "0 AS batch", "CAST(id AS STRING) AS payload").repartition(5)
    got = {r.doc_id: r for r in calls.ask(asked, calls.calls(service)).collect()}
    want = {0: "MODEL_BLOCKED", 1: "UPSTREAM_TIMEOUT", 2: "INTERNAL", 3: "MODEL_INVALID_OUTPUT", 4: None, 5: "MODEL_INVALID_OUTPUT"}
    assert {k: r.code for k, r in got.items()} == {k: want[k % 6] for k in range(120)}
    assert all((r.body is not None) == (r.code is None) for r in got.values())


def test_requests_without_an_answer_have_failed(spark):
    asked = spark.range(4).selectExpr("CAST(id AS STRING) AS request_id", "id AS doc_id", "0 AS batch", "'{\"clauses\":[]}' AS payload")
    silent = lambda rows: calls.deterministic(rows.where("doc_id <> 2"))
    assert {r.doc_id: r.code for r in calls.ask(asked, silent).collect()} == {0: None, 1: None, 2: "INTERNAL", 3: None}


@pytest.mark.parametrize("raw", ['{"findings":[]}', '```json\n{"findings":[]}\n```', ' ```\n{"findings":[]}```  '])
def test_fences_are_taken_off(spark, raw):
    [row] = calls.judged(spark.createDataFrame([("1", raw, None)], calls.ANSWERED)).collect()
    assert row.code is None and row.body.findings == []


def test_the_report_takes_any_responder(spark):
    facts = report.facts(contracts.clauses(spark, SF).where("doc_id < 900"), 3)
    through = calls.analyze(facts, calls.deterministic, q_report.chosen())
    said = facts.withColumn("found", responder.classify(F.col("text"))).where("found is not null")
    said = said.select("doc_id", "batch", "ord", "clause_id", "found.category", "found.risk", responder.quote_from(F.col("text")).alias("quote"))
    direct = report.analyze(facts, said, F.lit(False), q_report.chosen())
    a, b = ({r.doc_id: r for r in x.collect()} for x in (through, direct))
    assert a == b and len(a) > 100 and all(r.unverified == 0 and not r.partial for r in a.values()) and any(r.verified for r in a.values())

    # A responder that fails on some batches: the others' findings stay, and the document is partial.
    picky = lambda rows: calls.deterministic(rows).withColumn("code", F.when(F.endswith("request_id", F.lit("/0")), "RATE_LIMITED"))
    some = {r.doc_id: r for r in calls.analyze(facts, picky, q_report.chosen()).collect()}
    assert set(some) == {r.doc_id for r in facts.where("batch > 0").select("doc_id").distinct().collect()} and all(r.partial for r in some.values())


def test_lines_are_deduped_by_letters(spark):
    lines = [" Ask HR. ", "ask hr", "", "  ", "Ask  HR!", "Écrire", "ÉCRIRE", "?", "!", "bring it"]
    [row] = spark.createDataFrame([(lines,)], "l array<string>").select(prepare.dedupe(F.col("l")).alias("l")).collect()
    assert row.l == ["Ask HR.", "Écrire", "?", "bring it"]


def test_segments_joined_are_the_text(spark):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        text, marks, at = "".join(rng.choice("ab é\U0001f642\n") for _ in range(rng.randrange(40))), [], 0
        while at < len(text) and rng.random() < 0.8:
            start = rng.randrange(at, len(text))
            n = rng.randrange(1, len(text) - start + 1)
            marks.append((f"t{len(marks)}", start, n))
            at = start + n
        rng.shuffle(marks)
        rows.append((k, text, marks))
    table = spark.createDataFrame(rows, "k int, text string, marks array<struct<term: string, start: int, n: int>>")
    got = {r.k: r.s for r in table.select("k", responder.segments(F.col("text"), F.col("marks")).alias("s")).collect()}
    for k, text, marks in rows:
        assert "".join(x.text for x in got[k]) == text and all(x.text for x in got[k])
        assert [(x.term, x.text) for x in got[k] if x.term] == [(t, text[s : s + n]) for t, s, n in sorted(marks, key=lambda m: m[1])]
