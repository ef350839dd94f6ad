"""Responders as a stage: requests go in, raw JSON comes out, and only what has the declared shape goes on.

A responder takes (request_id, payload) and gives (request_id, raw_json, code): a text, or the code of a failure. The
deterministic one is a projection; ``calls`` wraps any function of a payload, with a bound on calls at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rows import let
from ..functions.shared import written
from . import report, responder
from .catalog import CATEGORIES, RISKS
from .shapes import Items, Record, Text, type_of, violations

Responder = Callable[[DataFrame], DataFrame]
#: What is sent of a batch, and what must come back.
PAYLOAD = Record({"clauses": Items(Record({"id": Text(), "text": Text()}))})
ANSWER = Record({"findings": Items(Record({"clauseId": Text(least=1, most=40), "category": Text(among=tuple(CATEGORIES)), "risk": Text(among=tuple(RISKS)), "quote": Text(least=1, most=400)}), most=400)})
ANSWERED = "request_id string, raw_json string, code string"
#: Calls at a time in a task, and requests that a task holds.
AT_ONCE, HELD = 4, 200


class Blocked(Exception):
    """The service will not answer this request; asking again does not help."""


def in_order(items: list, at_once: int, run: Callable) -> list:
    """Results in the order of the items, at most so many running at a time."""
    with ThreadPoolExecutor(max(1, min(at_once, len(items)))) as pool:
        return list(pool.map(run, items))


def calls(ask: Callable[[str], str], at_once: int = AT_ONCE, attempts: int = 2) -> Responder:
    """A responder that calls ``ask`` for each payload. Faults are tried again; what fails is a row with a code."""

    def one(payload: str) -> tuple[str | None, str | None]:
        code = "INTERNAL"
        for _ in range(attempts):
            try:
                return ask(payload), None
            except Blocked:
                return None, "MODEL_BLOCKED"
            except TimeoutError:
                code = "UPSTREAM_TIMEOUT"
            except Exception:  # noqa: BLE001  whatever a service does, the other requests go on
                code = "INTERNAL"
        return None, code

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), HELD):
                some = batch.iloc[k : k + HELD]
                answers, codes = zip(*in_order(some["payload"].tolist(), at_once, one), strict=True)
                yield pd.DataFrame({"request_id": some["request_id"], "raw_json": answers, "code": codes})

    return lambda requests: requests.select("request_id", "payload").mapInPandas(run, ANSWERED)


def deterministic(requests: DataFrame) -> DataFrame:
    """The library's own responder: the first pattern that knows a clause, with its first whole sentence as the quote."""
    clauses = F.from_json("payload", type_of(PAYLOAD))["clauses"]

    def finding(c: Column) -> Column:
        said = lambda found: F.when(found.isNotNull(), F.struct(c["id"].alias("clauseId"), found["category"].alias("category"), found["risk"].alias("risk"), responder.quote_from(c["text"]).alias("quote")))
        return let(responder.classify(c["text"]), said)

    made = F.to_json(F.struct(F.array_compact(F.transform(clauses, finding)).alias("findings")))
    return requests.select("request_id", made.alias("raw_json"), F.lit(None).cast("string").alias("code"))


def requests(batched: DataFrame) -> DataFrame:
    """(request_id, doc_id, batch, payload) from clauses with their batch: one request for each."""
    sent = F.struct("ord", F.struct(F.col("clause_id").alias("id"), "text").alias("clause"))
    rows = batched.groupBy("doc_id", "batch").agg(F.transform(F.array_sort(F.collect_list(sent)), lambda x: x["clause"]).alias("clauses"))
    return rows.select(F.concat_ws("/", "doc_id", "batch").alias("request_id"), "doc_id", "batch", F.to_json(F.struct("clauses")).alias("payload"))


def unfenced(raw: Column) -> Column:
    """Models put a code fence around JSON at times."""
    inner = F.regexp_extract(raw, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*\z", 1)
    return F.when(inner != "", inner).otherwise(raw)


def judged(answers: DataFrame) -> DataFrame:
    """Answers with ``body`` (parsed, null where it may not be used) and ``code`` (null where it may)."""
    rows = answers.withColumn("raw_json", unfenced(F.col("raw_json")))
    wrong = F.when(F.col("raw_json").isNull() | (F.size(violations(ANSWER, F.col("raw_json"))) > 0), "MODEL_INVALID_OUTPUT")
    rows = rows.withColumn("code", F.coalesce("code", wrong))
    return rows.withColumn("body", F.when(F.col("code").isNull(), F.from_json("raw_json", type_of(ANSWER))))


def ask(asked: DataFrame, respond: Responder) -> DataFrame:
    """(request_id, doc_id, batch, code, body) of all requests: what the responder leaves out has failed, too."""
    given = judged(respond(asked)).select("request_id", "code", "body", F.lit(True).alias("given"))
    met = asked.select("request_id", "doc_id", "batch").join(given, "request_id", "left")
    return met.withColumn("code", F.when(F.col("given").isNull(), "INTERNAL").otherwise(F.col("code"))).drop("given")


def claims(answered: DataFrame) -> DataFrame:
    """(doc_id, batch, ord, clause_id, category, risk, quote) of the answers that may be used; ord counts a document's
    claims: batches come one after the other, whatever order they were answered in."""
    each = answered.select("doc_id", "batch", F.posexplode("body.findings").alias("k", "x"))
    return each.select("doc_id", "batch", (F.col("batch") * 1000 + F.col("k")).alias("ord"), F.col("x.clauseId").alias("clause_id"), "x.category", "x.risk", "x.quote")


def analyze(facts: DataFrame, respond: Responder, weights: dict[str, int]) -> DataFrame:
    """The report of ``report.analyze`` with claims from any responder: a request that failed leaves its batch out and the
    document partial; a document none of whose requests was answered has no report."""
    answered = written(ask(requests(facts), respond))
    failed = answered.select("doc_id", "batch", F.col("code").isNotNull().alias("failed"))
    return report.analyze(facts.join(failed, ["doc_id", "batch"]), claims(answered).withColumn("failed", F.lit(False)), F.col("failed"), weights)
