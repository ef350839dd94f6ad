"""Limits of the data contract and the session that the library expects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Limits:
    """Sizes that the data contract names."""

    file_bytes: int = 10 * 1024 * 1024
    pages: int = 40
    clause_chars: int = 4000
    total_chars: int = 120_000
    clauses: int = 400
    question_chars: int = 500
    history_turns: int = 4
    body_bytes: int = 256 * 1024
    quote_min: int = 12
    quote_max: int = 400
    batch: int = 80
    calls_per_visit: int = 30
    scanned_chars_per_page: int = 100
    fragment_chars: int = 200
    sentence_chars: int = 60
    fuzzy_tokens: int = 2000
    changed_pairs: int = 60
    reviewed_questions: int = 12


LIMITS = Limits()
#: Requests that a route allows in a window of so many seconds.
ROUTES = {"session": (10, 600), "analyze": (8, 3600), "ask": (40, 3600), "compare": (10, 3600), "prepare": (10, 3600)}


def session(name: str = "lexloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution; ``conf`` overrides (underscores stand for dots)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
