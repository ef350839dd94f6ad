"""Letters as lines, rendered from the same rows as the contracts: titles, clauses, fragments, blanks, furniture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .contracts import CTE, clauses

#: (place within the clause, condition, text): the lines that a row gives, in this order.
LINES = [
    (0, "ord % 4 = 1", "'  ' || CAST(floor((ord + 3) / 4) AS INT) || '. PROBATION AND PAY '"),
    (1, "ord % 4 = 1 AND s % 2 = 0", "''"),
    (2, "kind = 5", "'GENERAL TERMS OF WORK'"),
    (3, "kind = 6", "'Section ' || CAST(q AS STRING) || '. Notes. Text of a section that is named and goes on.'"),
    (4, "kind <> 19", "CASE WHEN kind % 3 = 0 THEN text ELSE CAST(floor((ord + 3) / 4) AS INT) || '.' || CAST((ord - 1) % 4 + 1 AS INT) || ' ' || CASE WHEN kind % 3 = 1 THEN 'Pay terms. ' ELSE '' END || text END"),
    (5, "kind = 8", "'(a) all lists of clients, and'"),
    (6, "kind IN (3, 9)", "'Page ' || CAST(ord AS STRING) || ' of 9'"),
    (7, "kind IN (1, 9, 13)", "'   '"),
    (8, "kind IN (1, 4, 13)", "'and any renewal thereof.'"),
    (9, "kind = 19", "'----------'"),
    (10, "kind = 11", "'(Signed and sealed.) This is a sentence of its own that is long enough to stand alone in the letter.'"),
]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, text, page."""
    rows = clauses(spark, sf_dir)
    items = ", ".join(f"CASE WHEN {c} THEN named_struct('k', {k}, 'text', {t}) END" for k, c, t in LINES)
    found = rows.selectExpr("doc_id", "ord", "page", f"explode(array_compact(array({items}))) AS line")
    return found.selectExpr("doc_id", "ord * 100 + line.k AS line_no", "line.text AS text", "page")


LINES_CTE = CTE + ", lines AS (" + " UNION ALL ".join(f"SELECT doc_id, ord * 100 + {k} AS line_no, {t} AS text, page FROM clauses WHERE {c}" for k, c, t in LINES) + ")"
