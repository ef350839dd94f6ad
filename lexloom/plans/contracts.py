"""Contracts rendered from the star schema: an order is a document, a line item a clause.

Every value is a function of table columns. The expressions here have one text for Spark and for SQL engines, so that
both sides of a comparison start from the same documents; what is compared is what is done with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rows import once
from .registry import read

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
#: (category, text); a, q, p, s are whole numbers of the row. No straight apostrophes: engines differ in escaping them.
TEMPLATES = [
    ("NOTICE_PERIOD", "'The Employee shall give ' || CAST(q * 3 AS STRING) || ' days written notice of resignation; the Company may terminate on ' || CAST(p % 90 AS STRING) || ' days notice.'"),
    ("NOTICE_PERIOD", "'Employment may end after a notice period of ninety (90) days. Notice of ' || CAST(s % 5 AS STRING) || ' weeks applies during training.'"),
    ("BOND_OR_EXIT_PENALTY", "'You shall serve a minimum period of ' || CAST(q AS STRING) || ' months, failing which liquidated damages of Rs. ' || CAST(a AS STRING) || ' are payable to the Company.'"),
    ("BOND_OR_EXIT_PENALTY", "'This service bond allows the Company to recover the training cost of ' || CAST(s % 9 AS STRING) || '.5 lakhs or INR 1,50,000 if you leave within two years.'"),
    ("NON_COMPETE", "'You shall not, directly or indirectly, join any business that competes with the Company for ' || CAST(q AS STRING) || ' months after termination.'"),
    ("NON_COMPETE", "'During the term of this employment you shall devote your whole time and attention and take up no competing business.'"),
    ("DOCUMENT_RETENTION", "'You shall deposit your original certificates and the Company will ' || CASE WHEN s % 3 = 0 THEN 'not retain them beyond ' || CAST(q AS STRING) || ' months' WHEN s % 3 = 1 THEN 'keep them in safe custody' ELSE 'not hold them; each original document is verified and returned' END || '.'"),
    ("NON_SOLICIT", "'For one year you will not solicit or entice away any client, or approach a former customer, of the Company.'"),
    ("CONFIDENTIALITY", "'All proprietary information and trade secrets stay confidential at all times.'"),
    ("IP_ASSIGNMENT", "'Any invention or work product, whether or not made outside working hours, belongs to the Company' || CASE WHEN q % 2 = 0 THEN ' as intellectual property' ELSE '' END || '.'"),
    ("TERMINATION", "'The Company may terminate your employment without notice' || CASE WHEN s % 2 = 0 THEN ' for misconduct or fraud' ELSE ' and with immediate effect' END || '.'"),
    ("COMPENSATION", "'Your cost to company is Rs. ' || CAST(a AS STRING) || ' per annum, with basic salary, house rent allowance, special allowance and provident fund.'"),
    ("COMPENSATION", "'A joining bonus of Rs. ' || CAST(a % 1000 AS STRING) || ' thousand shall be repaid in full if you resign within ' || CAST(q AS STRING) || ' weeks.'"),
    ("GENERAL", "'The Company reserves the right to amend the policies and conditions from time to time' || CASE WHEN q % 3 = 0 THEN ' at its sole discretion' ELSE '' END || '.'"),
    ("PROBATION", "'You are on probation for a period of six months, which may be extended' || CASE WHEN p % 2 = 0 THEN ' but shall not exceed one year' ELSE '' END || '.'"),
    ("BENEFITS", "'This fixed-term engagement for a term of ' || CAST(q AS STRING) || ' months carries gratuity and ' || CAST(s % 30 AS STRING) || ' days of paid leave.'"),
    ("DISPUTE_RESOLUTION", "'Disputes go to arbitration, with the courts at the place of posting having jurisdiction.'"),
    ("GENERAL", "'Welcome. You are appointed to the position of Analyst with effect from 1 July 2024, reporting to the unit head, based at site ' || CAST(s AS STRING) || '.'"),
    ("OTHER", "'Page ' || CAST(q AS STRING) || ' – the “Handbook” applies…  It isn’t part of   this letter.'"),
    (None, "'Regards, ' || CAST(p AS STRING)"),
]
KIND = f"(p * 7 + s * 3 + q) % {len(TEMPLATES)}"
TEXT = "CASE kind " + " ".join(f"WHEN {k} THEN {t}" for k, (_, t) in enumerate(TEMPLATES)) + " END"
CATEGORY = "CASE kind " + " ".join(f"WHEN {k} THEN '{c}'" for k, (c, _) in enumerate(TEMPLATES) if c) + " END"
CLAUSE_ID = "'c' || lpad(CAST(n AS STRING), 3, '0')"
LABEL = "CASE WHEN kind % 4 = 3 THEN NULL ELSE CAST(n AS STRING) || '.' || CAST(s % 3 + 1 AS STRING) END"
#: Version B: lines that were returned are reworded, some are gone, and a third are renumbered.
TEXT_B = "CASE WHEN rf = 'R' THEN replace(replace(text, 'shall', 'must'), 'months', 'long months') || ' Amended to ' || CAST(q + 1 AS STRING) || '.' ELSE text END"
LABEL_B = "CASE WHEN p % 3 = 0 THEN NULL ELSE label END"
GONE_B = "ls = 'O' AND q % 10 = 0"
#: Line items of a task at most, about.
TASK_ROWS = 250_000
COLUMNS = ["doc_id", "clause_id", "n AS ord", "label", "page", "category", "text", "kind", "p", "s", "q", "a", "rf", "ls"]


def by_order(items: DataFrame) -> DataFrame:
    """Line items dealt by order to more tasks than Spark's own number where a task would get more than ``TASK_ROWS``: what a
    task sorts and holds then stays the same however long the table is. The count is read from the files' footers."""
    parts = -(-items.count() // TASK_ROWS)
    return items.repartition(parts, "l_orderkey") if parts > int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")) else items


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, clause_id, ord, label, page, category, text of version A, with the numbers that made them."""
    line = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    rows = by_order(read(spark, sf_dir, "lineitem")).withColumn("n", F.row_number().over(line)).selectExpr(
        "l_orderkey AS doc_id", "CAST(n AS INT) AS n", "l_partkey AS p", "l_suppkey AS s", "CAST(l_quantity AS BIGINT) AS q",
        "CAST(l_extendedprice AS BIGINT) AS a", "l_returnflag AS rf", "l_linestatus AS ls",
    )
    rows = once(rows, kind=F.expr(f"CAST({KIND} AS INT)"), block=F.expr("CAST(floor((n + 2) / 3) AS INT)"))
    rows = once(rows, text=F.expr(TEXT), category=F.expr(CATEGORY), clause_id=F.expr(CLAUSE_ID), label=F.expr(LABEL))
    return rows.selectExpr(*[c if c != "page" else "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE block END AS page" for c in COLUMNS])


CTE = f"""numbered AS (
  SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) AS INT) AS n, l_partkey AS p, l_suppkey AS s,
         CAST(floor(l_quantity) AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS a, l_returnflag AS rf, l_linestatus AS ls FROM lineitem
), kinds AS (SELECT *, CAST({KIND} AS INT) AS kind, CAST(floor((n + 2) / 3) AS INT) AS block FROM numbered),
clauses AS (
  SELECT doc_id, {CLAUSE_ID} AS clause_id, n AS ord, {LABEL} AS label, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE block END AS page,
         {CATEGORY} AS category, {TEXT} AS text, kind, p, s, q, a, rf, ls FROM kinds
)"""


def both_versions(a: DataFrame) -> DataFrame:
    """doc_id, ord, text and text_b of the clauses that both versions have: version B's text lies in the row that it is made from."""
    return a.where(f"NOT ({GONE_B})").selectExpr("doc_id", "ord", "text", f"{TEXT_B} AS text_b")


def version_b(a: DataFrame) -> DataFrame:
    return a.where(f"NOT ({GONE_B})").selectExpr("doc_id", "clause_id", "ord", f"{LABEL_B} AS label", f"{TEXT_B} AS text")


CTE_B = f"version_b AS (SELECT doc_id, clause_id, ord, {LABEL_B} AS label, {TEXT_B} AS text FROM clauses WHERE NOT ({GONE_B}))"
