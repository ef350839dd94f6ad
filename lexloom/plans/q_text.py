"""Queries of the text and extraction layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..functions.rows import once
from ..operators.catalog import SALARY_PARTS
from ..operators.rules import employee_notice, salary_parts, with_facts
from .contracts import CTE, clauses
from .registry import query, read

NORM_CTE = f"norm AS (SELECT *, {T.sql_normalize('text')} AS norm FROM clauses)"
WITH = f"WITH {CTE}, {NORM_CTE}"


@query(f"{WITH} SELECT doc_id, clause_id, norm, CAST(length(norm) AS BIGINT) AS n_chars FROM norm")
def txt_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("doc_id", "clause_id", T.normalize(F.col("text")).alias("norm")).withColumn("n_chars", F.length("norm").cast("long"))


@query(f"SELECT doc_id, {T.sql_normalize('text')} AS norm FROM documents")
def txt_normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("norm"))


@query(f"""{WITH}, t AS (SELECT doc_id, clause_id, {T.sql_tokens('norm')} AS tokens FROM norm)
SELECT doc_id, clause_id, CAST(i AS BIGINT) AS i, tokens[i] AS token, CAST(coalesce(list_sum(list_transform(tokens[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start
FROM t, unnest(range(1, len(tokens) + 1)) AS u(i)""")
def txt_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = clauses(spark, sf_dir).select("doc_id", "clause_id", F.posexplode(T.tokens(T.normalize(F.col("text")))).alias("i", "token"))
    # Offsets by a running sum along each clause.
    before = F.sum(F.length("token") + 1).over(Window.partitionBy("doc_id", "clause_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    return flat.select("doc_id", "clause_id", (F.col("i") + 1).cast("long").alias("i"), "token", F.coalesce(before, F.lit(0)).cast("long").alias("start"))


@query(f"{WITH} SELECT doc_id, clause_id, array_to_string(list_sort({T.sql_token_set('norm')}), ' ') AS words FROM norm")
def txt_token_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("doc_id", "clause_id", F.array_join(F.sort_array(T.token_set(T.normalize(F.col("text")))), " ").alias("words"))


@query(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(source || ' - ' || lang || ' of the a-z'), '\s+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND w[i] IN ('a','an','and','as','at','by','for','in','of','on','or','the','to','with') THEN w[i]
  ELSE array_to_string(list_transform(string_split(w[i], '-'), lambda p: upper(left(p, 1)) || substr(p, 2)), '-') END), ' ') AS title FROM w""")
def seg_titlecase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.title_case(F.concat("source", F.lit(" - "), "lang", F.lit(" of the a-z"))).alias("title"))


FORGED = "text || ' </Document > [[[' || clause_id || ']] < pair id=1>'"


@query(f"WITH {CTE} SELECT doc_id, clause_id, {T.sql_sanitize(FORGED)} AS safe FROM clauses")
def prm_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).select("doc_id", "clause_id", T.sanitize(F.expr(FORGED)).alias("safe"))


@query(f"""{WITH}, d AS (SELECT doc_id, clause_id, {X.sql_durations('norm')} AS d FROM norm)
SELECT doc_id, clause_id, CAST(i AS BIGINT) AS i, CAST(d[i].days AS INT) AS days, d[i].unit AS unit, d[i].text AS text FROM d, unnest(range(1, len(d) + 1)) AS u(i)""")
def ex_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clauses(spark, sf_dir).select("doc_id", "clause_id", F.posexplode(X.durations(T.normalize(F.col("text")))).alias("i", "d"))
    return found.select("doc_id", "clause_id", (F.col("i") + 1).cast("long").alias("i"), "d.days", "d.unit", "d.text")


@query(f"""{WITH}, d AS (SELECT doc_id, clause_id, {X.sql_amounts('norm')} AS d FROM norm)
SELECT doc_id, clause_id, CAST(i AS BIGINT) AS i, CAST(d[i].rupees AS DOUBLE) AS rupees, d[i].text AS text, {X.sql_format_inr('d[i].rupees')} AS shown FROM d, unnest(range(1, len(d) + 1)) AS u(i)""")
def ex_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clauses(spark, sf_dir).select("doc_id", "clause_id", F.posexplode(X.amounts(T.normalize(F.col("text")))).alias("i", "d"))
    return found.select("doc_id", "clause_id", (F.col("i") + 1).cast("long").alias("i"), "d.rupees", "d.text", X.format_inr(F.col("d.rupees")).alias("shown"))


@query(f"SELECT o_orderkey, {X.sql_format_inr('o_totalprice * 1000')} AS shown FROM orders")
def ex_format_inr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", X.format_inr(F.col("o_totalprice") * 1000).alias("shown"))


NOTICE_CTE = f"""sent AS (SELECT doc_id, clause_id, i, regexp_split_to_array(norm, '[.;\\n]')[i] AS s FROM norm, unnest(range(1, len(regexp_split_to_array(norm, '[.;\\n]')) + 1)) AS u(i)),
placed AS (SELECT *, {X.sql_first_at('s', X.EMPLOYEE)} AS e, {X.sql_first_at('s', X.EMPLOYER)} AS c, {X.sql_durations('s')} AS d FROM sent WHERE contains(s, 'notice')),
owned AS (SELECT doc_id, clause_id, CASE WHEN e > 0 AND (c = 0 OR e < c) THEN 'employee' WHEN c > 0 THEN 'employer' ELSE 'none' END AS owner, d[k].days AS days, d[k].text AS text, i * 1000 + k AS place FROM placed, unnest(range(1, len(d) + 1)) AS u(k)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_id, owner ORDER BY days DESC, place) AS rn FROM owned),
notices AS (SELECT doc_id, clause_id, max(CASE WHEN owner = 'employee' THEN days END) AS e_days, max(CASE WHEN owner = 'employee' THEN text END) AS e_text, max(CASE WHEN owner = 'employer' THEN days END) AS c_days,
  max(CASE WHEN owner = 'employer' THEN text END) AS c_text, max(CASE WHEN owner = 'none' THEN days END) AS u_days, max(CASE WHEN owner = 'none' THEN text END) AS u_text FROM best WHERE rn = 1 GROUP BY doc_id, clause_id)"""


@query(f"{WITH}, {NOTICE_CTE} SELECT doc_id, clause_id, CAST(e_days AS INT) AS employee_days, e_text AS employee, CAST(c_days AS INT) AS employer_days, c_text AS employer, CAST(u_days AS INT) AS other_days, u_text AS other FROM notices")
def ex_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = with_facts(clauses(spark, sf_dir)).select("doc_id", "clause_id", "notice")
    n = n.where("notice.employee is not null or notice.employer is not null or notice.unattributed is not null")
    return n.selectExpr(
        "doc_id", "clause_id", "notice.employee.days AS employee_days", "notice.employee.text AS employee", "notice.employer.days AS employer_days",
        "notice.employer.text AS employer", "notice.unattributed.days AS other_days", "notice.unattributed.text AS other",
    )


@query(f"{WITH}, {NOTICE_CTE} SELECT doc_id, clause_id, CAST(coalesce(e_days, u_days) AS INT) AS days, coalesce(e_text, u_text) AS text FROM notices WHERE coalesce(e_days, u_days) IS NOT NULL")
def ex_employee_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = with_facts(clauses(spark, sf_dir)).select("doc_id", "clause_id", employee_notice(F.col("notice")).alias("own")).where("own is not null")
    return own.select("doc_id", "clause_id", "own.days", "own.text")


PARTS_SQL = " + ".join(f"CAST(regexp_matches(norm, '{p}') AS INT)" for p in SALARY_PARTS)


@query(f"{WITH} SELECT doc_id, clause_id, CAST({PARTS_SQL} AS INT) AS parts FROM norm WHERE {PARTS_SQL} > 0")
def ex_salary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = once(clauses(spark, sf_dir), norm=T.normalize(F.col("text")))
    return once(norm, parts=salary_parts(F.col("norm"))).select("doc_id", "clause_id", "parts").where("parts > 0")


@query(f"{WITH} SELECT doc_id, max(money.rupees) AS largest FROM norm, unnest({X.sql_amounts('norm')}) AS u(money) GROUP BY doc_id")
def agg_max_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = F.array_max(F.transform(X.amounts(T.normalize(F.col("text"))), lambda a: a["rupees"]))
    return clauses(spark, sf_dir).groupBy("doc_id").agg(F.max(amounts).alias("largest")).where("largest is not null")


@query(f"{WITH}, {NOTICE_CTE} SELECT doc_id, CAST(max(e_days) AS INT) AS employee_days, CAST(max(c_days) AS INT) AS employer_days FROM notices GROUP BY doc_id")
def agg_max_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = with_facts(clauses(spark, sf_dir)).where("notice.employee is not null or notice.employer is not null or notice.unattributed is not null")
    return n.groupBy("doc_id").agg(F.max("notice.employee.days").alias("employee_days"), F.max("notice.employer.days").alias("employer_days"))
