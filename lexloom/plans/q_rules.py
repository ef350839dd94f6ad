"""Queries of the rule library, its gaps, texts and questions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.patterns import sql_case, sql_matches, sql_text
from ..operators import rules as R
from ..operators.catalog import GAPS, NO_KEEPING, RISKS, RULES, TIME_LIMIT, Rule
from .contracts import CTE, clauses
from .q_text import NORM_CTE, NOTICE_CTE, PARTS_SQL
from .registry import ORACLE, QUERIES, query

#: In SQL without look-ahead: the text behind the last promise of a sentence must hold no time limit.
KEEPING_SQL = f"""len(list_filter(regexp_split_to_array(norm, '[.]'), lambda s: regexp_matches(s, {sql_text(NO_KEEPING)}) AND NOT regexp_matches(regexp_extract(s, {sql_text('(?s)^.*' + NO_KEEPING + '(.*)$')}, 3), {sql_text(TIME_LIMIT)}))) = 0"""


def _sql_hit(r: Rule) -> str:
    where = [f"category IN ({', '.join(sql_text(c) for c in r.applies)})"] if r.applies else []
    where += [sql_matches("norm", p) for p in r.has] + [f"NOT {sql_matches('norm', p)}" for p in r.lacks]
    severity, shown = sql_text(r.severity), {"amount": "NULL", "yours": "NULL", "theirs": "NULL", "period": "NULL"}
    if r.special == "bond":
        severity = "CASE WHEN amount > 0 THEN 'HIGH' ELSE 'MEDIUM' END"
        shown["amount"] = f"CASE WHEN amount > 0 THEN {X.sql_format_inr('amount')} END"
    elif r.special == "asymmetric":
        where.append("e_days > c_days")
        shown |= {"yours": "e_text", "theirs": "c_text"}
    elif r.special == "long":
        where.append("coalesce(e_days, u_days) >= 60")
        severity = "CASE WHEN coalesce(e_days, u_days) >= 90 THEN 'HIGH' ELSE 'MEDIUM' END"
        shown["period"] = "coalesce(e_text, u_text)"
    elif r.special == "salary":
        where.append(f"{PARTS_SQL} >= 2")
    elif r.special == "keeping":
        where.append(KEEPING_SQL)
    return f"SELECT doc_id, clause_id, {sql_text(r.id)} AS rule_id, {severity} AS severity, " + ", ".join(f"CAST({v} AS VARCHAR) AS {k}" for k, v in shown.items()) + f" FROM facts WHERE {' AND '.join(where)}"




def hits_parts(steered: bool = False) -> str:
    """Tables up to ``hits`` from ``clauses``; steered: by the categories of ``cats`` instead of the clauses' own."""
    columns, steer = ("norm.* REPLACE (cats.category AS category)", " LEFT JOIN cats USING (doc_id, clause_id)") if steered else ("norm.*", "")
    return f"""{NORM_CTE}, {NOTICE_CTE},
money AS (SELECT doc_id, clause_id, max(m.rupees) AS amount FROM norm, unnest({X.sql_amounts('norm')}) AS u(m) GROUP BY doc_id, clause_id),
facts AS (SELECT {columns}, amount, e_days, e_text, c_days, c_text, u_days, u_text FROM norm{steer} LEFT JOIN money USING (doc_id, clause_id) LEFT JOIN notices USING (doc_id, clause_id)),
hits AS ({' UNION ALL '.join(_sql_hit(r) for r in RULES)})"""


HITS_CTE = f"WITH {CTE}, {hits_parts()}"
RISK_SQL = sql_case("severity", RISKS)


@query(f"{HITS_CTE} SELECT *, CAST({RISK_SQL} AS INT) AS risk FROM hits")
def rules_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.run_rules(clauses(spark, sf_dir))


@query(f"{HITS_CTE} SELECT doc_id, clause_id, rule_id, severity, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {RISK_SQL} DESC, clause_id, rule_id) AS INT) AS rank FROM hits")
def rules_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy(F.col("risk").desc(), "clause_id", "rule_id")
    return R.run_rules(clauses(spark, sf_dir)).select("doc_id", "clause_id", "rule_id", "severity", F.row_number().over(order).alias("rank"))


def _one_rule(rule_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tuple(r for r in RULES if r.id == rule_id)
    return R.run_rules(clauses(spark, sf_dir), own).select("doc_id", "clause_id", "severity")


for _rule in RULES:
    _name = "rule_" + _rule.id.removeprefix("IN-EMP-").lower().replace("-", "_")
    QUERIES[_name] = partial(_one_rule, _rule.id)
    ORACLE[_name] = f"{HITS_CTE} SELECT doc_id, clause_id, severity FROM hits WHERE rule_id = {sql_text(_rule.id)}"

STATED_SQL = ", ".join(f"bool_or({sql_matches('norm', g.pattern)}{' OR coalesce(e_days, c_days, u_days) IS NOT NULL' if g.id.endswith('NOTICE') else ''}) AS g{k}" for k, g in enumerate(GAPS))
GAPS_PARTS = f"stated AS (SELECT doc_id, {STATED_SQL} FROM facts GROUP BY doc_id), gaps AS (" + " UNION ALL ".join(f"SELECT doc_id, {sql_text(g.id)} AS gap_id, {sql_text(g.label)} AS label, {sql_text(g.question)} AS question FROM stated WHERE NOT g{k}" for k, g in enumerate(GAPS)) + ")"
GAPS_CTE = f"{HITS_CTE}, {GAPS_PARTS}"


@query(f"{GAPS_CTE} SELECT * FROM gaps")
def gaps_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.find_gaps(clauses(spark, sf_dir))


#: Titles of rules, and labels of gaps, in the second language; what has none falls back to the catalogue.
TITLES_HI = {
    "IN-EMP-NONCOMPETE-POST": "नौकरी छोड़ने के बाद प्रतिस्पर्धा पर रोक", "IN-EMP-NONCOMPETE-DURING": "नौकरी के दौरान केवल यही काम", "IN-EMP-BOND": "समय से पहले छोड़ने पर भुगतान",
    "IN-EMP-NOTICE-ASYMMETRIC": "आपका नोटिस ज़्यादा लंबा है", "IN-EMP-NOTICE-LONG": "लंबा नोटिस", "IN-EMP-DOC-RETENTION": "मूल दस्तावेज़ रख लिए जाते हैं", "IN-EMP-NONSOLICIT": "ग्राहकों या कर्मचारियों से संपर्क पर रोक",
    "IN-EMP-CONFIDENTIALITY": "गोपनीयता", "IN-EMP-IP-BROAD": "आपके बनाए काम पर व्यापक दावा", "IN-EMP-TERMINATION-NO-NOTICE": "बिना नोटिस के सेवा समाप्ति", "IN-EMP-CLAWBACK": "बोनस वापस देना होगा",
    "IN-EMP-UNILATERAL-CHANGE": "शर्तें एकतरफ़ा बदल सकती हैं", "IN-EMP-PROBATION-EXTEND": "बिना सीमा की परिवीक्षा", "IN-EMP-WAGES-50": "वेतन की बनावट", "IN-EMP-GRATUITY-FTE": "निश्चित अवधि की नौकरी में ग्रेच्युटी",
    "IN-EMP-JURISDICTION": "विवाद कहाँ सुने जाएँगे",
}
LABELS_HI = {
    "IN-EMP-MISSING-NOTICE": "नोटिस", "IN-EMP-MISSING-SALARY": "वेतन", "IN-EMP-MISSING-ROLE": "पद", "IN-EMP-MISSING-LOCATION": "काम की जगह", "IN-EMP-MISSING-LEAVE": "छुट्टी", "IN-EMP-MISSING-PROBATION": "परिवीक्षा",
}
NOT_STATED_HI = ": इस दस्तावेज़ में नहीं बताया गया"


@query(f"{HITS_CTE} SELECT doc_id, clause_id, rule_id, coalesce({sql_case('rule_id', TITLES_HI)}, {sql_case('rule_id', {r.id: r.title for r in RULES})}) AS title FROM hits")
def rules_localise(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Both tables are the catalogue's own constants: a few rows.
    base = spark.createDataFrame([(r.id, r.title) for r in RULES], "rule_id string, base string")
    other = spark.createDataFrame(list(TITLES_HI.items()), "rule_id string, other string")
    texts = base.join(other, "rule_id", "left").select("rule_id", F.coalesce("other", "base").alias("title"))
    return R.run_rules(clauses(spark, sf_dir)).select("doc_id", "clause_id", "rule_id").join(F.broadcast(texts), "rule_id")


@query(f"{GAPS_CTE} SELECT doc_id, gap_id, label || ': not stated in this document' AS line FROM gaps")
def rules_not_stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.find_gaps(clauses(spark, sf_dir)).select("doc_id", "gap_id", F.concat("label", F.lit(": not stated in this document")).alias("line"))


@query(f"{GAPS_CTE} SELECT doc_id, gap_id, {sql_case('gap_id', LABELS_HI)} || '{NOT_STATED_HI}' AS line FROM gaps")
def gaps_localise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not stated, in the second language."""
    labels = F.create_map(*[F.lit(x) for p in LABELS_HI.items() for x in p])
    return R.find_gaps(clauses(spark, sf_dir)).select("doc_id", "gap_id", F.concat(F.coalesce(labels[F.col("gap_id")], "label"), F.lit(NOT_STATED_HI)).alias("line"))


QUESTIONS = [(r.id, k, q) for r in RULES for k, q in enumerate(r.questions)]
QUESTIONS_SQL = "questions(rule_id, k, question) AS (VALUES " + ", ".join(f"({sql_text(i)}, {k}, {sql_text(q)})" for i, k, q in QUESTIONS) + ")"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the rules that fired, once per document, by the first hit that asks them."""
    table = F.broadcast(spark.createDataFrame(QUESTIONS, "rule_id string, k int, question string"))
    hits = R.run_rules(clauses(spark, sf_dir)).select("doc_id", "clause_id", "rule_id", "risk").join(table, "rule_id")
    first = F.min(F.struct((-F.col("risk")).alias("r"), "clause_id", "rule_id", "k"))
    once = hits.groupBy("doc_id", "question").agg(first.alias("first"))
    return once.select("doc_id", "question", F.col("first.r").alias("r"), F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("i"))


ASKED_CTE = f"""{HITS_CTE}, {QUESTIONS_SQL},
each AS (SELECT doc_id, question, -({RISK_SQL}) AS r, clause_id, rule_id, k, row_number() OVER (PARTITION BY doc_id, question ORDER BY -({RISK_SQL}), clause_id, rule_id, k) AS rn FROM hits JOIN questions USING (rule_id)),
asked AS (SELECT doc_id, question, r, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY r, clause_id, rule_id, k) AS INT) AS i FROM each WHERE rn = 1)"""


@query(f"{ASKED_CTE} SELECT doc_id, question, i FROM asked")
def rules_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("doc_id", "question", "i")


@query(f"{ASKED_CTE}, h AS (SELECT doc_id, question, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM asked WHERE r <= -2) SELECT doc_id, question, CAST(n AS INT) AS n FROM h WHERE n <= 12")
def topk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = asked(spark, sf_dir).where("r <= -2")
    return strong.select("doc_id", "question", F.row_number().over(Window.partitionBy("doc_id").orderBy("i")).alias("n")).where("n <= 12")


@query(f"{HITS_CTE} SELECT category, severity, CAST(count(*) AS BIGINT) AS n FROM hits JOIN clauses USING (doc_id, clause_id) GROUP BY ROLLUP (category, severity)")
def ext_rollup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: hits by category and severity with subtotals."""
    hits = R.run_rules(clauses(spark, sf_dir), keep=("category",))
    return hits.rollup("category", "severity").agg(F.count("*").alias("n"))
