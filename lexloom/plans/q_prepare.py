"""Queries of the preparation sheet, as lists and as a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.patterns import sql_case, sql_matches, sql_text
from ..operators import prepare as P
from ..operators import responder as M
from ..operators.catalog import RULES
from .contracts import clauses
from .q_rules import GAPS_CTE, QUESTIONS_SQL, RISK_SQL
from .registry import query


def _said(i: int) -> str:
    """The responder's lines of one list, as a list."""
    return "list_filter([" + ", ".join(f"CASE WHEN bool_or({sql_matches('text', w, True)}) THEN {sql_text(texts[i])} END" for w, *texts in M.SUGGESTIONS if texts[i]) + "], lambda x: x IS NOT NULL)"


def _deduped(items: str) -> str:
    keys = f"list_transform({items}, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g'))"
    return f"list_filter({items}, lambda x, i: list_position({keys}, {keys}[i]) = i)"


_EMPTY = "CAST([] AS VARCHAR[])"
SHEET_CTE = f"""{GAPS_CTE}, {QUESTIONS_SQL}, said AS (SELECT doc_id, {', '.join(f'{_said(i)} AS {name}' for i, name in enumerate(M.LISTS))} FROM clauses GROUP BY doc_id),
each AS (SELECT doc_id, question, min((-({RISK_SQL}), clause_id, rule_id, k)) AS first FROM hits JOIN questions USING (rule_id) WHERE severity IN ('HIGH', 'MEDIUM') GROUP BY doc_id, question),
ranked AS (SELECT doc_id, question, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM each),
reviewed AS (SELECT doc_id, list(question ORDER BY n) AS reviewed FROM ranked WHERE n <= {LIMITS.reviewed_questions} GROUP BY doc_id),
unsaid AS (SELECT doc_id, list(label || '{P.NOT_STATED}' ORDER BY label || '{P.NOT_STATED}') AS missing FROM gaps GROUP BY doc_id),
titles AS (SELECT hits.doc_id, coalesce(c.label, c.clause_id) AS label, {sql_case('rule_id', {r.id: r.title for r in RULES})} AS title, severity, c.text, hits.clause_id, rule_id FROM hits JOIN clauses AS c ON c.doc_id = hits.doc_id AND c.clause_id = hits.clause_id WHERE severity = 'HIGH'),
flagged AS (SELECT doc_id, string_agg('### ' || label || ' — ' || title || ' (' || severity || ')' || chr(10) || chr(10) || '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || chr(10), '' ORDER BY clause_id, rule_id) AS raised FROM titles GROUP BY doc_id),
whole AS (SELECT doc_id, checklist, for_hr, list_concat(for_lawyer, coalesce(reviewed, {_EMPTY})) AS for_lawyer, coalesce(missing, {_EMPTY}) AS missing, documents, raised FROM said LEFT JOIN reviewed USING (doc_id) LEFT JOIN unsaid USING (doc_id) LEFT JOIN flagged USING (doc_id)),
sheet AS (SELECT doc_id, {', '.join(f'{_deduped(name)} AS {name}' for name, _ in P.SECTIONS)}, raised FROM whole)"""
_SECTIONS_SQL = " || ".join(f"CASE WHEN len({name}) > 0 THEN '## {heading}' || chr(10) || chr(10) || array_to_string(list_transform({name}, lambda x: '- [ ] ' || x || chr(10)), '') || chr(10) ELSE '' END" for name, heading in P.SECTIONS)


@query(f"{SHEET_CTE} SELECT doc_id, " + ", ".join(f"array_to_string({name}, ' | ') AS {name}" for name, _ in P.SECTIONS) + " FROM sheet")
def pp_prepare_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sheet: the responder's lists, reviewed questions of serious hits, and what is not stated."""
    return P.sheet(clauses(spark, sf_dir)).select("doc_id", *[F.array_join(name, " | ").alias(name) for name, _ in P.SECTIONS])


@query(f"""{SHEET_CTE} SELECT doc_id, '# {P.TITLE}' || chr(10) || chr(10) || 'Document ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || {_SECTIONS_SQL}
  || CASE WHEN raised IS NOT NULL THEN '## {P.FLAGGED}' || chr(10) || chr(10) || raised ELSE '' END || '---' || chr(10) || chr(10) || '{P.FOOTER}' AS file FROM sheet""")
def snk_markdown_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet as a Markdown file: a checklist for each section, and the flagged clauses quoted."""
    return P.sheet(clauses(spark, sf_dir)).select("doc_id", P.markdown(F.concat(F.lit("Document "), F.col("doc_id"))).alias("file"))
