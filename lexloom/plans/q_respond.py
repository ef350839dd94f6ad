"""Queries of the deterministic responder and of the results assembled from it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rows import let, once
from ..functions.patterns import matches, sql_case, sql_matches, sql_text
from ..operators import responder as M
from ..operators import verify as V
from ..operators.catalog import BOND_AMOUNT, BOND_TOPIC, CATEGORIES, DOCUMENT_TYPE, GLOSSARY, RISKS, SUMMARY
from .contracts import CTE, clauses
from .registry import query, read

CLASS_SQL = "CASE " + " ".join(f"WHEN {sql_matches('text', p, True)} THEN {{}}".replace("{}", sql_text(c)) for c, _, p in M.CLASSES) + " END"
RISK_SQL = "CASE " + " ".join(f"WHEN {sql_matches('text', p, True)} THEN {sql_text(r)}" for _, r, p in M.CLASSES) + " END"
FOUND = f"WITH {CTE}, found AS (SELECT doc_id, clause_id, ord, text, {CLASS_SQL} AS category, {RISK_SQL} AS risk FROM clauses WHERE {CLASS_SQL} IS NOT NULL)"
CITE_SQL = f"trim(CASE WHEN regexp_extract(text, {sql_text(M.CITED)}) <> '' THEN regexp_extract(text, {sql_text(M.CITED)}) ELSE left(text, 160) END)"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, clause_id, ord, category, risk, quote) of clauses that a pattern knows."""
    rows = once(clauses(spark, sf_dir).select("doc_id", "clause_id", "ord", "text"), found=M.classify(F.col("text"))).where("found is not null")
    return rows.select("doc_id", "clause_id", "ord", "text", "found.category", "found.risk", M.quote_from(F.col("text")).alias("quote"))


@query(f"{FOUND} SELECT doc_id, clause_id, category, risk FROM found")
def mk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("doc_id", "clause_id", "category", "risk")


@query(f"{FOUND} SELECT category, CAST(count(*) AS BIGINT) AS n FROM found GROUP BY category")
def win_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query()
def mk_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by look-behind: not for every SQL engine; every quote must verify exactly (tested)."""
    return findings(spark, sf_dir).select("doc_id", "clause_id", "quote")


def _first_sql(name: str) -> str:
    pattern, group, fold = SUMMARY[name]
    value = f"trim(regexp_extract(text, {sql_text(('(?i)' if fold else '') + pattern)}, {group}))"
    return f"arg_min({value}, ord) FILTER ({value} <> '') AS {name}"


_BOND = f"arg_min(regexp_extract(text, {sql_text(BOND_AMOUNT)}), ord) FILTER ({sql_matches('text', BOND_TOPIC, True)})"
SUMMARY_SQL = f"SELECT doc_id, {sql_text(DOCUMENT_TYPE)} AS document_type, {', '.join(map(_first_sql, SUMMARY))}, CASE WHEN {_BOND} <> '' THEN {_BOND} END AS bond, string_agg(clause_id, ',' ORDER BY ord) FILTER (ord <= 3) AS sources FROM clauses GROUP BY doc_id"


@query(f"WITH {CTE} {SUMMARY_SQL}")
def mk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.summary(clauses(spark, sf_dir))


ASKED = ("Can they stop me joining a competitor?", "How much notice must I give?", "What is my salary in hand?", "Will they pay for insurance of my parents?", "When do I get my original certificates back?")
ASK_PARTS = f"""topics(t, asks, has, status) AS (VALUES {', '.join(f"({k}, {sql_text(a)}, {sql_text(c)}, {sql_text(s)})" for k, (a, c, s, _) in enumerate(M.TOPICS))}),
questions(q, question) AS (VALUES {', '.join(f"({k}, {sql_text(x)})" for k, x in enumerate(ASKED))}), met AS (SELECT q, t, has, status FROM questions JOIN topics ON regexp_matches(question, asks, 'i')),
cand AS (SELECT c.doc_id, met.q, t, status, c.clause_id, {CITE_SQL} AS quote, row_number() OVER (PARTITION BY c.doc_id, met.q ORDER BY t, ord) AS rn FROM clauses AS c JOIN met ON regexp_matches(c.text, has, 'i')),
answers AS (SELECT d.doc_id, questions.q, coalesce(status, 'not_in_document') AS status, clause_id, quote FROM (SELECT DISTINCT doc_id FROM clauses) AS d CROSS JOIN questions LEFT JOIN (SELECT * FROM cand WHERE rn = 1) AS best ON d.doc_id = best.doc_id AND questions.q = best.q)"""
ASK_CTE = f"WITH {CTE}, {ASK_PARTS}"


def topics(text: Column) -> Column:
    """struct by topic: whether a clause speaks of it."""
    return let(F.lower(text), lambda low: F.struct(*[F.coalesce(matches(text, has, True, low), F.lit(False)).alias(f"t{k}") for k, (_, has, _, _) in enumerate(M.TOPICS)]))


def topic_parts(*more: str) -> list[Column]:
    """Aggregates over a document's clauses, from their columns ``topics`` and ``cite`` (the sentence to cite a clause
    with): per topic its first clause, the sentence, and further columns."""
    return [F.min(F.when(F.col("topics")[t], F.struct("ord", "clause_id", F.col("cite").alias("quote"), *more))).alias(t) for t in (f"t{k}" for k in range(len(M.TOPICS)))]


def answered(asked: tuple[str, ...] = ASKED, more: tuple[str, ...] = ()) -> Column:
    """array<struct<q, status, clause_id, quote, ...>> from the columns of ``topic_parts``: per question the first topic
    with a clause. Which topics a question meets is a property of the few questions, so it is settled first."""
    each = []
    for q, text in enumerate(asked):
        met = [k for k, (asks, _, _, _) in enumerate(M.TOPICS) if re.search(asks, text, re.IGNORECASE | re.ASCII)]
        first = F.coalesce(*[F.when(F.col(f"t{k}").isNotNull(), F.struct(F.lit(M.TOPICS[k][2]).alias("status"), F.col(f"t{k}").alias("t"))) for k in met]) if met else None
        field = lambda name: F.lit(None).cast("string") if first is None else first[name] if name == "status" else first["t"][name]  # noqa: B023, E731
        each.append(F.struct(F.lit(q).alias("q"), F.coalesce(field("status"), F.lit("not_in_document")).alias("status"), *(field(n).alias(n) for n in ("clause_id", "quote", *more))))
    return F.array(*each)


def answers(spark: SparkSession, sf_dir: str, asked: tuple[str, ...] = ASKED) -> DataFrame:
    """(doc_id, q, status, clause_id, quote), in one pass per document."""
    rows = once(clauses(spark, sf_dir).select("doc_id", "ord", "clause_id", "text"), topics=topics(F.col("text")), cite=M.cite_from(F.col("text")))
    docs = rows.groupBy("doc_id").agg(*topic_parts())
    return docs.select("doc_id", F.explode(answered(asked)).alias("x")).select("doc_id", "x.*")


@query(f"{ASK_CTE} SELECT doc_id, CAST(q AS INT) AS q, status, clause_id, quote FROM answers")
def mk_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir)


@query(f"{ASK_CTE} SELECT answers.doc_id, CAST(answers.q AS INT) AS q, CASE WHEN length(quote) >= 12 AND contains({T.sql_normalize('text')}, {T.sql_normalize('quote')}) THEN status ELSE 'not_in_document' END AS status FROM answers LEFT JOIN clauses USING (doc_id, clause_id)")
def pp_ask_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer without a presentable citation becomes not_in_document; citations here are exact or nothing."""
    given = answers(spark, sf_dir)
    pairs = V.with_claims(given, clauses(spark, sf_dir))
    done = V.verify_exact(pairs.withColumnRenamed("status", "said"))
    return done.select("doc_id", "q", F.when(F.col("status") == "verified", F.col("said")).otherwise("not_in_document").alias("status"))


PREPARED = ", ".join(f"bool_or({sql_matches('text', w, True)}) AS s{k}" for k, (w, *_) in enumerate(M.SUGGESTIONS))


@query(f"WITH {CTE}, s AS (SELECT doc_id, {PREPARED} FROM clauses GROUP BY doc_id) SELECT doc_id, list, n, line FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS list, {k} AS n, {sql_text(texts[i])} AS line FROM s WHERE s{k}" for k, (_, *texts) in enumerate(M.SUGGESTIONS) for i, name in enumerate(M.LISTS) if texts[i]) + ")")
def mk_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clauses(spark, sf_dir).groupBy("doc_id").agg(*[F.bool_or(matches(F.col("text"), w, True)).alias(f"s{k}") for k, (w, *_) in enumerate(M.SUGGESTIONS)])
    lines = [F.when(F.col(f"s{k}"), F.struct(F.lit(name).alias("list"), F.lit(k).alias("n"), F.lit(texts[i]).alias("line"))) for k, (_, *texts) in enumerate(M.SUGGESTIONS) for i, name in enumerate(M.LISTS) if texts[i]]
    return docs.select("doc_id", F.explode(F.array_compact(F.array(*lines))).alias("x")).select("doc_id", "x.*")


ORDINAL = sql_case("risk", RISKS)


@query(f"{FOUND} SELECT doc_id, arg_max(category, ord) AS category FROM found GROUP BY doc_id")
def agg_last_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("doc_id").agg(F.max_by("category", "ord").alias("category"))


BATCHED = f"{FOUND}, b AS (SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) / 3) AS INT) AS batch, * EXCLUDE (doc_id) FROM clauses)"


@query(f"{BATCHED} SELECT doc_id, clause_id, batch FROM b")
def win_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 3 here (80 in the limits): the position divided by the size."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    return clauses(spark, sf_dir).select("doc_id", "clause_id", F.floor(place / 3).cast("int").alias("batch"))


@query(f"WITH {CTE} SELECT doc_id, arg_min(text, ord) FILTER (category = 'GENERAL') AS overview FROM clauses GROUP BY doc_id")
def agg_first_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    general = F.col("category") == "GENERAL"
    return clauses(spark, sf_dir).groupBy("doc_id").agg(F.min_by(F.when(general, F.col("text")), F.when(general, F.col("ord"))).alias("overview"))


@query(f"WITH {CTE}, o(category, place) AS (VALUES {', '.join(f'({sql_text(c)}, {k})' for k, c in enumerate(CATEGORIES))}) SELECT doc_id, string_agg(category, ',' ORDER BY place) AS present FROM (SELECT DISTINCT doc_id, category FROM clauses) JOIN o USING (category) GROUP BY doc_id")
def agg_present_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = clauses(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("category").alias("has")).where(F.size("has") > 0)
    order = F.array(*[F.lit(c) for c in CATEGORIES])
    return present.select("doc_id", F.array_join(F.filter(order, lambda c: F.array_contains("has", c)), ",").alias("present"))


@query(f"WITH {CTE} SELECT doc_id, clause_id FROM clauses WHERE category IN ('COMPENSATION', 'BENEFITS') AND contains({T.sql_normalize('text')}, {T.sql_normalize(sql_text('  Months '))})")
def vw_clause_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters of the clause list: category and a normalised search."""
    hit = F.contains(T.normalize(F.col("text")), T.normalize(F.lit("  Months ")))
    return clauses(spark, sf_dir).where(F.col("category").isin("COMPENSATION", "BENEFITS") & hit).select("doc_id", "clause_id")


@query(f"WITH {CTE} SELECT doc_id, clause_id, CASE WHEN page IS NULL THEN 'paragraph ' || CAST(ord AS VARCHAR) WHEN page + p % 2 > page THEN 'pages ' || CAST(page AS VARCHAR) || '-' || CAST(page + p % 2 AS VARCHAR) ELSE 'page ' || CAST(page AS VARCHAR) END AS location FROM clauses")
def vw_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("page") + F.col("p") % 2
    where = F.when(F.col("page").isNull(), F.concat(F.lit("paragraph "), "ord")).when(end > F.col("page"), F.concat(F.lit("pages "), "page", F.lit("-"), end)).otherwise(F.concat(F.lit("page "), "page"))
    return clauses(spark, sf_dir).select("doc_id", "clause_id", where.alias("location"))


@query(f"WITH {CTE}, r AS (SELECT doc_id, clause_id, text, CAST(q - 5 AS INT) AS s, CAST(q + s % 20 AS INT) AS e FROM clauses) SELECT doc_id, clause_id, CASE WHEN s >= 0 AND e > s AND s < length(text) THEN left(text, s) || '[' || substr(text, s + 1, least(e, length(text)) - s) || ']' || substr(text, least(e, length(text)) + 1) ELSE text END AS shown FROM r")
def vw_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = (F.col("q") - 5).cast("int"), F.length("text")
    e = F.least((F.col("q") + F.col("s") % 20).cast("int"), n)
    ok = (s >= 0) & ((F.col("q") + F.col("s") % 20) > s) & (s < n)
    text = F.col("text")
    shown = F.concat(F.substring(text, F.lit(1), s), F.lit("["), F.substring(text, s + 1, e - s), F.lit("]"), F.substring(text, e + 1, n))
    return clauses(spark, sf_dir).select("doc_id", "clause_id", F.when(ok, shown).otherwise(text).alias("shown"))


@query(f"{FOUND} SELECT doc_id, 'Dear {{name}}, {{n}} points' AS raw, 'Dear order ' || CAST(doc_id AS VARCHAR) || ', ' || CAST(count(*) AS VARCHAR) || ' points' AS line FROM found GROUP BY doc_id")
def vw_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders filled in from a map."""
    raw = F.lit("Dear {name}, {n} points")
    rows = findings(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    values = F.map_from_arrays(F.array(F.lit("{name}"), F.lit("{n}")), F.array(F.concat(F.lit("order "), "doc_id"), F.col("n").cast("string")))
    filled = F.aggregate(F.map_entries(values), raw, lambda acc, e: F.replace(acc, e["key"], e["value"]))
    return rows.select("doc_id", raw.alias("raw"), filled.alias("line"))


EDGE = r"[^\p{L}\p{M}\p{N}]"


def _at_sql(forms: tuple[str, ...]) -> str:
    """Place (from 1) of the first form in the text; 0 if there is none."""
    pattern = f"(?is)^(.*?(?:^|{EDGE}))({'|'.join(forms)})($|{EDGE})"
    return f"CASE WHEN regexp_matches(text, {sql_text(pattern)}) THEN length(regexp_extract(text, {sql_text(pattern)}, 1)) + 1 ELSE 0 END, length(regexp_extract(text, {sql_text(pattern)}, 2))"


@query(f"""WITH {CTE}, found AS ({' UNION ALL '.join(f"SELECT doc_id, clause_id, {k} AS k, {sql_text(t)} AS term, {_at_sql(forms)} FROM clauses" for k, (t, forms) in enumerate(GLOSSARY.items()))}),
f(doc_id, clause_id, k, term, pos, n) AS (SELECT * FROM found)
SELECT doc_id, clause_id, term, CAST(pos - 1 AS INT) AS start FROM f WHERE pos > 0 AND NOT EXISTS (SELECT 1 FROM f AS g WHERE g.doc_id = f.doc_id AND g.clause_id = f.clause_id AND g.k < f.k AND g.pos > 0 AND g.pos < f.pos + f.n AND f.pos < g.pos + g.n)""")
def vw_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first occurrence of each glossary term in a clause, by boundaries that hold for any script."""
    return clauses(spark, sf_dir).select("doc_id", "clause_id", F.explode(M.glossary(F.col("text"))).alias("x")).select("doc_id", "clause_id", "x.term", "x.start")


@query(f"""WITH {CTE}, found AS ({' UNION ALL '.join(f"SELECT doc_id, clause_id, {k} AS k, {sql_text(t)} AS term, {_at_sql(forms)} FROM clauses" for k, (t, forms) in enumerate(GLOSSARY.items()))}),
f(doc_id, clause_id, k, term, pos, n) AS (SELECT * FROM found),
m AS (SELECT * FROM f WHERE pos > 0 AND NOT EXISTS (SELECT 1 FROM f AS g WHERE g.doc_id = f.doc_id AND g.clause_id = f.clause_id AND g.k < f.k AND g.pos > 0 AND g.pos < f.pos + f.n AND f.pos < g.pos + g.n)),
cut(doc_id, clause_id, begun, ended, term) AS (SELECT doc_id, clause_id, pos, pos + n, term FROM m UNION ALL
  SELECT doc_id, clause_id, coalesce(lag(pos + n) OVER w, 1), pos, NULL FROM m WINDOW w AS (PARTITION BY doc_id, clause_id ORDER BY pos) UNION ALL
  SELECT doc_id, clause_id, coalesce((SELECT max(m.pos + m.n) FROM m WHERE m.doc_id = t.doc_id AND m.clause_id = t.clause_id), 1), length(text) + 1, NULL FROM clauses AS t)
SELECT doc_id, clause_id, CAST(row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY begun) - 1 AS INT) AS place, term, substr(text, CAST(begun AS INT), CAST(ended - begun AS INT)) AS text FROM cut JOIN clauses USING (doc_id, clause_id) WHERE ended > begun""")
def vw_glossary_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause cut at its glossary terms: what is shown, piece by piece."""
    rows = once(clauses(spark, sf_dir).select("doc_id", "clause_id", "text"), marks=M.glossary(F.col("text")))
    return rows.select("doc_id", "clause_id", F.posexplode(M.segments(F.col("text"), F.col("marks"))).alias("place", "x")).select("doc_id", "clause_id", "place", "x.term", "x.text")


@query(f"WITH {CTE} SELECT doc_id, string_agg('[[' || clause_id || CASE WHEN label IS NULL THEN '' ELSE ' | ' || label END || CASE WHEN page IS NULL THEN '' ELSE ' | p' || CAST(page AS VARCHAR) END || ']] ' || {T.sql_sanitize('text')}, chr(10) || chr(10) ORDER BY ord) AS prompt FROM clauses GROUP BY doc_id")
def snk_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).groupBy("doc_id").agg(_prompt().alias("prompt"))


def _prompt():
    label = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit(" | "), "label"))
    page = F.when(F.col("page").isNull(), "").otherwise(F.concat(F.lit(" | p"), "page"))
    line = F.concat(F.lit("[["), "clause_id", label, page, F.lit("]] "), T.sanitize(F.col("text")))
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n\n")


@query(f"WITH {CTE} SELECT doc_id, clause_id, {T.sql_sanitize('text')} AS text FROM clauses")
def src_prompt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse of the prompt: what was written comes back."""
    prompts = clauses(spark, sf_dir).groupBy("doc_id").agg(_prompt().alias("prompt"))
    parts = prompts.select("doc_id", F.explode(F.split("prompt", r"\n\n(?=\[\[)")).alias("part"))
    return parts.select("doc_id", F.regexp_extract("part", r"^\[\[(c\d+)", 1).alias("clause_id"), F.regexp_replace("part", r"^\[\[[^\]]*\]\] ", "").alias("text"))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations WHERE role <> 'system') WHERE rn <= 4")
def limit_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return read(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("rn", rn).where("rn <= 4").select("conv_id", "turn", "text")
