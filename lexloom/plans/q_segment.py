"""Queries of segmentation, over rendered letters and over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.patterns import sql_text as Q
from ..operators import segment as S
from .letters import LINES_CTE, lines
from .registry import query, read

WS = r"'^\s+|\s+$'"
_TITLE = r"""array_to_string(list_transform(string_split(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), ' '), lambda w, i: CASE WHEN i > 1 AND w IN ('a','an','and','as','at','by','for','in','of','on','or','the','to','with') THEN w ELSE array_to_string(list_transform(string_split(w, '-'), lambda p: upper(left(p, 1)) || substr(p, 2)), '-') END), ' ')"""
_LEAD = "CASE WHEN regexp_extract(trim({0}), " + Q(S.LEAD) + ", 1) <> '' AND len(string_split(regexp_extract(trim({0}), " + Q(S.LEAD) + ", 1), ' ')) <= 5 AND NOT regexp_matches(regexp_extract(trim({0}), " + Q(S.LEAD) + ", 1), " + Q(S.VERB) + ", 'i') THEN regexp_extract(trim({0}), " + Q(S.LEAD) + ", 1) END"


def _title(text: str) -> str:
    return _TITLE.replace("{0}", text)


def _lead(text: str) -> str:
    return _LEAD.replace("{0}", text)


KEPT_CTE = f"""WITH {LINES_CTE}, trimmed AS (SELECT doc_id, line_no, page, regexp_replace(text, {WS}, '', 'g') AS text FROM lines),
counted AS (SELECT *, sum(CAST(text = '' AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS blanks FROM trimmed),
kept AS (SELECT doc_id, line_no, page, text, blanks > coalesce(lag(blanks) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS after_blank FROM counted WHERE text <> '' AND NOT regexp_matches(text, {Q(S.NOISE)}, 'i'))"""
HEAD_CTE = f"""{KEPT_CTE}, flags AS (SELECT *, regexp_matches(text, {Q(S.SUB_ITEM)}, 'i') AS sub, regexp_matches(text, {Q(S.NUMBERED)}) AS numbered, regexp_matches(text, {Q(S.NAMED)}, 'i') AS named,
  length(text) BETWEEN 1 AND 80 AND NOT regexp_matches(text, '[a-z]') AND regexp_matches(text, '[A-Z]') AND len(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) <= 8 AS caps FROM kept),
heads AS (SELECT doc_id, line_no, page, text, after_blank, NOT sub AND (numbered OR named OR caps) AS is_heading, NOT sub AND NOT numbered AND NOT named AND caps AS is_title,
  CASE WHEN sub THEN NULL WHEN numbered THEN regexp_replace(regexp_extract(text, {Q(S.NUMBERED)}, 1), '[.)]$', '') WHEN named THEN upper(left(regexp_extract(text, {Q('(?i)' + S.NAMED)}, 1), 1)) || lower(substr(regexp_extract(text, {Q('(?i)' + S.NAMED)}, 1), 2)) || ' ' || regexp_extract(text, {Q('(?i)' + S.NAMED)}, 2) END AS label,
  CASE WHEN sub THEN NULL WHEN numbered THEN {_lead(f"regexp_extract(text, {Q(S.NUMBERED)}, 2)")} WHEN named THEN {_lead(f"regexp_extract(text, {Q('(?i)' + S.NAMED)}, 3)")} WHEN caps THEN {_title("text")} END AS heading FROM flags)"""
BLOCK_CTE = f"""{HEAD_CTE}, begun AS (SELECT *, CAST(is_heading OR row_number() OVER w = 1 OR (after_blank AND NOT coalesce(lag(is_title) OVER w, false)) AS INT) AS start FROM heads WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
numbered_lines AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM begun),
blocks AS (SELECT doc_id, block, arg_min(label, line_no) FILTER (start = 1) AS label, arg_min(heading, line_no) FILTER (start = 1) AS heading, trim(regexp_replace(string_agg(text, ' ' ORDER BY line_no) FILTER (NOT is_title), '\\s+', ' ', 'g')) AS text,
  count(*) FILTER (NOT is_title) AS n_lines, min(page) FILTER (NOT is_title) AS page, max(page) FILTER (NOT is_title) AS page_end FROM numbered_lines GROUP BY doc_id, block HAVING count(*) FILTER (NOT is_title) > 0)"""
FOLD_CTE = f"""{BLOCK_CTE}, rests AS (SELECT *, lead(label) OVER (PARTITION BY doc_id ORDER BY block) AS nxt, CASE WHEN lower(left(text, length(label))) = lower(label) THEN regexp_replace(substr(text, length(label) + 1), '^[.):]?\\s*', '') ELSE text END AS rest FROM blocks),
titled AS (SELECT *, CASE WHEN label IS NOT NULL AND coalesce(starts_with(nxt, label || '.'), false) AND n_lines = 1 AND length(rest) BETWEEN 1 AND 80 AND NOT regexp_matches(rest, '[.;:!?]$') AND len(string_split(rest, ' ')) <= 8
  THEN CASE WHEN NOT regexp_matches(rest, '[a-z]') THEN {_title("rest")} ELSE rest END END AS title FROM rests),
sections AS (SELECT *, sum(CAST(title IS NOT NULL AS INT)) OVER (PARTITION BY doc_id ORDER BY block) AS section FROM titled),
owners AS (SELECT doc_id, section, max(label) AS of, max(title) AS named FROM sections WHERE title IS NOT NULL GROUP BY doc_id, section),
walked AS (SELECT s.*, o.of, o.named, max(CAST(coalesce(s.title IS NULL AND s.label IS NOT NULL AND NOT starts_with(s.label, o.of || '.'), false) AS INT)) OVER (PARTITION BY s.doc_id, s.section ORDER BY s.block) AS gone FROM sections AS s LEFT JOIN owners AS o ON s.doc_id = o.doc_id AND s.section = o.section),
folded AS (SELECT doc_id, block, label, CASE WHEN gone = 0 AND named IS NOT NULL AND label IS NOT NULL AND heading IS NULL THEN named ELSE heading END AS heading, text, n_lines, page, page_end FROM walked WHERE title IS NULL)"""
MERGE_CTE = f"""{FOLD_CTE}, ups AS (SELECT *, label IS NULL AND heading IS NULL AND length(text) < 200 AND (length(text) < 60 OR NOT regexp_matches(text, {Q('(?s)' + S.SENTENCE.replace('[' + chr(92) + 's' + chr(92) + 'S]', '.'))})) AND row_number() OVER (PARTITION BY doc_id ORDER BY block) > 1 AS up FROM folded),
islands AS (SELECT *, sum(CAST(NOT up AS INT)) OVER (PARTITION BY doc_id ORDER BY block) AS island FROM ups),
merged AS (SELECT doc_id, island, arg_min(label, block) FILTER (NOT up) AS label, arg_min(heading, block) FILTER (NOT up) AS heading, string_agg(text, ' ' ORDER BY block) AS text, min(page) AS page, max(page_end) AS page_end FROM islands GROUP BY doc_id, island),
segmented AS (SELECT doc_id, 'c' || lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') AS clause_id, CAST(row_number() OVER w - 1 AS INT) AS ord, label, heading, text, page, page_end FROM merged WINDOW w AS (PARTITION BY doc_id ORDER BY island))"""


@query("SELECT doc_id, CAST(i - 1 AS INT) AS line_no, regexp_split_to_array(text, '\\r?\\n')[i] AS line FROM documents, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS u(i)")
def src_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


@query(f"{KEPT_CTE} SELECT doc_id, CAST(line_no AS INT) AS line_no, text FROM kept")
def seg_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kept_lines(lines(spark, sf_dir)).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "text")


@query(f"{HEAD_CTE} SELECT doc_id, CAST(line_no AS INT) AS line_no, label, is_heading, is_title FROM heads")
def seg_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.headings(S.kept_lines(lines(spark, sf_dir))).select("doc_id", F.col("line_no").cast("int").alias("line_no"), "label", "is_heading", "is_title")


@query(f"{HEAD_CTE} SELECT doc_id, CAST(line_no AS INT) AS line_no, heading FROM heads WHERE heading IS NOT NULL")
def seg_lead_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.headings(S.kept_lines(lines(spark, sf_dir))).where("heading is not null").select("doc_id", F.col("line_no").cast("int").alias("line_no"), "heading")


@query(f"{BLOCK_CTE} SELECT doc_id, CAST(block AS BIGINT) AS block, label, heading, text, CAST(n_lines AS INT) AS n_lines FROM blocks")
def seg_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(lines(spark, sf_dir)).select("doc_id", "block", "label", "heading", "text", "n_lines")


@query(f"{FOLD_CTE} SELECT doc_id, CAST(block AS BIGINT) AS block, label, heading, text FROM folded")
def seg_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fold_sections(S.blocks(lines(spark, sf_dir))).select("doc_id", "block", "label", "heading", "text")


@query(f"{MERGE_CTE} SELECT doc_id, CAST(island AS BIGINT) AS island, label, heading, text FROM merged")
def seg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_fragments(S.fold_sections(S.blocks(lines(spark, sf_dir)))).select("doc_id", "island", "label", "heading", "text")


@query(f"{MERGE_CTE} SELECT doc_id, clause_id, ord, label, heading, text, page, page_end FROM segmented WHERE ord < 400")
def seg_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.segment(lines(spark, sf_dir))


SPLIT_SQL = """WITH RECURSIVE cuts AS (
  SELECT doc_id, 0 AS k, CAST('' AS VARCHAR) AS part, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS rest FROM documents
  UNION ALL
  SELECT doc_id, k + 1, trim(left(rest, cut)), trim(substr(rest, cut + 1)) FROM (
    SELECT doc_id, k, rest, CAST(CASE WHEN length(rest) <= 4000 THEN length(rest) WHEN e > 2000 THEN e + 1 ELSE 4000 END AS BIGINT) AS cut FROM (
      SELECT doc_id, k, rest, greatest(CASE WHEN contains(w, '. ') THEN length(w) - instr(reverse(w), ' .') - 1 ELSE -1 END, CASE WHEN contains(w, '; ') THEN length(w) - instr(reverse(w), ' ;') - 1 ELSE -1 END, CASE WHEN contains(w, '? ') THEN length(w) - instr(reverse(w), ' ?') - 1 ELSE -1 END) AS e
      FROM (SELECT doc_id, k, rest, left(rest, 4000) AS w FROM cuts WHERE length(rest) > 0)))
)"""


@query(f"{SPLIT_SQL} SELECT doc_id, CAST(k - 1 AS INT) AS k, part FROM cuts WHERE k > 0")
def seg_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(S.split_long(flat)).alias("k", "part"))


@query(f"{MERGE_CTE} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) > 1500 AS too_much FROM segmented GROUP BY doc_id")
def seg_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum(F.length("text"))
    return S.segment(lines(spark, sf_dir)).groupBy("doc_id").agg(total.alias("chars"), (total > 1500).alias("too_much"))


@query(f"{MERGE_CTE} SELECT doc_id, CAST(min(page) AS INT) AS page, CAST(max(page_end) AS INT) AS page_end FROM segmented GROUP BY doc_id")
def agg_min_max_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_range(lines(spark, sf_dir))


@query(f"{FOLD_CTE} SELECT doc_id, CAST(block AS BIGINT) AS block, nxt AS next_label FROM rests")
def win_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks(lines(spark, sf_dir)).select("doc_id", "block", F.lead("label").over(Window.partitionBy("doc_id").orderBy("block")).alias("next_label"))


@query(f"{FOLD_CTE} SELECT doc_id, CAST(block AS BIGINT) AS block, named FROM walked")
def win_running_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.blocks(lines(spark, sf_dir))
    order = Window.partitionBy("doc_id").orderBy("block")
    label, text = F.col("label"), F.col("text")
    rest = F.regexp_replace(F.substring(text, F.length(label) + 1, F.length(text)), r"^[.):]?\s*", "")
    titled = F.startswith(F.lead("label").over(order), F.concat(label, F.lit("."))) & (F.col("n_lines") == 1) & F.length(rest).between(1, 80) & ~rest.rlike(r"[.;:!?]\z") & (S.words_in(rest) <= 8)
    title = F.when(titled, F.when(~rest.rlike("[a-z]"), S.title_case(rest)).otherwise(rest))
    return found.withColumn("title", title).select("doc_id", "block", F.last("title", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("named"))


@query(f"SELECT doc_id, length(text) AS chars, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > {LIMITS.clause_chars * 4} THEN 'too_much_text' ELSE 'ok' END AS status FROM documents")
def src_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text branch of the parser: a tagged result per document, failures as rows."""
    n = F.length("text")
    status = F.when(F.trim("text") == "", "empty").when(n > LIMITS.clause_chars * 4, "too_much_text").otherwise("ok")
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("chars"), status.alias("status"))


@query(f"""{MERGE_CTE}, sized AS (SELECT doc_id, count(*) AS n, sum(length(text)) AS chars FROM segmented WHERE ord < {LIMITS.clauses} GROUP BY doc_id), l AS (SELECT DISTINCT doc_id FROM lines)
SELECT l.doc_id, CASE WHEN n IS NULL THEN 'NO_TEXT' WHEN chars > {LIMITS.total_chars} THEN 'TOO_MUCH_TEXT' END AS reason, CAST(coalesce(n, 0) AS BIGINT) AS clauses, CAST(coalesce(chars, 0) AS BIGINT) AS chars FROM l LEFT JOIN sized USING (doc_id)""")
def src_parse_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parsing comes to: clauses and their characters, or the reason why there are none to work with."""
    given = lines(spark, sf_dir)
    return S.parsed(given.select("doc_id").distinct(), S.segment(given))
