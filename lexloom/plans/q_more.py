"""Queries of sources and sinks, stateful limits, validation, evaluation, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LIMITS, ROUTES
from ..functions import text as T
from ..functions.patterns import sql_text
from ..operators import responder as M
from ..operators.catalog import CATEGORIES
from ..operators.rules import run_rules
from ..operators.selection import nearest_rank
from ..sources import files
from ..streaming import caches, limits
from .contracts import CTE, clauses
from .q_respond import FOUND, findings
from .q_rules import GAPS_CTE, HITS_CTE
from .registry import query, read

# ---------------------------------------------------------------- sources and sinks



@query("""WITH w AS (SELECT doc_id, CAST(i AS BIGINT) AS i, string_split(text, ' ')[i] || ' ' AS str FROM documents, unnest(range(1, len(string_split(text, ' ')) + 1)) AS u(i)),
items AS (SELECT doc_id, CAST(floor((i - 1) / 300) AS INT) + 1 AS page, i, str, i % 17 = 0 AS eol, CAST(floor(i / 9) AS DOUBLE) * 3 AS y FROM w),
b AS (SELECT *, CAST(coalesce(lag(eol) OVER o, false) OR coalesce(abs(y - lag(y) OVER o) > 2, false) AS INT) AS br FROM items WINDOW o AS (PARTITION BY doc_id, page ORDER BY i)),
l AS (SELECT *, sum(br) OVER (PARTITION BY doc_id, page ORDER BY i) AS line FROM b),
t AS (SELECT doc_id, page, line, trim(regexp_replace(string_agg(str, '' ORDER BY i), '\\s+', ' ', 'g')) AS text FROM l GROUP BY doc_id, page, line)
SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY line) AS INT) AS line_no, text FROM t WHERE text <> ''""")
def src_pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from positioned items; the items are the words of documents on an invented grid."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    i = (F.col("p") + 1).cast("long")
    items = words.select("doc_id", (F.floor((i - 1) / 300) + 1).cast("int").alias("page"), i.alias("i"), F.concat("w", F.lit(" ")).alias("str"), (i % 17 == 0).alias("eol"), (F.floor(i / 9).cast("double") * 3).alias("y"))
    return files.lines_from_items(items)


@query("""WITH p AS (SELECT doc_id, CAST(floor((i - 1) / 300) AS INT) AS page, length(string_split(text, ' ')[i]) AS n FROM documents, unnest(range(1, len(string_split(text, ' ')) + 1)) AS u(i))
SELECT doc_id, sum(n)::DOUBLE / count(DISTINCT page) AS per_page, sum(n)::DOUBLE / count(DISTINCT page) < 100 AS scanned, count(DISTINCT page) > 40 AS truncated FROM p GROUP BY doc_id""")
def src_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("p", "w"))
    pages = words.groupBy("doc_id", F.floor(F.col("p") / 300).alias("page")).agg(F.sum(F.length("w")).alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))
    share = F.col("n").cast("double") / F.col("pages")
    return pages.select("doc_id", share.alias("per_page"), (share < LIMITS.scanned_chars_per_page).alias("scanned"), (F.col("pages") > LIMITS.pages).alias("truncated"))


@query("""SELECT page_id, CASE WHEN octet_length(encode(html)) = 0 THEN 'EMPTY' WHEN lower(regexp_extract(url, '\\.([^./]*)$', 1)) NOT IN ('pdf', 'docx', 'txt') THEN 'UNSUPPORTED_TYPE' ELSE 'CONTENT_MISMATCH' END AS reason, regexp_matches(left(html, 512), '[\\x00-\\x08\\x0e-\\x1f]') AS looks_binary FROM pages""")
def src_file_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("html").cast("binary")
    rows = read(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"), F.octet_length("html").cast("long").alias("length"), content.alias("content"))
    return files.guard(rows).select("page_id", F.coalesce("reason", F.lit("CONTENT_MISMATCH")).alias("reason"), files.looks_binary(F.col("content")).alias("looks_binary"))


@query("SELECT page_id, regexp_matches(left(html, 512) || chr(CAST(page_id % 32 + 1 AS INT)), '[\\x00-\\x08\\x0e-\\x1f]') AS looks_binary FROM pages WHERE octet_length(encode(left(html, 511))) = 511")
def src_binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").where(F.octet_length(F.left("html", F.lit(511))) == 511)
    probe = F.concat(F.substring(F.decode(F.col("html").cast("binary"), "UTF-8"), 1, 511), F.chr(F.col("page_id") % 32 + 1))
    return rows.select("page_id", (files.looks_binary(probe.cast("binary")) | F.left("html", F.lit(512)).rlike(r"[\x00-\x08\x0e-\x1f]")).alias("looks_binary"))


@query()
def src_binary_sniff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's own bytes, whatever its length; tested by brute force."""
    return read(spark, sf_dir, "pages").select("page_id", files.looks_binary(F.col("html").cast("binary")).alias("looks_binary"))


@query("SELECT event_id, json_valid(props) AS valid, length(props) <= 40 AS fits FROM events")
def src_json_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies parse or are refused as a whole, and have a size cap."""
    return read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), (F.length("props") <= 40).alias("fits"))


@query(f"SELECT page_id, octet_length(encode(html)) <= {LIMITS.body_bytes // 64} AS fits FROM pages")
def src_size_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", (F.octet_length("html") <= LIMITS.body_bytes // 64).alias("fits"))


@query(f"""{GAPS_CTE} SELECT doc_id, '# Checklist for ' || CAST(doc_id AS VARCHAR) || chr(10) || string_agg('- ' || question, chr(10) ORDER BY gap_id) AS sheet FROM gaps GROUP BY doc_id""")
def snk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rules import find_gaps

    lines = F.transform(F.sort_array(F.collect_list(F.struct("gap_id", "question"))), lambda x: F.concat(F.lit("- "), x["question"]))
    made = find_gaps(clauses(spark, sf_dir)).groupBy("doc_id").agg(lines.alias("lines"))
    return made.select("doc_id", F.concat(F.lit("# Checklist for "), "doc_id", F.lit("\n"), F.array_join("lines", "\n")).alias("sheet"))


#: (reason, status, retryable)
ERRORS = (("EMPTY", 400, False), ("TOO_LARGE", 413, False), ("UNSUPPORTED_TYPE", 415, False), ("CONTENT_MISMATCH", 415, False), ("RATE_LIMITED", 429, True), ("MODEL_FAILED", 502, True))


@query(f"WITH e(reason, status, retryable) AS (VALUES {', '.join(f'({sql_text(r)}, {s}, {b})' for r, s, b in ERRORS)}), p AS (SELECT page_id, CASE page_id % 7 " + " ".join(f"WHEN {k} THEN {sql_text(r)}" for k, (r, _, _) in enumerate(ERRORS)) + " END AS reason FROM pages) SELECT page_id, reason, coalesce(status, 500) AS status, coalesce(retryable, false) AS retryable FROM p LEFT JOIN e USING (reason)")
def err_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.broadcast(spark.createDataFrame(ERRORS, "reason string, status int, retryable boolean"))
    names = F.array(*[F.lit(r) for r, _, _ in ERRORS])
    rows = read(spark, sf_dir, "pages").select("page_id", F.get(names, (F.col("page_id") % 7).cast("int")).alias("reason"))
    return rows.join(table, "reason", "left").select("page_id", "reason", F.coalesce("status", F.lit(500)).alias("status"), F.coalesce("retryable", F.lit(False)).alias("retryable"))


@query("""SELECT event_id, '{"id":' || CAST(event_id AS VARCHAR) || ',"type":"' || event_type || '"}' AS body FROM events""")
def snk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("body"))


@query("SELECT regexp_extract('```json' || chr(10) || props || chr(10) || '```', '(?s)^```(?:json)?\\s*(.*?)\\s*```$', 1) AS body, event_id FROM events")
def val_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return read(spark, sf_dir, "events").select(F.regexp_extract(fenced, r"(?s)^```(?:json)?\s*(.*?)\s*```\z", 1).alias("body"), "event_id")


# ---------------------------------------------------------------- limits and state

HOUR = 3600
#: Events stand for requests; their type names the route.
ROUTE_OF = "CASE event_id % 5 WHEN 0 THEN 'session' WHEN 1 THEN 'analyze' WHEN 2 THEN 'ask' WHEN 3 THEN 'compare' ELSE 'prepare' END"
ROUTE_SQL = "routes(route, most, secs) AS (VALUES " + ", ".join(f"({sql_text(r)}, {n}, {s})" for r, (n, s) in ROUTES.items()) + ")"


@query(f"""WITH {ROUTE_SQL}, e AS (SELECT event_id, event_type, ts, {ROUTE_OF} AS route FROM events),
r AS (SELECT event_id, route, most, CAST(floor(epoch(ts) / secs) * secs AS BIGINT) AS w, secs, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY route, event_type, floor(epoch(ts) / secs) ORDER BY ts, event_id) AS n FROM e JOIN routes USING (route))
SELECT event_id, route, n <= most AS allowed, CAST(greatest(0, most - n) AS INT) AS remaining, w + secs - t AS reset_seconds FROM r""")
def st_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows by route and client (the event's type), with each route's own limit."""
    table = F.broadcast(spark.createDataFrame([(r, n, s) for r, (n, s) in ROUTES.items()], "route string, most int, secs int"))
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("route", F.expr(ROUTE_OF)).join(table, "route")
    return limits.rate_limit(events, ["route", "event_type"], F.col("most"), F.col("secs"), ["ts", "event_id"]).select("event_id", "route", "allowed", "remaining", "reset_seconds")


@query(f"""WITH r AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(ts) / {HOUR}) * {HOUR} AS BIGINT) AS w, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / {HOUR}) ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, CASE WHEN n > 1 THEN w + {HOUR} - t END AS retry_after FROM r""")
def st_rate_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = limits.rate_limit(events, ["user_id"], 1, HOUR, ["ts", "event_id"])
    return rows.select("event_id", F.when(~F.col("allowed"), F.col("reset_seconds")).alias("retry_after"))


#: Tokens by event: a secret missing, not two parts, a signature or a payload that does not decode, a wrong signature,
#: a time that has run out, another network. The first that holds is the verdict; signatures themselves are not made here.
TOKEN = {
    "NO_SECRET": "event_id % 97 = 0", "MALFORMED": "event_id % 11 = 0", "BAD_SIGNATURE": "event_id % 13 = 0", "EXPIRED": "{age} >= 1800", "WRONG_IP": "event_id % 17 = 0",
}
VERDICT_SQL = "CASE " + " ".join(f"WHEN {c} THEN {sql_text(v)}" for v, c in TOKEN.items()) + " ELSE 'OK' END"


@query(f"""WITH s AS (SELECT user_id, event_id, ts, first_value(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS began FROM events)
SELECT event_id, {VERDICT_SQL.replace('{age}', '(epoch(ts) - epoch(began))')} AS verdict FROM s""")
def st_session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's first event opens a session of 30 minutes; the verdict of every later token, in the order of the checks."""
    events = read(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    began = F.first("at").over(Window.partitionBy("user_id", F.to_date("at")).orderBy("at", "event_id"))
    aged = events.withColumn("age", (F.unix_micros(F.col("at")) - F.unix_micros(began)) / 1e6)
    return aged.select("event_id", F.expr(VERDICT_SQL.replace("{age}", "age")).alias("verdict"))


TTL = 86_400
KEPT = "event_id % 4 <> 0"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, ts, {KEPT} AS keep, sha256(event_type || '|' || CAST(user_id % 50 AS VARCHAR)) AS request, row_number() OVER (PARTITION BY event_type, user_id % 50 ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT request, k, event_id, false AS hit, CASE WHEN keep THEN ts + INTERVAL {TTL} SECOND END AS until FROM e WHERE k = 1
  UNION ALL SELECT e.request, e.k, e.event_id, coalesce(w.until > e.ts, false), CASE WHEN coalesce(w.until > e.ts, false) THEN w.until WHEN keep THEN e.ts + INTERVAL {TTL} SECOND END FROM walk AS w JOIN e ON e.request = w.request AND e.k = w.k + 1)
SELECT event_id, request, hit FROM walk""")
def st_cache_lru_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests a cache answers: equal ones within the lifetime of an answer that was kept (failures are not)."""
    events = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.sha2(F.expr("event_type || '|' || CAST(user_id % 50 AS STRING)"), 256).alias("request"))
    return limits.answer_cache(events, F.col("request"), F.expr(KEPT), TTL).select("event_id", "request", "hit")


#: What a request asks for, among few things; and a server process that serves some of the users.
ASKS = "event_type || '|' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 AS {text})"
ENTRIES, LIFE_DAYS, LAST = 64, 10, 8
PROCESS_ASKS = "event_type || '|' || CAST(user_id AS {text}) || '|' || CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 8 AS {text})"


@query(f"""WITH e AS (SELECT event_id, user_id, {ASKS.format(text='VARCHAR')} AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT *, lag(i) OVER (PARTITION BY user_id, key ORDER BY i) AS before FROM e)
SELECT p.event_id, CASE WHEN p.before IS NOT NULL THEN CAST(count(DISTINCT b.key) AS BIGINT) END AS distance, p.before IS NOT NULL AND count(DISTINCT b.key) < {LAST} AS hit
FROM p LEFT JOIN e AS b ON b.user_id = p.user_id AND b.i > p.before AND b.i < p.i GROUP BY p.event_id, p.before""")
def st_client_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visit's last 8 answers: which requests they answer, by the number of other requests since the same one."""
    rows = caches.reuse_distance(read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"), F.col("user_id"), F.expr(ASKS.format(text="STRING")), ["ts", "event_id"])
    return rows.select("event_id", "distance", (F.coalesce("distance", F.lit(LAST)) < LAST).alias("hit"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, ts, {KEPT} AS keep, {PROCESS_ASKS.format(text='VARCHAR')} AS key, user_id % 50 AS process, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS k FROM events),
walk AS (SELECT process, k, event_id, false AS hit, CASE WHEN keep THEN [{{'key': key, 'until': ts + INTERVAL {LIFE_DAYS} DAY}}] ELSE [] END AS held FROM e WHERE k = 1
  UNION ALL SELECT process, k, event_id, hit, CASE WHEN hit THEN list_concat(rest, own) WHEN keep THEN list_concat(rest, new)[-{ENTRIES}:] ELSE list_filter(list_concat(rest, new)[-{ENTRIES}:], lambda x: x.key <> key) END FROM
    (SELECT *, len(own) > 0 AND own[1].until > ts AS hit FROM (SELECT e.process, e.k, e.event_id, e.ts, e.keep, e.key, list_filter(w.held, lambda x: x.key = e.key) AS own, list_filter(w.held, lambda x: x.key <> e.key) AS rest, [{{'key': e.key, 'until': e.ts + INTERVAL {LIFE_DAYS} DAY}}] AS new
      FROM walk AS w JOIN e ON e.process = w.process AND e.k = w.k + 1)))
SELECT event_id, hit FROM walk""")
def st_cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A process's answer cache: 64 entries, the least recently used goes, with a lifetime; failures are not kept."""
    events = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "props")
    rows = caches.answer_cache(events, F.col("user_id") % 50, F.expr(PROCESS_ASKS.format(text="STRING")), F.expr(KEPT), ENTRIES, LIFE_DAYS * 86_400, ["ts", "event_id"])
    return rows.select("event_id", "hit")


@query("""WITH c AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) > 1 AS free FROM events),
u AS (SELECT event_id, free, sum(CAST(NOT free AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS used FROM c) SELECT event_id, CAST(used AS BIGINT) AS used, free OR used <= 30 AS allowed FROM u""")
def st_call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    seen = events.withColumn("free", F.row_number().over(Window.partitionBy("user_id", "event_type", "props").orderBy("ts", "event_id")) > 1)
    return limits.call_budget(seen, ["user_id"], ["ts", "event_id"], LIMITS.calls_per_visit, F.col("free")).select("event_id", "used", "allowed")


#: Outcomes of one call's attempts, by digits of the event: 0 to 4 answered, 5 no valid JSON, 6 a passing fault, 7 the
#: thinking hint refused (tried again for nothing, twice at most), 8 blocked, 9 quota. Two attempts, then one repair.
ATTEMPTS = ["event_id % 10", "CAST(floor(event_id / 10) AS BIGINT) % 10", "CAST(floor(event_id / 100) AS BIGINT) % 10", "CAST(floor(event_id / 1000) AS BIGINT) % 10", "CAST(floor(event_id / 7) AS BIGINT) % 10"]
CODES = {"5": "MODEL_INVALID_OUTPUT", "6": "INTERNAL", "8": "MODEL_BLOCKED", "9": "RATE_LIMITED"}


def _ladder_sql() -> str:
    """CASE over the attempts: state (attempt left, hints left) unrolled; at most five calls."""

    def step(k: int, tries: int, hints: int, last: str | None) -> str:
        if tries == 0:
            if last == "5":
                return f"CASE WHEN a{k} < 5 THEN 'ok' ELSE '{CODES['5']}' END"
            return f"'{CODES[last]}'"
        refused = step(k + 1, tries, hints - 1, last) if hints else f"'{CODES['6']}'"
        return f"CASE WHEN a{k} < 5 THEN 'ok' WHEN a{k} = 8 THEN '{CODES['8']}' WHEN a{k} = 9 THEN '{CODES['9']}' WHEN a{k} = 7 THEN {refused} WHEN a{k} = 5 THEN {step(k + 1, tries - 1, hints, '5')} ELSE {step(k + 1, tries - 1, hints, '6')} END"

    return step(0, 2, 2, None)


LADDER_SQL = _ladder_sql()


@query(f"SELECT event_id, {LADDER_SQL} AS outcome FROM (SELECT event_id, {', '.join(f'{a} AS a{k}' for k, a in enumerate(ATTEMPTS))} FROM events)")
def st_model_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a call comes to, as a fold over its attempts."""
    a = read(spark, sf_dir, "events").select("event_id", F.array(*[F.expr(x).cast("int") for x in ATTEMPTS]).alias("a"))
    start = F.struct(F.lit(2).alias("tries"), F.lit(2).alias("hints"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("done"))

    def step(s, x):
        def next_(tries, hints, last, done):
            return F.struct(tries.alias("tries"), hints.alias("hints"), last.cast("string").alias("last"), done.cast("string").alias("done"))

        none = F.lit(None)
        repair = next_(s["tries"], s["hints"], s["last"], F.when(x < 5, "ok").otherwise(F.lit(CODES["5"])))
        call = (
            F.when(x < 5, next_(s["tries"], s["hints"], s["last"], F.lit("ok"))).when(x == 8, next_(s["tries"], s["hints"], s["last"], F.lit(CODES["8"])))
            .when(x == 9, next_(s["tries"], s["hints"], s["last"], F.lit(CODES["9"])))
            .when(x == 7, F.when(s["hints"] > 0, next_(s["tries"], s["hints"] - 1, s["last"], none)).otherwise(next_(s["tries"], s["hints"], s["last"], F.lit(CODES["6"]))))
            .otherwise(next_(s["tries"] - 1, s["hints"], F.when(x == 5, "5").otherwise("6"), none))
        )
        return F.when(s["done"].isNotNull(), s).when(s["tries"] > 0, call).when(s["last"] == "5", repair).otherwise(next_(s["tries"], s["hints"], s["last"], F.lit(CODES["6"])))

    end = F.aggregate("a", start, step)
    left = F.when(end["last"] == "5", CODES["5"]).otherwise(CODES["6"])
    return a.select("event_id", F.coalesce(end["done"], left).alias("outcome"))


NOW = "2024-01-20 00:00:00"
OP = "CASE WHEN event_id % 9 = 0 THEN 'delete' ELSE 'put' END"
LIFE = "CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 5 + 1 AS BIGINT) * 86400 END"


@query(f"""WITH c AS (SELECT event_type, user_id, event_id, ts, value, {OP} AS op, {LIFE} AS ttl, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '{NOW}')
SELECT event_type, user_id, value, event_id FROM c WHERE rn = 1 AND op = 'put' AND (ttl IS NULL OR ts + to_seconds(ttl) > TIMESTAMP '{NOW}')""")
def src_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key-value store as a table of changes: puts with and without a lifetime, and deletes."""
    events = read(spark, sf_dir, "events").where(f"ts <= TIMESTAMP_NTZ '{NOW}'")
    changes = events.select("event_type", "user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.expr(OP).alias("op"), F.expr(LIFE).alias("ttl"))
    return limits.kv_state(changes, ["event_type", "user_id"], F.lit(NOW).cast("timestamp")).withColumnRenamed("id", "event_id")


# ---------------------------------------------------------------- validation

@query(f"{HITS_CTE} SELECT doc_id, CAST(count(*) AS BIGINT) AS hits, bool_and(starts_with(rule_id, 'IN-EMP-') AND severity IN ('HIGH', 'MEDIUM', 'LOW', 'INFO')) AS valid FROM hits GROUP BY doc_id")
def val_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.startswith("rule_id", F.lit("IN-EMP-")) & F.col("severity").isin("HIGH", "MEDIUM", "LOW", "INFO")
    return run_rules(clauses(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("hits"), F.bool_and(ok).alias("valid"))


@query(f"WITH {CTE} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS chars, sum(length(text)) <= 500 AS fits FROM clauses GROUP BY doc_id")
def agg_sum_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sum(F.length("text"))
    return clauses(spark, sf_dir).groupBy("doc_id").agg(n.alias("chars"), (n <= 500).alias("fits"))


@query("SELECT l_orderkey AS doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS ids FROM lineitem GROUP BY l_orderkey HAVING count(*) > count(DISTINCT l_linenumber)")
def agg_distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose line numbers repeat."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"), F.countDistinct("l_linenumber").alias("ids"))
    return rows.where("n > ids")


@query(f"WITH {CTE}, w AS (SELECT doc_id, unnest({T.sql_tokens(T.sql_normalize('text'))}) AS w FROM clauses) SELECT doc_id, w AS word, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY doc_id, w")
def agg_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = clauses(spark, sf_dir).select("doc_id", F.explode(T.tokens(T.normalize(F.col("text")))).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- evaluation

SHARES = {"p50": 0.5, "p95": 0.95}


@query("SELECT event_type, CAST(quantile_disc(value, 0.5) AS DOUBLE) AS p50, CAST(quantile_disc(value, 0.95) AS DOUBLE) AS p95 FROM events GROUP BY event_type")
def agg_percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles."""
    return nearest_rank(read(spark, sf_dir, "events"), ["event_type"], "value", SHARES)


@query(f"SELECT {ROUTE_OF} AS route, CAST(quantile_disc(CAST(round(value * 1000) AS BIGINT), 0.5) AS BIGINT) AS p50, CAST(quantile_disc(CAST(round(value * 1000) AS BIGINT), 0.95) AS BIGINT) AS p95 FROM events WHERE {ROUTE_OF} IN ('analyze', 'ask') GROUP BY 1")
def ev_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies of the two routes that a run is timed by, in milliseconds: nearest-rank median and 95th percentile."""
    timed = read(spark, sf_dir, "events").select(F.expr(ROUTE_OF).alias("route"), F.round(F.col("value") * 1000).cast("long").alias("ms"))
    return nearest_rank(timed.where(F.col("route").isin("analyze", "ask")), ["route"], "ms", SHARES)


@query("SELECT lang, CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS BIGINT) AS hit, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS total, count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE / nullif(count(*) FILTER (toxic = 1), 0) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def agg_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    hit, total = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)), F.count_if(F.col("toxic") == 1)
    return rows.groupBy("lang").agg(hit.alias("hit"), total.alias("total"), F.try_divide(hit, total).alias("rate"))


@query(f"WITH {CTE}, e AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 7 + 1 AS VARCHAR) || '.1' AS label FROM orders) SELECT e.doc_id, e.label, min(clause_id) AS clause_id FROM e JOIN clauses USING (doc_id, label) GROUP BY e.doc_id, e.label")
def join_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected labels joined to clauses."""
    expected = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat((F.col("o_orderkey") % 7 + 1).cast("string"), F.lit(".1")).alias("label"))
    return expected.join(clauses(spark, sf_dir).select("doc_id", "label", "clause_id"), ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min("clause_id").alias("clause_id"))


# ---------------------------------------------------------------- sets

LINES = "SELECT conv_id, 0 AS src, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, 1, turn, text FROM conversations WHERE role = 'assistant'"


@query(f"WITH u AS ({LINES}) SELECT conv_id, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY src, turn) AS INT) AS place FROM u")
def set_union_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _union(spark, sf_dir).select("conv_id", "text", F.row_number().over(Window.partitionBy("conv_id").orderBy("src", "turn")).alias("place"))


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    part = lambda role, k: rows.where(F.col("role") == role).select("conv_id", F.lit(k).alias("src"), "turn", "text")
    return part("user", 0).unionByName(part("assistant", 1))


@query(f"WITH u AS ({LINES}), k AS (SELECT *, regexp_replace(lower(text), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g') AS key FROM u WHERE trim(text) <> ''), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, key ORDER BY src, turn) AS rn FROM k) SELECT conv_id, trim(text) AS text FROM f WHERE rn = 1")
def set_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First wins, by letters, marks and digits without case; the original spelling is kept."""
    keyed = _union(spark, sf_dir).where(F.trim("text") != "").withColumn("key", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}\p{N}]", ""))
    first = F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("src", "turn"))
    return keyed.withColumn("rn", first).where("rn = 1").select("conv_id", F.trim("text").alias("text"))


@query(f"{FOUND}, s AS (SELECT doc_id, list(DISTINCT category) AS has FROM found GROUP BY doc_id) SELECT doc_id, list_contains(has, 'PROBATION') AS probation, list_contains(has, 'NON_COMPETE') AS compete FROM s")
def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = findings(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("category").alias("has"))
    return sets.select("doc_id", F.array_contains("has", "PROBATION").alias("probation"), F.array_contains("has", "NON_COMPETE").alias("compete"))


@query(f"WITH {CTE} SELECT doc_id, clause_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM clauses) WHERE rn <= 5")
def limit_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first clauses of a document: 5 here, 400 in the limits."""
    return clauses(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).where("rn <= 5").select("doc_id", "clause_id")


@query(f"{GAPS_CTE}, h AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS hits FROM hits WHERE severity IN ('HIGH', 'MEDIUM') GROUP BY doc_id), g AS (SELECT doc_id, string_agg(question, ' | ' ORDER BY gap_id) AS questions FROM gaps GROUP BY doc_id) SELECT coalesce(h.doc_id, g.doc_id) AS doc_id, coalesce(hits, 0) AS hits, coalesce(questions, '') AS questions FROM h FULL OUTER JOIN g ON h.doc_id = g.doc_id")
def pp_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rules import find_gaps

    docs = clauses(spark, sf_dir)
    hits = run_rules(docs).where("severity in ('HIGH', 'MEDIUM')").groupBy("doc_id").agg(F.count("*").alias("hits"))
    asked = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("gap_id", "question"))), lambda x: x["question"]), " | ")
    gaps = find_gaps(docs).groupBy("doc_id").agg(asked.alias("questions"))
    return hits.join(gaps, "doc_id", "full_outer").select("doc_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("questions", F.lit("")).alias("questions"))


@query(f"WITH {CTE} SELECT doc_id, string_agg(clause_id, ',' ORDER BY clause_id) AS sources FROM clauses WHERE clause_id IN ('c001', 'c002', 'c003', 'c999') GROUP BY doc_id")
def pp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids that do not exist are dropped."""
    cited = F.array(*[F.lit(c) for c in ("c001", "c002", "c003", "c999")])
    have = clauses(spark, sf_dir).groupBy("doc_id").agg(F.collect_set("clause_id").alias("ids"))
    return have.select("doc_id", F.array_join(F.array_intersect(cited, "ids"), ",").alias("sources")).where("sources <> ''")


@query("SELECT conv_id, max(text) FILTER (role = 'user') AS question, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS answers FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') = 0")
def vw_prep_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose questions found no answer."""
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("question"), F.count_if(F.col("role") == "assistant").alias("answers"))
    return rows.where("answers = 0")
