"""Operators that SQL does not express, against plain versions; sources, sinks and streams."""

import io
import json
import random
import zipfile

import pytest
from lexloom.functions import text as T
from lexloom.operators import pairing, verify
from lexloom.sources import files
from lexloom.streaming import limits
from pyspark.sql import functions as F

WORDS = "the employee shall give notice of ninety days before leaving and company may waive it in writing at any time".split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_verify(text, quote):
    norm, needle = (T.normalized_with_origin(x)[0] if x is not None else None for x in (text, quote))
    if norm is None or needle is None or len(needle) < 12 or not norm:
        return "unverified"
    if needle in norm:
        return "verified"
    q, h = needle.split(" "), norm.split(" ")
    for size in range(max(1, len(q) - 2), len(q) + 3):
        for k in range(len(h) - size + 1):
            if 1 - distance(q, h[k : k + size]) / max(size, len(q)) >= 0.9:
                return "fuzzy"
    return "unverified"


def test_verify_matches_a_plain_search(spark):
    rng = random.Random(3)
    rows = []
    for k in range(150):
        h = [rng.choice(WORDS) for _ in range(rng.randrange(30, 70))]
        at = rng.randrange(len(h) - 25)
        q = h[at : at + rng.randrange(8, 25)]
        for _ in range(rng.randrange(4)):
            q[rng.randrange(len(q))] = rng.choice([*WORDS, "other"])
        rows.append((k, " ".join(h), " ".join(q)))
    rows += [(900, None, "a quote of some length"), (901, "text", None), (902, "", "a quote of some length"), (903, "short quote", "short"), (904, "A “Quoted”  text, and more", 'a "quoted" text')]
    pairs = spark.createDataFrame(rows, "k long, text string, quote string")
    got = {r.k: r.status for r in verify.verify(pairs, ["k"]).collect()}
    assert got == {k: plain_verify(t, q) for k, t, q in rows}
    assert set(got.values()) == {"verified", "fuzzy", "unverified"}
    unpruned = {r.k: r.status for r in verify.verify(pairs, ["k"], prune=False).collect()}
    assert unpruned == got


def test_pairing_matches_a_plain_greedy_search(spark):
    rng = random.Random(4)
    rows = []
    for side in "ab":
        for doc in range(6):
            rows += [(side, doc, f"c{k:03d}", k, None if k % 4 == 0 else f"{k % 5}.1", " ".join(rng.choice(WORDS) for _ in range(k % 7))) for k in range(1, 13)]
    made = spark.createDataFrame(rows, "side string, doc_id long, clause_id string, ord int, label string, text string")
    a, b = (made.where(F.col("side") == s).drop("side") for s in "ab")
    words = lambda t: {w for w in t.split(" ") if len(w) > 2 and w not in T.STOP_WORDS}
    want = set()
    for doc in range(6):
        found = []
        for x in (r for r in rows if r[:2] == ("a", doc)):
            for y in (r for r in rows if r[:2] == ("b", doc)):
                p, q = words(x[5]), words(y[5])
                j = len(p & q) / len(p | q) if p or q else 1.0
                same = x[4] is not None and x[4] == y[4]
                if same or j >= pairing.SIMILAR:
                    found.append((-(j + same), x[3], y[3]))
        left, right = set(), set()
        for _, i, k in sorted(found):
            if i not in left and k not in right:
                left.add(i), right.add(k)
                want.add((doc, i, k))
    assert {(r.doc_id, r.a_ord, r.b_ord) for r in pairing.assign(pairing.candidates(a, b)).collect()} == want
    whole = pairing.pair_clauses(a, b)
    assert whole.where("a_ord is not null").count() == whole.where("b_ord is not null").count() == 72


def test_normalize_agrees_with_the_exact_version(spark):
    texts = ["  A “b” c…  ", "x​y­", "Don’t – stop", "", " ", None, "tab\tnew\nline"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.normalize(F.col("t")).alias("n"), T.normalize_exact("t")["text"].alias("x")).collect():
        assert r.n == r.x


def test_normalize_composes(spark):
    texts = ["\ufb01ne", "\u20a8 5", "\u00bd", "\uff46\uff55\uff4c\uff4c", "e\u0301", "\u0928\u093c", "\u0915\u093c \u0938\u0947", "\u03a3\u0391\u03a3", "\u00b4x\u2033", "a\u200d\u0301", "\u0301b", "\u00a0\u3000x\u2009", "\u0130", "\u2460", "\ud55c\uae00", "\U0001f642 \U0001d400", None, ""]
    got = [r.n for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.normalize(F.col("t")).alias("n")).collect()]
    assert got == [None if t is None else T.normalized_with_origin(t)[0] for t in texts]
    assert got[:4] == ["fine", "rs 5", "1\u20442", "full"]


def test_stable_characters_are_stable():
    import re
    import unicodedata

    stable = re.compile(f"[{T.STABLE}]")
    handled = set(T.IGNORABLE + T.FOLDED + T.ELLIPSIS) | T.SPACES
    for c in map(chr, range(0x10000)):
        if stable.match(c) and c not in handled:
            assert unicodedata.normalize("NFKC", c) == c and unicodedata.category(c)[0] != "M" and not unicodedata.combining(c), hex(ord(c))


@pytest.mark.parametrize(("text", "kept"), [
    ("The Company shall not retain any original documents of the Employee.", False), ("You deposit your original certificates. We will not retain them thereafter.", False),
    ("The Company shall not retain your original certificates beyond the minimum service period.", True), ("Original documents are kept; the Company will not hold them until asked.", True),
    ("Originals of your documents will be verified and returned to you immediately.", False), ("Your original certificates will not be retained by the Company at any time.", False),
])
def test_keeping_originals(spark, text, kept):
    from lexloom.operators import rules

    hits = rules.run_rules(spark.createDataFrame([(1, "c001", "OTHER", text)], "doc_id long, clause_id string, category string, text string"))
    assert ("IN-EMP-DOC-RETENTION" in {r.rule_id for r in hits.collect()}) is kept


def docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_files_become_rows(spark, tmp_path):
    for name, content in {"a.txt": b"1. Pay\nYou are paid.", "b.docx": docx("One", "Two"), "c.pdf": b"%PDF-1.7", "d.pdf": b"nope", "e.txt": b"", "f.exe": b"x", "g.docx": b"PKbroken", "h.txt": b"a\x00b"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.reason, r.text) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {
        "a.txt": ("txt", None, "1. Pay\nYou are paid."), "b.docx": ("docx", None, "One\n\nTwo"), "c.pdf": ("pdf", "UNREADABLE", None), "d.pdf": (None, "CONTENT_MISMATCH", None),
        "f.exe": (None, "UNSUPPORTED_TYPE", None), "g.docx": ("docx", "UNREADABLE", None), "h.txt": (None, "CONTENT_MISMATCH", None),
    }
    # Spark's binary source has no rows for files without bytes; the guard names them in other listings.
    assert files.guard(spark.createDataFrame([("e.txt", 0, bytearray())], "path string, length long, content binary")).first().reason == "EMPTY"
    decoded = files.read_files(spark, str(tmp_path), pdf=lambda c: F.lit("page")).where("kind = 'pdf'").first()
    assert (decoded.reason, decoded.text) == (None, "page")


def test_golden_letters(spark, tmp_path):
    (tmp_path / "fair.txt").write_text("1. Notice\nEither side gives 30 days notice.")
    (tmp_path / "fair.expected.json").write_text(json.dumps({"description": "fair", "categories": {"1": "NOTICE_PERIOD"}, "mustNotFlagRules": ["IN-EMP-BOND"]}, indent=1))
    row = files.golden(spark, str(tmp_path)).first()
    assert row.name == "fair" and row.categories == {"1": "NOTICE_PERIOD"} and row.mustNotFlagRules == ["IN-EMP-BOND"]


def test_rate_limit_on_a_stream(spark, tmp_path):
    rows = [(f"u{k % 2}", f"2024-01-01 00:{k:02d}:00") for k in range(12)]
    made = spark.createDataFrame(rows, "user string, ts string").withColumn("ts", F.to_timestamp("ts"))
    made.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    query = limits.rate_limit_stream(stream, ["user"], 4, 3600).writeStream.format("memory").queryName("limited").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.user, r.allowed, r.denied) for r in spark.table("limited").collect()} == {("u0", 4, 2), ("u1", 4, 2)}
    batch = limits.rate_limit(made, ["user"], 4, 3600, ["ts"])
    assert batch.where("allowed").count() == 8


@pytest.mark.parametrize("streaming", [False, True])
def test_requests_are_deduped(spark, tmp_path, streaming):
    made = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "body string, k int").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    if streaming:
        made.write.parquet(str(tmp_path / "in"))
        stream = limits.dedupe_requests(spark.readStream.schema(made.schema).parquet(str(tmp_path / "in")), F.col("body"))
        query = stream.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        assert spark.table("deduped").count() == 2
    else:
        assert limits.dedupe_requests(made, F.col("body")).count() == 2


def test_every_page_is_sniffed(spark, tmp_path):
    from lexloom.plans import q_more

    pages = ["", "short", "a\x00b", "\x0e", "tab\tline\r\n\x0b\x0c", "é" * 300, "x" * 511 + "\x01", "x" * 512 + "\x01", "é" * 255 + "a\x1f", "é" * 256 + "\x1f", "\x7f\x85"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.looks_binary for r in q_more.src_binary_sniff_pages(spark, str(tmp_path)).collect()}
    assert got == {k: any(b < 9 or 13 < b < 32 for b in p.encode()[:512]) for k, p in enumerate(pages)}


def test_short_passages_are_found(spark, tmp_path):
    import compare
    from lexloom.plans import registry
    from lexloom.plans import q_verify  # noqa: F401

    texts = ["one two three four five six seven", "two three", "one", "stone twofold", "none two three four fives", "nothing here"]
    items = ["one", "ne two", "one two three", "one two three four", "one two three four five", "two three four five six", "two three four five six sev", "missing"]
    for name, key, rows in (("documents", "doc_id", texts), ("benchmark", "item_id", items)):
        spark.createDataFrame(list(enumerate(rows)), f"{key} long, text string").coalesce(1).toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    got = compare.rows_of_spark(registry.QUERIES["vq_exact_benchmark"](spark, str(tmp_path)))
    assert compare.difference(got, compare.rows_of_duck(compare.duck(str(tmp_path)), registry.ORACLE["vq_exact_benchmark"])) == ""
    assert {r[got[0].index("item_id")] for r in got[1]} == set(range(7))


def plain_quote(text):
    import regex

    sentence = regex.compile(r"[A-Z(](?:[^.]|\.(?=\S)|(?<=\b(?:Rs|No|Nos|viz))\.)*?\.(?=\s|$)")
    for m in sentence.finditer(text):
        if 25 <= len(m[0]) <= 240:
            return m[0].strip()
    at = regex.search(r"[A-Z(]", text)
    begin = at.start() if at else 0
    opening = text[begin : begin + 160]
    return (regex.sub(r"\s+\S*$", "", opening) if begin + 160 < len(text) else opening).strip()


def test_quotes_are_whole_sentences(spark):
    from lexloom.plans import q_respond
    from lexloom.plans.contracts import clauses

    texts = {(r.doc_id, r.clause_id): r.text for r in clauses(spark, "/root/testdata/sf0.001").collect()}
    got = q_respond.mk_quote(spark, "/root/testdata/sf0.001").collect()
    assert len(got) > 1000 and all(r.quote == plain_quote(texts[r.doc_id, r.clause_id]) for r in got)


def test_normalised_maps_and_offsets(spark):
    from lexloom.plans import q_verify

    sf = "/root/testdata/sf0.001"
    texts = {(r.doc_id, r.clause_id): r.text for r in q_verify.clauses(spark, sf).collect()}
    for r in q_verify.txt_normalize_map(spark, sf).collect():
        norm, _, end = T.normalized_with_origin(texts[r.doc_id, r.clause_id])
        assert (r.norm, r.last) == (norm, max(end))
    said = {(r.doc_id, r.ord): (r.clause_id, r.quote) for r in q_verify.claims(spark, sf).collect()}
    got = {(r.doc_id, r.ord): (r.start, r.end) for r in q_verify.vq_offsets(spark, sf).collect()}
    for key, (clause_id, quote) in said.items():
        text = texts.get((key[0], clause_id))
        needle = T.normalized_with_origin(quote)[0]
        norm, start, end = T.normalized_with_origin(text) if text else ("", [], [])
        at = norm.find(needle) if len(needle) >= 12 else -1
        assert got.get(key) == ((start[at], end[at + len(needle) - 1]) if at >= 0 else None)
        if at >= 0:
            assert T.normalized_with_origin(text[start[at] : end[at + len(needle) - 1]])[0].strip() == needle


def test_cached_answers(spark):
    rows = [(k, t, b, kept) for k, (t, b, kept) in enumerate([(0, "a", True), (50, "a", True), (99, "a", False), (100, "a", True), (10, "b", False), (20, "b", True), (119, "b", True), (120, "b", True)])]
    made = spark.createDataFrame(rows, "id long, t long, body string, kept boolean").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.id: r.hit for r in limits.answer_cache(made, F.col("body"), F.col("kept"), 100).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False}


def test_glossary_takes_first_occurrences(spark):
    from lexloom.operators import responder

    texts = ["The PF and the provident fund; probation, Probation.", "unprobationary CTCs", "नोटिस पीरियड and notice period", "arbitration or arbitrators"]
    got = [[(x.term, x.start) for x in r.g] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(responder.glossary(F.col("t")).alias("g")).collect()]
    assert got == [[("probation", 31), ("providentFund", 4)], [], [("noticePeriod", 0)], [("arbitration", 0)]]
