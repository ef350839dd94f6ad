"""PDF decoding with a decoder of the tests, and letters as files: written, read back, scored."""

import json

from lexloom.operators import rules, segment
from lexloom.plans import contracts
from lexloom.sources import golden, pdf
from pyspark.sql import functions as F


def test_pdf_files(spark):
    def decoder(content):
        """Bytes of the test: a reason, or pages of items."""
        import json

        from lexloom.sources import pdf

        text = content.decode()
        if text == "locked":
            raise pdf.Encrypted
        if text.startswith("cut"):
            raise pdf.Corrupt
        made = json.loads(text)

        class File:
            pages = len(made)

            def items(self, page):
                if made[page - 1] == "broken":
                    raise OSError("no such page")
                return made[page - 1]

        return File()

    long = [["a line that is long enough for the test, with words and more words, ", False, 10], ["its end", True, 10], ["next", False, None], ["  and  on", False, 40.0], ["far", False, 41.5], ["below", False, 50]]
    rows = [
        ("locked.pdf", b"locked"), ("cut.pdf", b"cut short"), ("odd.pdf", b"{"), ("late.pdf", json.dumps([long, "broken"]).encode()), ("scan.pdf", json.dumps([[["x", True, 1]], []]).encode()),
        ("none.pdf", b"[]"), ("good.pdf", json.dumps([long, long]).encode()), ("many.pdf", json.dumps([long] * 45).encode()),
    ]
    found = pdf.pages(spark.createDataFrame(rows, "path string, content binary").repartition(3), decoder).cache()
    got = {r.path: (r.reason, r.pages, r.truncated) for r in pdf.results(found, least=60).collect()}
    assert got == {
        "locked.pdf": ("ENCRYPTED", None, False), "cut.pdf": ("CORRUPT", None, False), "odd.pdf": ("UNKNOWN", None, False), "late.pdf": ("UNKNOWN", None, False), "scan.pdf": ("SCANNED_PDF", 2, False),
        "none.pdf": ("SCANNED_PDF", 0, False), "good.pdf": (None, 2, False), "many.pdf": (None, 45, True),
    }
    own = [(r.page, r.line_no, r.text) for r in pdf.lines(found).where("path = 'good.pdf'").orderBy("page", "line_no").collect()]
    page = ["a line that is long enough for the test, with words and more words, its end", "next and onfar", "below"]
    assert own == [(p, k + 1, t) for p in (1, 2) for k, t in enumerate(page)]
    assert pdf.lines(found).where("path = 'many.pdf'").agg(F.max("page")).first()[0] == 40


def test_letters_come_back(spark, tmp_path):
    out = f"file://{tmp_path}/letters"
    clauses = contracts.clauses(spark, "/root/testdata/sf0.001").where("doc_id < 200")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.col("ord").cast("string"), F.lit(". "), "text").alias("t")))), lambda x: x["t"]), "\n\n")
    bond = F.max(F.col("kind") == 2)
    docs = clauses.groupBy(F.concat(F.lit("letter-"), "doc_id").alias("name")).agg(text.alias("text"), bond.alias("bond"))
    rule = F.array(F.lit("IN-EMP-BOND"))
    none = F.array().cast("array<string>")
    names = {"mustFlagRules": F.when(F.col("bond"), rule).otherwise(none), "mustNotFlagRules": none, "mustReportMissing": none, "mustNotReportMissing": none, "mustFindCategories": F.array(F.lit("GENERAL"))}
    question = F.array(F.struct(F.lit("How long is notice?").alias("q"), F.array(F.lit("answered")).alias("expect")))
    severity = F.when(F.col("bond"), F.create_map(F.lit("IN-EMP-BOND"), F.lit("HIGH")))
    fields = F.struct(F.lit("a letter").alias("description"), F.create_map(F.lit("1"), F.lit("GENERAL")).alias("categories"), *[v.alias(k) for k, v in names.items()], severity.alias("expectedSeverity"), question.alias("questions"))
    letters = docs.withColumn("expected", F.to_json(fields))
    want = {r.name: r for r in letters.collect()}
    assert golden.write_letters(letters, out) == len(want) > 30 and golden.write_letters(letters, out) == len(want)
    assert len(list((tmp_path / "letters").iterdir())) == 3 * len(want)

    back = golden.read_letters(spark, out).cache()
    for r in back.collect():
        assert (r.text, r.reason, r.wrong) == (want[r.name].text, None, []) and r.expected.categories == {"1": "GENERAL"}
        assert r.expected.questions[0].expect == ["answered"] and r.expected.mustFlagRules == (["IN-EMP-BOND"] if want[r.name].bond else [])
    assert back.count() == 2 * len(want)

    # The letters as files raise what they were written to raise.
    lines = back.where("kind = 'docx'").select(F.col("name").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("page", F.lit(1))
    found = segment.segment(lines).withColumn("category", F.when(F.contains("text", F.lit("minimum period")), "BOND_OR_EXIT_PENALTY"))
    hits = rules.run_rules(found).withColumnRenamed("doc_id", "name")
    gaps = rules.find_gaps(found).withColumnRenamed("doc_id", "name")
    scored = golden.score(back, hits, gaps).collect()
    assert {r.metric for r in scored} == {"rule_recall", "severity"} and all(r.hit for r in scored)
    assert sum(r.metric == "rule_recall" for r in scored) == sum(w.bond for w in want.values()) > 3


def test_expectations_that_are_not_as_declared(spark, tmp_path):
    out = f"file://{tmp_path}/letters"
    golden.write_letters(spark.createDataFrame([("a", "text", '{"description": 7, "questions": [{"q": "x", "expect": ["maybe"]}]}')], "name string, text string, expected string"), out)
    wrong = golden.read_letters(spark, out).first().wrong
    assert "$.description: kind" in wrong and "$.questions[0].q: short" in wrong and "$.questions[0].expect[0]: unknown" in wrong and "$.mustFlagRules: missing" in wrong
