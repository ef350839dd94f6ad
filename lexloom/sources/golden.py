"""Letters with what is expected of them, as files: written by tasks, read back by stem, and scored.

A letter is three files: ``<name>.txt``, ``<name>.docx`` and ``<name>.expected.json``. Tasks write under temporary names and
move the files to their own; the same letter gives the same bytes, so a repeated attempt does no harm.
"""

from __future__ import annotations

import io
import posixpath
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import CATEGORIES
from ..operators.shapes import Items, Record, Text, Whole, type_of, violations
from . import files

STATUS = ("answered", "not_in_document", "needs_professional")
CATEGORY = Text(among=tuple(CATEGORIES))
LINES = Items(Text())
MAP = "map<string,string>"
#: Fields of what is expected, by name; maps (of labels to categories, of rules to severities and details) stand beside.
SHAPE = Record({
    "description": Text(), "mustFindCategories": Items(CATEGORY), "mustFlagRules": LINES, "mustNotFlagRules": LINES, "mustReportMissing": LINES, "mustNotReportMissing": LINES,
    "forbiddenClauseIds": Items(Text(), optional=True), "forbiddenVerifiedQuotes": Items(Text(), optional=True), "compareWith": Text(optional=True), "expectChanged": Items(Text(), optional=True),
    "expectRemoved": Items(Text(), optional=True), "expectUnchangedAtLeast": Whole(least=0, optional=True),
    "questions": Items(Record({"q": Text(least=3), "expect": Items(Text(among=STATUS), least=1), "clauseLabels": Items(Text(), optional=True), "forbidVerifiedQuote": Text(optional=True)})),
})
MAPS = {"categories": MAP, "categoriesByText": MAP, "expectedSeverity": MAP, "expectedDetails": f"map<string,{MAP}>"}
TYPE = type_of(SHAPE)[:-1] + "," + ",".join(f"`{k}`:{v}" for k, v in MAPS.items()) + ">"
DOCX_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'


def docx(text: str) -> bytes:
    """A Word document of the text's paragraphs (apart by blank lines), the same bytes every time."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in text.split("\n\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("word/document.xml", (2020, 1, 1, 0, 0, 0)), f"{DOCX_HEAD}{body}</w:body></w:document>")
    return out.getvalue()


def _write(out: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(out)
        for batch in batches:
            for name, text, expected in zip(batch["name"], batch["text"], batch["expected"], strict=True):
                for ending, content in ((".txt", text.encode()), (".docx", docx(text)), (".expected.json", expected.encode())):
                    temporary, final = posixpath.join(base, "_temporary", uuid.uuid4().hex), posixpath.join(base, name + ending)
                    with store.open_output_stream(temporary, compression=None) as f:
                        f.write(content)
                    if store.get_file_info(final).type != fs.FileType.NotFound:
                        store.delete_file(final)
                    store.move(temporary, final)
            yield pd.DataFrame({"name": batch["name"]})

    return run


def write_letters(letters: DataFrame, out: str) -> int:
    """Write letters (name, text, expected: JSON) below ``out``, a folder that driver and executors share; how many."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(out)
    store.create_dir(posixpath.join(base, "_temporary"), recursive=True)
    n = letters.select("name", "text", "expected").mapInPandas(_write(out), "name string").count()
    store.delete_dir(posixpath.join(base, "_temporary"))
    return n


def read_letters(spark: SparkSession, out: str) -> DataFrame:
    """(name, kind, text, reason, wrong, expected) of letters in either format: ``wrong`` lists what is not as declared in
    the expectation, ``expected`` is the whole of it, parsed."""
    name = lambda ending: F.regexp_extract("path", rf"([^/]+){ending}\z", 1)
    texts = files.read_files(spark, f"{out}/*.{{txt,docx}}").select(name(r"\.(?:txt|docx)").alias("name"), "kind", "text", "reason")
    raw = spark.read.format("binaryFile").load(f"{out}/*.expected.json").select(name(r"\.expected\.json").alias("name"), F.decode("content", "UTF-8").alias("json"))
    expected = raw.select("name", violations(SHAPE, F.col("json")).alias("wrong"), F.from_json("json", TYPE).alias("expected"))
    return texts.join(expected, "name")


def score(letters: DataFrame, hits: DataFrame, gaps: DataFrame) -> DataFrame:
    """(name, metric, detail, hit): rules and gaps that a letter must raise, and those that it must not.

    hits: (name, rule_id, severity), gaps: (name, gap_id). A severity that is expected is checked where the rule fires.
    """
    fired = hits.groupBy("name").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("rule_id", "severity")))).alias("fired"))
    unsaid = gaps.groupBy("name").agg(F.collect_set("gap_id").alias("unsaid"))
    rows = letters.groupBy("name").agg(F.first("expected").alias("expected")).join(fired, "name", "left").join(unsaid, "name", "left")
    rows = rows.withColumn("rules", F.coalesce(F.map_keys("fired"), F.array().cast("array<string>"))).withColumn("unsaid", F.coalesce("unsaid", F.array().cast("array<string>")))

    def each(metric: str, field: str, have: str, wanted: bool):
        return F.transform(F.coalesce(F.col(f"expected.{field}"), F.array().cast("array<string>")), lambda x: F.struct(F.lit(metric).alias("metric"), x.alias("detail"), (F.array_contains(have, x) == F.lit(wanted)).alias("hit")))

    severities = F.transform(F.map_entries(F.coalesce("expected.expectedSeverity", F.create_map().cast(MAP))), lambda e: F.struct(F.lit("severity").alias("metric"), e["key"].alias("detail"), F.coalesce(F.col("fired")[e["key"]] == e["value"], F.lit(False)).alias("hit")))
    checks = F.concat(each("rule_recall", "mustFlagRules", "rules", True), each("false_flag", "mustNotFlagRules", "rules", False), each("missing_recall", "mustReportMissing", "unsaid", True), each("false_missing", "mustNotReportMissing", "unsaid", False), severities)
    return rows.select("name", F.explode(checks).alias("x")).select("name", "x.*")
