"""Files as rows: guards, text, Word documents and positioned PDF items. What cannot be read becomes a row with a
reason, never an exception."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LIMITS

ACCEPTED = ("pdf", "docx", "txt")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LINE_GAP = 2.0


def looks_binary(content: Column) -> Column:
    """NUL or control bytes other than tab to carriage return among the first 512."""
    return F.decode(F.substring(content, 1, 512), "ISO-8859-1").rlike(r"[\x00-\x08\x0e-\x1f]")


def guard(files: DataFrame) -> DataFrame:
    """Adds kind and reason to (path, length, content): empty, size, extension, then content."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1))
    head = F.substring("content", 1, 4)
    reason = (
        F.when(F.col("length") == 0, "EMPTY").when(F.col("length") > LIMITS.file_bytes, "TOO_LARGE").when(~extension.isin(*ACCEPTED), "UNSUPPORTED_TYPE")
        .when((extension == "pdf") & (head != F.lit(b"%PDF")), "CONTENT_MISMATCH").when((extension == "docx") & (F.substring("content", 1, 2) != F.lit(b"PK")), "CONTENT_MISMATCH")
        .when((extension == "txt") & looks_binary(F.col("content")), "CONTENT_MISMATCH")
    )
    return files.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isNull(), extension))


def _docx(content: bytes) -> str | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))


@F.pandas_udf(T.StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Raw text of Word documents, paragraphs apart by a blank line; null where the file is broken."""
    return content.map(_docx)


def read_files(spark: SparkSession, path: str, pdf: Callable[[Column], Column] | None = None) -> DataFrame:
    """(path, kind, reason, text) of the files below ``path``; ``pdf`` decodes PDF content (none is built in).

    Spark's binary source leaves out files without bytes.
    """
    files = guard(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content"))
    content = F.col("content")
    text = F.when(F.col("kind") == "txt", F.decode(content, "UTF-8")).when(F.col("kind") == "docx", docx_text(content))
    text = text.when(F.col("kind") == "pdf", pdf(content)) if pdf else text
    rows = files.select("path", "kind", "reason", text.alias("text"))
    return rows.withColumn("reason", F.when(F.col("reason").isNull() & F.col("text").isNull(), "UNREADABLE").otherwise(F.col("reason")))


def lines_from_items(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text) from PDF items (doc_id, page, i, str, eol, y): a line ends at an end mark or where
    the height moves by more than ``LINE_GAP``; the height is forgotten behind an end mark."""
    order = Window.partitionBy("doc_id", "page").orderBy("i")
    after_eol = F.coalesce(F.lag("eol").over(order), F.lit(False))
    moved = F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) > LINE_GAP, F.lit(False))
    rows = items.withColumn("break", (after_eol | moved).cast("int"))
    rows = rows.withColumn("line", F.sum("break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("i", "str"))), lambda x: x["str"])
    lines = rows.groupBy("doc_id", "page", "line").agg(F.trim(F.regexp_replace(F.array_join(parts, ""), r"\s+", " ")).alias("text")).where("text <> ''")
    return lines.select("doc_id", "page", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("line")).alias("line_no"), "text")


def golden(spark: SparkSession, folder: str) -> DataFrame:
    """Letters and what is expected of them: ``<name>.txt`` joined with ``<name>.expected.json`` on the name."""
    schema = "description string, categories map<string,string>, mustFindCategories array<string>, mustFlagRules array<string>, mustNotFlagRules array<string>, mustReportMissing array<string>, mustNotReportMissing array<string>"
    name = lambda ending: F.regexp_extract(F.input_file_name(), rf"([^/]+){ending}\z", 1)
    texts = spark.read.text(f"{folder}/*.txt", wholetext=True).select(name(r"\.txt").alias("name"), F.col("value").alias("text"))
    expected = spark.read.schema(schema).json(f"{folder}/*.expected.json", multiLine=True).select(name(r"\.expected\.json").alias("name"), "*")
    return texts.join(expected, "name")
