"""PDF files as pages of positioned items. The decoder is the caller's: no library for the format is installed here.

A decoder takes a file's bytes and gives an object with ``pages`` (their number) and ``items(page)`` (str, eol, y of each
item; pages count from 1), or raises ``Encrypted`` or ``Corrupt``. Whatever it raises becomes the reason of the file's row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from .files import lines_from_items

PAGES = "path string, pages int, page int, reason string, items array<struct<i: long, str: string, eol: boolean, y: double>>"


class Encrypted(Exception):
    """The file asks for a password."""


class Corrupt(Exception):
    """The file is not a whole PDF."""


def pages(pdfs: DataFrame, decoder: Callable[[bytes], object], most: int = LIMITS.pages) -> DataFrame:
    """A row for each of the first pages of files (path, content), and one with a reason for a file that fails. A file is
    decoded by one task, a page at a time; its bytes are bounded by the guard, its pages by ``most``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[tuple] = []
                try:
                    file = decoder(bytes(content))
                    for page in range(1, min(file.pages, most) + 1):
                        items = [(k, s, bool(eol), None if y is None else float(y)) for k, (s, eol, y) in enumerate(file.items(page))]
                        rows.append((path, file.pages, page, None, items))
                    rows = rows or [(path, 0, None, None, [])]
                except Encrypted:
                    rows = [(path, None, None, "ENCRYPTED", [])]
                except Corrupt:
                    rows = [(path, None, None, "CORRUPT", [])]
                except Exception:  # noqa: BLE001  other files go on
                    rows = [(path, None, None, "UNKNOWN", [])]
                yield pd.DataFrame(rows, columns=["path", "pages", "page", "reason", "items"])

    return pdfs.select("path", "content").mapInPandas(run, PAGES)


def results(found: DataFrame, most: int = LIMITS.pages, least: int = LIMITS.scanned_chars_per_page) -> DataFrame:
    """(path, reason, pages, truncated): a file with fewer characters than ``least`` a page is a scan."""
    chars = F.aggregate("items", F.lit(0), lambda n, x: n + F.length(x["str"]))
    files = found.groupBy("path").agg(F.max("reason").alias("reason"), F.max("pages").alias("pages"), F.sum(chars).alias("chars"), F.count("page").alias("read"))
    scanned = F.when(F.col("chars") < least * F.greatest("read", F.lit(1)), "SCANNED_PDF")
    return files.select("path", F.coalesce("reason", scanned).alias("reason"), "pages", F.coalesce(F.col("pages") > most, F.lit(False)).alias("truncated"))


def lines(found: DataFrame) -> DataFrame:
    """(path, page, line_no, text) of the pages that were read."""
    items = found.where("reason is null").select(F.col("path").alias("doc_id"), "page", F.explode("items").alias("x")).select("doc_id", "page", "x.*")
    return lines_from_items(items).withColumnRenamed("doc_id", "path")
