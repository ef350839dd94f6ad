"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Rows in one Arrow batch. Texts reach 100 KB and more, so the default of 10,000 rows could fill a worker.
ARROW_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch of long texts can hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one is made only where the session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs no recomputation of what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % n


def about(df: DataFrame, key: str, rows: int, seed: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df``, the same ones in every run: those whose seeded hash of ``key`` is low enough.

    Only for fitting models; the caller documents ``rows`` as its parameter.
    """
    total = df.count() if total is None else total
    if total <= rows:
        return df
    grain = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(grain)) < int(grain * (rows / total)))


def size_of(text: Column) -> Column:
    """Number of words of a text as the contracts count them; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def drop_spaces(text: Column) -> Column:
    """The text without any separator character; plain replacements are faster than a pattern."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name``, with marks behind it while a column has that name."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written once with a number each, and the number's column: a scan of files numbers rows by its splits,
    which follow from the cores at hand, so all that decides on rows and drops them must read the numbers as data."""
    name = fresh("row__", docs.columns)
    return materialize(docs.withColumn(name, F.monotonically_increasing_id())), name


#: Rows (of one long) up to which a list of what goes is broadcast: 16 MB. Longer ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone``, and without the key."""
    gone = materialize(gone.select(key).distinct())
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").drop(key)
