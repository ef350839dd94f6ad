"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, benchmark decontamination, source mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. Rows are told apart by numbers that a stage writes with them once, so null and repeated ids are safe: a
stage decides on rows, not ids, and on the same rows however the files are split. All stages but the last return the
columns of documents, also further ones whatever their names; the last returns each document as many times as the mix
takes it.

Cases. A null text counts as empty: the classifier scores it, equal empty texts leave one row, it is clean, and the mix
takes it 0 times or more without any words. Texts of any length are taken whole at every stage. Of equal or linked texts
the smallest id stays, a null id last; rows that repeat an id are rows of their own. Null sources are a source. Empty
tables pass through every stage.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import decontam, exact_dedup, mixing, quality, simhash
from lexloom.llm.common import fold, fresh, numbered, read, shared_dir, without


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good."""
    labels = read(spark, sf_dir, "labels")
    model = quality.fit(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2))
    names = fresh("score", docs.columns), fresh("predicted", docs.columns)
    return quality.score(docs, model, names=names).where(F.col(names[1]) == 1).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    rows, row = numbered(docs)
    return without(rows, exact_dedup.exact_dedup(rows, row_col=row).where(~F.col("kept")), row)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies."""
    rows, row = numbered(docs)
    return without(rows, simhash.near_duplicates(rows, row_col=row).where(~F.col("kept")), row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold benchmark passages to a twentieth of their words or more."""
    rows, row = numbered(docs)
    return without(rows, decontam.contamination(rows, read(spark, sf_dir, "benchmark"), id_col=row).where("contaminated"), row)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
]

#: The classifier and the fingerprints are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = posixpath.join(shared_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = posixpath.join(folder, f"{k}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
