"""Exact dedup by content sort.

Normalised texts are range-partitioned by Spark's sampled splitters on (first bytes, digest, code points, id), sorted
inside each partition (spilling as needed), and every row's text is compared in full with its neighbour's. As ids are
part of the sort key, copies of one text may spread over many partitions: no partition holds more than its share of a
large group. The key is of bounded size, as the sampling sends keys to the driver, and texts have no bound.
Groups that cross partitions are joined up through a table of two rows per partition (its first and last run), whose
texts are compared in full with their neighbour's, too.

Of equal texts the row with the most code points in the original text stays, then the smallest id.

Cases. Texts of any length are compared whole. Null text counts as empty; empty texts equal each other and texts of separators only. Rows that repeat an id
are rows of their own. A null id sorts last among equals. An empty table gives an empty result. Only the id and text
columns are read; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_spaces, materialize, small_batches

#: Characters of the normalised text in the sort key; the digest orders texts that begin alike.
HEAD = 24
NAMES = ["id", "row", "sha", "part", "run", "is_first", "is_last", "at_start", "keep_id", "run_size", "edge"]
RUNS = "id long, row long, sha binary, part long, run long, is_first boolean, is_last boolean, at_start boolean, keep_id long, run_size long, edge string"


def without_text(rows: pa.Table) -> pa.Table:
    """Rows of a run behind its first: their text is the first one's."""
    return rows.set_column(rows.schema.get_field_index("norm"), "norm", pa.nulls(rows.num_rows, pa.string()))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into runs of equal texts; a run's first row is the one that stays.

    One row's text is kept between batches, and the ids and digests of the run at hand: no more than the partition's
    share of the rows, 50 bytes each.
    """
    part = TaskContext.get().partitionId()
    held: list[pa.Table] = []
    last = None
    number = 0

    def out(rows: pa.Table, sizes: np.ndarray, is_last: bool) -> list[pa.RecordBatch]:
        """The rows of whole runs of the given sizes, the first of which has the present number."""
        ids = rows.column("id").combine_chunks()
        run = np.repeat(np.arange(len(sizes)), sizes)
        starts = np.append(0, np.cumsum(sizes)[:-1])
        at_start = np.zeros(len(run), dtype=bool)
        at_start[starts] = True
        # The text of runs at an edge of the partition, once for each.
        edge = np.zeros(len(run), dtype=bool)
        if not number:
            edge[0] = True
        if is_last:
            edge[starts[-1]] = True
        texts = pc.if_else(pa.array(edge), rows.column("norm").combine_chunks(), pa.scalar(None, pa.string()))
        columns = [ids, rows.column("row").combine_chunks(), rows.column("sha").combine_chunks(), pa.array(np.full(len(run), part), pa.int64()), pa.array(run + number, pa.int64()), pa.array(run + number == 0), pa.array(np.full(len(run), is_last)), pa.array(at_start), ids.take(pa.array(starts[run])), pa.array(sizes[run], pa.int64()), texts]
        return pa.Table.from_arrays(columns, names=NAMES).to_batches(max_chunksize=10_000)

    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("norm")
        rows = pa.table({"id": batch.column("id"), "row": batch.column("row"), "sha": batch.column("sha"), "norm": text})
        new = np.ones(len(text), dtype=bool)
        new[1:] = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or text[0].as_py() != last
        last = text[len(text) - 1].as_py()
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(without_text(rows))
            continue
        if starts[0] > 0:
            held.append(without_text(rows.slice(0, int(starts[0]))))
        if held:
            run = pa.concat_tables(held)
            yield from out(run, np.array([run.num_rows]), False)
            number += 1
        if len(starts) > 1:  # the runs that begin and end inside this batch
            yield from out(rows.slice(int(starts[0]), int(starts[-1] - starts[0])), np.diff(starts), False)
            number += len(starts) - 1
        begun = int(starts[-1])
        held = [rows.slice(begun, 1)]
        if begun + 1 < rows.num_rows:
            held.append(without_text(rows.slice(begun + 1)))
    if held:
        run = pa.concat_tables(held)
        yield from out(run, np.array([run.num_rows]), True)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. One row of each group is kept.

    row_col: a long column that is carried along, for callers whose ids may repeat.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), drop_spaces(text).alias("norm"), F.length(text).alias("points"))
    rows = rows.withColumn("head", F.substring("norm", 1, HEAD)).withColumn("sha", F.unhex(F.sha2("norm", 256)))
    order = [F.col("head"), F.col("sha"), F.col("points").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    # Inside a partition the text itself follows the digest: equal texts are adjacent whatever digests do.
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2], "norm", *order[2:])
    runs = materialize(ranged.select("id", "row", "norm", "sha").mapInArrow(_runs, RUNS))

    # A run that crosses partitions is the last of one and the first of the next non-empty one, perhaps of many.
    edges = runs.where("(is_first or is_last) and at_start").select("part", "run", "sha", "keep_id", "run_size")
    along = Window.orderBy("part", "run")
    edges = edges.withColumn("old_part", F.lag("part").over(along)).withColumn("old_run", F.lag("run").over(along)).withColumn("alike", F.col("sha") == F.lag("sha").over(along))
    # Only where digests agree are the two texts brought together; no task holds more than its share of them.
    texts = runs.where("edge is not null").select("part", "run", "edge")
    met = edges.where("alike").select("part", "run", "old_part", "old_run").join(texts, ["part", "run"])
    met = met.join(texts.toDF("old_part", "old_run", "old_edge"), ["old_part", "old_run"]).select("part", "run", (F.col("edge") == F.col("old_edge")).alias("same"))
    edges = edges.join(met, ["part", "run"], "left").withColumn("front", ~F.coalesce("same", F.lit(False)))
    edges = edges.withColumn("chain", F.sum(F.col("front").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    chain = Window.partitionBy("chain").orderBy("part", "run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select("part", "run", "front", F.first("keep_id").over(chain).alias("chain_keep"), F.sum("run_size").over(chain).alias("chain_size"))
    # Two rows per partition at most: the broadcast is bounded by the number of partitions.
    whole = runs.join(F.broadcast(edges), ["part", "run"], "left")
    inside = F.col("front").isNull()
    return whole.select(
        F.col("id").alias(id_col),
        F.when(inside, F.col("keep_id")).otherwise(F.col("chain_keep")).alias("keep_id"),
        F.when(inside, F.col("run_size")).otherwise(F.col("chain_size")).cast("long").alias("group_size"),
        (F.col("at_start") & (inside | F.col("front"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
