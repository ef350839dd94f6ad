"""Mixing sources to target weights, with DataFrame functions only.

``mix`` gives every document its number of copies: the words of each source are summed, shares of the whole are dealt
to the sources by weight (a source's share stops at ``most`` times its own words, what is left over goes to the others
by weight), and a document is taken floor(rate) times plus once more with a probability equal to the rate's fraction,
decided by a seeded hash of its id.

Cases. A null text has size 0; texts of any length are counted whole. A null source is a source of its own and comes last in the order of sources. A source
whose texts hold no words has target 0 and its documents rate 0. Rows with equal ids are separate documents that share
one draw; a null id draws as the text ``null``. An empty table gives an empty result. Further columns are carried
through; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, size_of

WEIGHTS = (5, 2, 1)
MOST = 3
#: Sources are broadcast to the documents up to this many; with more, documents and sources are joined by shuffle.
BROADCAST_SOURCES = 20_000
ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Raising a common level until the capped shares use up the whole leaves the sources with the lowest cap per weight
    at their caps. With sources in that order, the first k are capped for the smallest k at which the level of the
    rest, (whole - caps so far) / (weights left), does not exceed the next source's cap per weight.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place + 1).cast("int")).cast("long"))
    weighed = weighed.withColumn("cap", F.col("source_size") * most)
    in_order = [F.col("cap").cast("double") / F.col("w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*in_order).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        weighed.withColumn("whole", F.sum("source_size").over(everything))
        .withColumn("left", F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("fits", F.col("left") * F.col("w") <= F.col("cap") * F.col("w_left"))
        .withColumn("n", F.row_number().over(Window.orderBy(*in_order)))
    )
    level = level.withColumn("first", F.min(F.when(F.col("fits"), F.struct("n", "left", "w_left"))).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("n") < F.col("first.n")), F.col("cap").cast("double")).otherwise(
        (F.col("w") * F.col("first.left")).cast("double") / F.col("first.w_left").cast("double")
    )
    return level.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: str) -> Column:
    """A number from 0 to 1 for a key, by 32 bits of md5, which other engines can compute too."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix-1:", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken (size times copies)."""
    sized = docs.drop(*[c for c in ADDED if c in docs.columns]).withColumn("size", size_of(F.col(text_col)))
    own = fresh("source__", sized.columns)
    # Sums per source and task come before the shuffle, so that a source with a third of all rows is no hot key.
    sums = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    table = materialize(targets(sums, weights, most).withColumnRenamed("source", own))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = sized.join(table, F.col(source_col).eqNullSafe(F.col(own)), "inner").drop(own)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    more = (draw(F.col(id_col), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return (
        joined.withColumn("rate", rate)
        .withColumn("copies", F.floor("rate").cast("long") + more)
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with its own columns only."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    keys = {k: names[docs.columns.index(v)] for k, v in {"id_col": "doc_id", "text_col": "text", "source_col": "source", **{k: v for k, v in options.items() if k.endswith("_col")}}.items()}
    mixed = mix(docs.toDF(*names), **options | keys).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")
    return mixed.select(*names, copies).drop("copy").toDF(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS w
  FROM sums
), leveled AS (
  SELECT *, row_number() OVER o AS n,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS BIGINT) AS rest,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_left
  FROM weighed
  WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, encode(source) NULLS LAST),
         b AS (ORDER BY CAST(cap AS DOUBLE) / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), first_fit AS (
  SELECT n AS fn, rest AS frest, w_left AS fw FROM leveled WHERE rest * w <= cap * w_left ORDER BY n LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN fn IS NULL OR n < fn THEN CAST(cap AS DOUBLE) ELSE CAST(w * frest AS DOUBLE) / CAST(fw AS DOUBLE) END AS target
  FROM leveled LEFT JOIN first_fit ON true
), rated AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / CAST(source_size AS DOUBLE) ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rated
"""
