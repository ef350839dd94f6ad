"""Nearest-rank percentiles by distributed selection: no group's values meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shared import written


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): the value at rank ceil(share * n) of each group's n values, nulls left out.

    Equal values are counted first. The counts are sorted by ranges of (group, value); sums of the parts say in which
    part of a group a rank lies, and only these parts add up their counts, each by itself.
    """
    names = [f"by{k}__" for k in range(len(by))]
    counts = rows.where(F.col(value).isNotNull()).groupBy(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], F.col(value).alias("value__")).agg(F.count("*").alias("n__"))
    counts = written(counts.repartitionByRange(*names, "value__").sortWithinPartitions(*names, "value__").withColumn("part__", F.spark_partition_id()))
    sums = counts.groupBy("part__", *names).agg(F.sum("n__").alias("sum__"))  # a row for each part and each group
    along = Window.partitionBy(*names).orderBy("part__")
    sums = sums.withColumn("base__", F.sum("sum__").over(along) - F.col("sum__")).withColumn("total__", F.sum("sum__").over(Window.partitionBy(*names)))
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name__"), F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("total__"))).alias("rank__")) for n, s in shares.items()]))
    targets = sums.select("part__", *names, "base__", "sum__", wanted.alias("x")).select("*", "x.*").where("rank__ > base__ and rank__ <= base__ + sum__")
    targets = targets.select(F.col("part__").alias("at__"), *(F.col(n).alias(f"{n}t") for n in names), "name__", (F.col("rank__") - F.col("base__")).alias("own__"))
    upto = F.sum("n__").over(Window.partitionBy("part__", *names).orderBy("value__"))
    same = [F.col(n).eqNullSafe(F.col(f"{n}t")) for n in names]
    some = counts.join(targets.select("at__", *(f"{n}t" for n in names)).distinct(), [F.col("part__") == F.col("at__"), *same], "left_semi").withColumn("upto__", upto)
    found = some.join(targets, [F.col("part__") == F.col("at__"), *same, F.col("upto__") >= F.col("own__"), F.col("upto__") - F.col("n__") < F.col("own__")])
    kept = found.groupBy(*names).agg(*[F.max(F.when(F.col("name__") == n, F.col("value__"))).alias(n) for n in shares])
    return kept.select(*(F.col(n).alias(b) for b, n in zip(by, names, strict=True)), *shares)
