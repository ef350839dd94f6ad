"""Row helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps use many times. A generator of one row keeps the optimizer from writing their
    expressions out at every use, which would overflow generated code and repeat the work. They are made in a projection
    in front of it: inside a generator, one function on arrays would have all of them interpreted."""
    made = rows.select("*", F.struct(*(v.alias(k) for k, v in columns.items())).alias("once__"))
    made = made.select(*(F.col(c) for c in rows.columns if c not in columns), F.explode(F.array("once__")).alias("made__"))
    return made.select(*(F.col(c) for c in rows.columns if c not in columns), *(F.col(f"made__.{k}").alias(k) for k in columns))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
