"""Rate limits and call budgets, over a table and over a stream.

Denied requests do not count, so in a table the first ``limit`` requests of a key and window are the allowed ones. The
stream keeps one counter per key and window in the state store; it is dropped when its window is over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_start(ts: Column, seconds: int) -> Column:
    return (F.floor(F.unix_seconds(ts) / seconds) * seconds).cast("long")


#: Most requests that any route allows in a window; below Spark's own bound for limiting ranks in front of a shuffle.
MOST = 500


def rate_limit(requests: DataFrame, keys: list[str], limit: int | Column, seconds: int | Column, order: list[str], most: int = MOST) -> DataFrame:
    """Adds allowed, remaining and reset_seconds to requests with a timestamp ``ts``; limit and seconds may be columns,
    such as those of a table of routes. ``order`` must tell a key's requests apart; no limit may be above ``most``.

    Only the first requests of a key and window are numbered, and no task gets more than ``most`` of them from any other:
    Spark limits ranks before it shuffles. The others meet them by a join that Spark can split. A null key is a key.
    """
    most = limit if isinstance(limit, int) else most
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    limit = F.lit(limit) if isinstance(limit, int) else limit
    rows = requests.withColumn("window", (F.floor(F.unix_seconds(F.col("ts")) / seconds) * seconds).cast("long")).withColumn("limit__", limit).withColumn("place__", F.struct(*order))
    own = [*keys, "window"]
    first = rows.select(*own, "place__", "limit__").withColumn("n", F.row_number().over(Window.partitionBy(*own).orderBy("place__"))).where(F.col("n") <= most)
    first = first.where(F.col("n") <= F.col("limit__")).groupBy(*(F.col(k).alias(f"{k}__") for k in own)).agg(F.sort_array(F.collect_list("place__")).alias("first__"))
    met = rows.join(first, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in own], "left")
    n = F.coalesce(F.array_position("first__", F.col("place__")), F.lit(0))
    reset = F.col("window") + seconds - F.unix_seconds(F.col("ts"))
    return met.select(*requests.columns, (n > 0).alias("allowed"), F.when(n > 0, F.col("limit__") - n).otherwise(0).cast("int").alias("remaining"), reset.alias("reset_seconds"))


def rate_limit_stream(requests: DataFrame, keys: list[str], limit: int, seconds: int) -> DataFrame:
    """(keys, window, allowed, denied) per micro-batch from a stream with ``ts`` (timestamp), counters kept as state."""
    timed = requests.withWatermark("ts", f"{seconds} seconds").withColumn("window", window_start(F.col("ts"), seconds))

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        asked = sum(len(b) for b in batches)
        allowed = max(0, min(asked, limit - used))
        state.update((used + allowed,))
        state.setTimeoutTimestamp(max(int(key[-1] + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(*key, allowed, asked - allowed)], columns=[*keys, "window", "allowed", "denied"])

    kinds = ", ".join(f"{k} {timed.schema[k].dataType.simpleString()}" for k in keys)
    grouped = timed.groupBy(*keys, "window")
    return grouped.applyInPandasWithState(count, f"{kinds}, window long, allowed long, denied long", "used long", "update", GroupStateTimeout.EventTimeTimeout)


def call_budget(calls: DataFrame, visit: list[str], order: list[str], most: int, free: Column) -> DataFrame:
    """Adds used and allowed: a running count of calls that are not free, per visit."""
    spent = F.sum((~free).cast("int")).over(Window.partitionBy(*visit).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("used", spent).withColumn("allowed", free | (F.col("used") <= most))


def dedupe_requests(requests: DataFrame, key: Column, ttl: str | None = None) -> DataFrame:
    """One row per request hash in front of an expensive stage; on a stream, within the watermark ``ttl``."""
    hashed = requests.withColumn("request", F.sha2(key, 256))
    if requests.isStreaming:
        return hashed.withWatermark("ts", ttl or "10 minutes").dropDuplicatesWithinWatermark(["request"])
    return hashed.dropDuplicates(["request"])


def answer_cache(requests: DataFrame, key: Column, kept: Column, seconds: int) -> DataFrame:
    """Adds hit to requests (ts, id): whether an answer that is kept was loaded for the same key in the ``seconds`` before.

    Only answers that ``kept`` approves stay, and a hit does not prolong one: an entry opens at the first request after
    the one before has run out. That is a fold along each key's requests, which keeps one time; keys that many requests
    share stream through their task in order and are never held.
    """
    rows = requests.withColumn("key__", F.sha2(key, 256)).withColumn("kept__", kept).withColumn("at__", F.unix_micros("ts"))
    kinds = requests.schema.simpleString()[len("struct<") : -1]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, until = None, 0
        for batch in batches:
            hits = []
            for k, at, keep in zip(batch["key__"], batch["at__"], batch["kept__"], strict=True):
                if k != last:
                    last, until = k, 0
                hits.append(until > at)
                if not hits[-1]:
                    until = at + seconds * 1_000_000 if keep else 0
            yield batch.drop(columns=["key__", "kept__", "at__"]).assign(hit=hits)

    return rows.repartition("key__").sortWithinPartitions("key__", "at__", *[c for c in requests.columns if c != "ts"][:1]).mapInPandas(fold, f"{kinds}, hit boolean")


def kv_state(changes: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """The key-value store at ``now`` from changes (op put or delete, ts, ttl seconds or null, value): the last change
    of each key, if it is a put that has not run out. One aggregation."""
    last = changes.where(F.col("ts") <= now).groupBy(*keys).agg(F.max_by(F.struct("op", "ts", "ttl", "value", "id"), F.struct("ts", "id")).alias("x")).select(*keys, "x.*")
    alive = F.col("ttl").isNull() | (F.unix_micros("ts") + F.col("ttl") * 1_000_000 > F.unix_micros(now))
    return last.where((F.col("op") == "put") & alive).select(*keys, "value", "id")
