"""The key-value store and the rate limits as streams, with state that ends by itself.

Both are ``transformWithStateInPandas`` operators: they want a state store of columns
(``spark.sql.streaming.stateStore.providerClass`` set to RocksDB's). A stream gives the rows that the table versions give for
the same changes, micro-batch by micro-batch, restarts included.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_columns(spark: SparkSession) -> None:
    """The state store that these operators need, unless the session names one already."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, ROCKS)


class Store(StatefulProcessor):
    """The value of a key: the last change in event time counts (ties: the larger id), a put's lifetime ends by a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "op string, at long, id long, until long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.held.get() if self.held.exists() else None
        now = before
        for batch in rows:
            for op, at, own, ttl, value in zip(batch["op"], batch["at"], batch["id"], batch["ttl"], batch["value"], strict=True):
                if now is None or (at, own) > (now[1], now[2]):
                    now = (op, int(at), int(own), -1 if pd.isna(ttl) else int(at) + int(ttl) * 1_000_000, None if pd.isna(value) else float(value))
        if now == before:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update(now)
        if now[0] == "put" and now[3] >= 0:
            # The end of a lifetime is not part of it.
            self.handle.registerTimer(-(-now[3] // 1000))
        alive = now[0] == "put"
        yield pd.DataFrame({"key": [key[0]], "id": [now[2]], "value": [now[4] if alive else None], "alive": [alive]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.held.get()
        if now[0] == "put" and 0 <= now[3] <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            # The change stays, so that a late one before it does not bring an older value back; its value goes.
            self.held.update(("ended", now[1], now[2], -1, None))
            yield pd.DataFrame({"key": [key[0]], "id": [now[2]], "value": [None], "alive": [False]})

    def close(self) -> None:
        pass


def kv_stream(changes: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(key, id, value, alive) whenever the state of a key changes, from a stream of changes (key string, ts, id long, op
    put or delete, ttl in seconds or null, value double). Lifetimes run in event time, behind the watermark."""
    use_columns(changes.sparkSession)
    timed = changes.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithStateInPandas(Store(), "key string, id long, value double, alive boolean", "Update", "EventTime")


class Limiter(StatefulProcessor):
    """Requests of a client, by route: the first of each window are allowed. Counters end with their window."""

    def __init__(self, routes: dict[str, tuple[int, int]]):
        self.routes = routes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "route string, window long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Requests are in order inside a micro-batch; a client's requests of one are bounded by its trigger.
        asked = pd.concat(list(rows)).sort_values(["at", "id"])
        allowed, remaining, resets = [], [], []
        for route, at in zip(asked["route"], asked["at"], strict=True):
            most, seconds = self.routes[route]
            window = at // 1_000_000 // seconds * seconds
            held = (route, int(window))
            n = self.used.getValue(held)[0] if self.used.containsKey(held) else 0
            allowed.append(n < most)
            if n < most:
                self.used.updateValue(held, (n + 1,))
                if not n:
                    self.handle.registerTimer(int(window + seconds) * 1000)
            remaining.append(max(0, most - n - 1))
            resets.append(window + seconds - at // 1_000_000)
        yield pd.DataFrame({"client": key[0], "id": asked["id"], "route": asked["route"], "allowed": allowed, "remaining": remaining, "reset_seconds": resets})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for route, window in [k for k in self.used.keys() if (k[1] + self.routes[k[0]][1]) * 1000 <= expiredTimerInfo.getExpiryTimeInMs()]:
            self.used.removeKey((route, window))
        yield from ()

    def close(self) -> None:
        pass


def route_limit_stream(requests: DataFrame, routes: dict[str, tuple[int, int]], delay: str = "0 seconds") -> DataFrame:
    """(client, id, route, allowed, remaining, reset_seconds) of a stream of requests (client string, ts, id long, route),
    with each route's own limit and window. Requests of routes without a limit are left out."""
    use_columns(requests.sparkSession)
    known = requests.where(F.col("route").isin(*routes)).withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    kinds = "client string, id long, route string, allowed boolean, remaining int, reset_seconds long"
    return known.groupBy("client").transformWithStateInPandas(Limiter(routes), kinds, "Append", "EventTime")
