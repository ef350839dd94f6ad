"""Caches of answers: which requests one would have answered, over a table of requests in order.

Requests of a visit (or of a server process) pass through one task in their order and are never held: what is kept is
the cache's own entries, or one number for each distinct key of the visit.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class LastUses:
    """Distinct keys used since a key's last use, by a tree of sums over the places of last uses (Fenwick, 1994)."""

    def __init__(self, size: int = 1024):
        self.last: dict[object, int] = {}
        self.tree = np.zeros(size + 1, np.int64)
        self.now = 0

    def _add(self, place: int, n: int) -> None:
        while place < len(self.tree):
            self.tree[place] += n
            place += place & -place

    def _upto(self, place: int) -> int:
        total = 0
        while place:
            total += self.tree[place]
            place -= place & -place
        return int(total)

    def _renumber(self) -> None:
        """Give the last uses the places 1, 2, ..., so that places stay within twice the number of keys."""
        self.last = {k: n + 1 for n, (k, _) in enumerate(sorted(self.last.items(), key=lambda x: x[1]))}
        self.now = len(self.last)
        self.tree = np.zeros(max(1024, 2 * self.now) + 1, np.int64)
        for place in range(1, self.now + 1):
            self._add(place, 1)

    def use(self, key: object) -> int | None:
        """The distance of this use (0: the key was the last one used), None for the first use of a key."""
        if self.now + 1 >= len(self.tree):
            self._renumber()
        before = self.last.get(key)
        distance = None
        if before is not None:
            distance = len(self.last) - self._upto(before)
            self._add(before, -1)
        self.now += 1
        self.last[key] = self.now
        self._add(self.now, 1)
        return distance


class AnswerCache:
    """Entries by least recent use, each with a lifetime. A load opens an entry at once, which may push another one out;
    the entry goes again if its answer is not kept. A hit makes an entry the most recent, and does not prolong it."""

    def __init__(self, entries: int, life: int):
        self.entries, self.life = entries, life
        self.until: OrderedDict[object, int] = OrderedDict()

    def ask(self, key: object, at: int, kept: bool) -> bool:
        until = self.until.get(key)
        if until is not None and until > at:
            self.until.move_to_end(key)
            return True
        self.until.pop(key, None)
        self.until[key] = at + self.life
        while len(self.until) > self.entries:
            self.until.popitem(last=False)
        if not kept:
            self.until.pop(key, None)
        return False


def _along(requests: DataFrame, visit: Column, key: Column, order: list[str], more: dict[str, Column], start: Callable[[], Callable], kind: str) -> DataFrame:
    """Adds a column that a function gives for each request of a visit in order; ``start`` makes one for each visit."""
    own = {"visit__": visit.cast("string"), "key__": F.sha2(key, 256), **more}
    rows = requests.withColumns(own)
    name, kinds, used, is_long = kind.split(" ")[0], requests.schema.simpleString()[len("struct<") : -1], [*own], "long" in kind

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = object(), None
        for batch in batches:
            found = []
            for v, *args in zip(*(batch[c] for c in used), strict=True):
                if v != last:
                    last, step = v, start()
                found.append(step(*args))
            made = pd.Series(found, dtype="Int64" if is_long else "bool", index=batch.index)
            yield batch.drop(columns=used).assign(**{name: made})

    return rows.repartition("visit__").sortWithinPartitions("visit__", *order).mapInPandas(run, f"{kinds}, {kind}")


def reuse_distance(requests: DataFrame, visit: Column, key: Column, order: list[str]) -> DataFrame:
    """Adds distance: how many other keys the visit asked for since it last asked for this one; null at the first time.

    A cache of the last n answers has just those requests whose distance is below n: one pass serves all sizes.
    ``order`` must tell a visit's requests apart. A null visit is a visit, a null key a key.
    """
    return _along(requests, F.coalesce(visit.cast("string"), F.lit("")), F.coalesce(key, F.lit("")), order, {}, lambda: LastUses().use, "distance long")


def answer_cache(requests: DataFrame, place: Column, key: Column, kept: Column, entries: int, seconds: int, order: list[str]) -> DataFrame:
    """Adds hit: whether a cache of so many entries with a lifetime answers a request (with ``ts``) at its place."""
    more = {"at__": F.unix_micros("ts"), "kept__": F.coalesce(kept, F.lit(False))}
    return _along(requests, F.coalesce(place.cast("string"), F.lit("")), F.coalesce(key, F.lit("")), order, more, lambda: AnswerCache(entries, seconds * 1_000_000).ask, "hit boolean")
