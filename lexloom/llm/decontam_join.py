"""Decontamination against benchmarks of any size: the prefix join of ``decontam`` as a shuffle.

Two scans of the documents, however many windows there are. The first counts those shingles that a filter (bits of all
the benchmark's shingles) lets through; the counts are joined to the windows' shingles, and each window is listed under
its rarest. The second sends out the places in documents that a filter of the listed shingles lets through, with the
words around them; they meet the windows by shingle, and a window counts where all its words stand at the one start that
its shingle's place leaves. What a filter lets through wrongly is no one's shingle and meets nothing.

Shingles are 64-bit numbers here; unlike shingles that share a number only cost a comparison of words. The filters have
``MOST_BITS`` at most; beyond, they let more through, and nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PROBES = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
#: Bits of a filter for each shingle in it, the fewest, and the most (16 MB in a task).
BITS_EACH, FEWEST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27
#: Words whose numbers a task keeps before it starts anew (some 40 MB).
KEPT_WORDS = 300_000
#: Parts that a filter is made in; each comes to the driver for itself.
PARTS = 16


class Numbers:
    """Numbers of words and of shingles; the same everywhere."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words) - known.keys():
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def shingles(numbers: np.ndarray, width: int) -> np.ndarray:
    """The number of each run of ``width`` words."""
    n = max(0, len(numbers) - width + 1)
    code = np.full(n, width, np.uint64)
    for k in range(width):
        code = code * MULTIPLIER + numbers[k : k + n]
    return code


class Filter:
    """Bits by which to tell that a number was not put in."""

    def __init__(self, bits: int, raw: bytes | None = None):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.bits = np.zeros(bits, bool) if raw is None else np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)

    def add(self, codes: np.ndarray) -> None:
        for p in PROBES:
            self.bits[(codes * p) >> self.shift] = True

    def has(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), bool)
        for p in PROBES:
            found &= self.bits[(codes * p) >> self.shift]
        return found


def filter_of(codes: DataFrame) -> bytes:
    """The packed bits of a filter of (code)."""
    total = codes.count()
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << max(1, BITS_EACH * total).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            own.add(batch.column("code").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own.bits).tobytes()], pa.binary())], names=["raw"])

    packed = np.zeros(bits // 8, np.uint8)
    for row in codes.repartition(PARTS).mapInArrow(run, "raw binary").toLocalIterator():
        packed |= np.frombuffer(row["raw"], np.uint8)
    return packed.tobytes()


def _listing(shingle: int):
    """Windows to their shingles: (window, items, code, place, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            rows = []
            for text, items in zip(batch.column("words").to_pylist(), batch.column("items").to_pylist(), strict=True):
                own = text.encode().split(b" ")
                codes = shingles(numbers.of(own), min(shingle, len(own))).view(np.int64).tolist()
                rows += [(text, items, code, place, len(own)) for place, code in enumerate(codes)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["window", "items", "code", "place", "size"])

    return run


def _counting(shared, bits: int, widths: list[int], split):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = Filter(bits, shared.value), Numbers()
        for batch in batches:
            met = []
            for text in batch.column("text").to_pylist():
                n = numbers.of(split(text))
                for width in widths:
                    codes = shingles(n, width)
                    met.append(codes[own.has(codes)])
            codes, times = np.unique(np.concatenate(met), return_counts=True) if met else (np.empty(0, np.uint64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(times.astype(np.int64))], names=["code", "n"])

    return run


def _placing(shared, bits: int, widths: list[int], size: int, split):
    """Documents to (row, id, n_words), and to the places of listed shingles with up to ``size`` words on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = Filter(bits, shared.value), Numbers()
        for batch in batches:
            rows = []
            for row, name, text in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = split(text)
                n = numbers.of(words)
                rows.append((row, name, len(words), None, None, None, None))
                for width in widths:
                    codes = shingles(n, width)
                    for at in np.flatnonzero(own.has(codes)).tolist():
                        low = max(0, at - size)
                        around = b" ".join(words[low : at + size]).decode()
                        rows.append((row, None, None, int(codes[at].view(np.int64)), at, at - low, around))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            names = ["row", "id", "n_words", "code", "at", "inside", "around"]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names=names)

    return run


def hits(spark: SparkSession, docs: DataFrame, cut: DataFrame, size: int, shingle: int, split) -> DataFrame:
    """(id, n_words, n_hit, items) for docs (id, text binary) and windows (words, items); ``split`` cuts a text into words."""
    listed = materialize(cut.mapInArrow(_listing(shingle), "window string, items array<string>, code long, place int, size int"))
    widths = sorted(r[0] for r in listed.select(F.least("size", F.lit(shingle))).distinct().collect())  # ``shingle`` at most
    first = filter_of(listed.select("code").distinct())
    seen = docs.select("text").mapInArrow(_counting(spark.sparkContext.broadcast(first), 8 * len(first), widths, split), "code long, n long")
    counts = seen.groupBy("code").agg(F.sum("n").alias("n"))
    # The rarest shingle of a window, the first of equally rare ones; a window is told by its words.
    rank = F.struct(F.coalesce("n", F.lit(0)), "place")
    prefixes = materialize(listed.join(counts, "code", "left").groupBy("window").agg(F.min_by(F.struct("items", "code", "place", "size"), rank).alias("x")).select("window", "x.*"))
    second = filter_of(prefixes.select("code").distinct())
    placing = _placing(spark.sparkContext.broadcast(second), 8 * len(second), widths, size, split)
    placed = docs.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text").mapInArrow(placing, "row long, id long, n_words long, code long, at int, inside int, around string")
    placed = materialize(placed)

    met = placed.where("code is not null").select("row", "code", "at", "inside", "around").join(prefixes, "code")
    words: Column = F.split("around", " ")
    begins = F.col("inside") - F.col("place")
    fits = (begins >= 0) & (F.array_join(F.slice(words, F.greatest(begins, F.lit(0)) + 1, F.col("size")), " ") == F.col("window"))
    found = materialize(met.where(fits).select("row", (F.col("at") - F.col("place")).alias("start"), "size", "items"))
    # Words inside any occurrence: what each adds behind the farthest end so far, along a document's occurrences.
    along = Window.partitionBy("row").orderBy("start", "size")
    end = F.col("start") + F.col("size")
    upto = F.coalesce(F.max(end).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    added = F.greatest(F.lit(0), end - F.greatest("start", upto))
    covered = found.select("row", "start", "size").distinct().withColumn("added", added).groupBy("row").agg(F.sum("added").alias("n_hit"))
    names = found.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    whole = placed.where("code is null").select("row", "id", "n_words").join(covered, "row", "left").join(names, "row", "left")
    none = F.array().cast("array<string>")
    return whole.select("id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))
