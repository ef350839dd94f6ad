"""Benchmark decontamination by a prefix-filtered join of word shingles.

A benchmark item is cut into windows of 13 words (an item of fewer words is one window). A window occurs in a
document only if all its shingles do, so it is enough to join on one of them, its rarest (the prefix of a containment
join with threshold 1): shingles are ordered by how often they occur in all documents. A shingle met in a document
places each window listed under it; the length bound (the window must fit) and the positional bound (it starts where
the shingle's place in the window says) leave one start per pair, and the words there are compared one by one.

A benchmark of at most ``block`` windows is sent to all tasks: documents are never shuffled, and each is handled by itself
whatever passages it shares. A larger one meets the documents by shuffle (``decontam_join``), on the same prefixes.

Cases. Texts of any length are taken whole; columns other than id and text do not matter. Null and wordless documents have 0 words and are clean; null and wordless items have no windows. Items that
share windows are all hit; rows that repeat an item_id count as one item, and a null item_id reads as an empty string.
Repeated documents keep their rows. Empty tables on either side give clean documents or no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decontam_join
from .common import materialize, small_batches

WINDOW = 13
SHINGLE = 3
#: Windows that are sent to all tasks; with 13 words each, some 30 MB.
BLOCK = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same on bytes: A-Z become a-z, other ASCII but digits and a-z become spaces.
TABLE = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters else b if b > 127 or chr(b) in string.digits else 32 for b in range(256))
STATE = "id long, n_words long, n_hit long, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(words, items): each distinct window and the ids of the items that hold it."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    found = F.filter(F.split(F.regexp_replace(text, NOT_WORD, " "), " "), lambda w: w != "")
    cut = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), found.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    cut = cut.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("words"))
    return cut.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Matcher:
    """A block of windows as numbers: words numbered from 1, 0 for any other word."""

    def __init__(self, block: list[tuple[str, list[str]]], shingle: int = SHINGLE):
        self.number: dict[bytes, int] = {}
        number = self.number
        self.windows = [np.array([number.setdefault(w, len(number) + 1) for w in text.encode().split(b" ")]) for text, _ in block]
        self.items = [items for _, items in block]
        self.base = len(number) + 1
        if self.base ** shingle >= 1 << 63:
            raise ValueError("too many words in a block")
        self.widths = sorted({min(shingle, len(w)) for w in self.windows})
        #: By width: the shingles of the block's windows, and for each window their places in that list.
        self.tokens: dict[int, np.ndarray] = {}
        self.places: list[np.ndarray] = [np.empty(0)] * len(block)
        for width in self.widths:
            own = [k for k, w in enumerate(self.windows) if min(shingle, len(w)) == width]
            codes = [self.codes(self.windows[k], width) for k in own]
            self.tokens[width] = np.unique(np.concatenate(codes))
            for k, c in zip(own, codes, strict=True):
                self.places[k] = np.searchsorted(self.tokens[width], c)

    def codes(self, ids: np.ndarray, width: int) -> np.ndarray:
        """Each run of ``width`` words as one number; -1 if it has a word that is in no window."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.empty(0, dtype=np.int64)
        code, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        for k in range(width):
            code = code * self.base + ids[k : k + n]
            known &= ids[k : k + n] > 0
        return np.where(known, code, -1)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts in a row, a 0 behind each text, and the number of words of each."""
        get = self.number.get
        rows, sizes = [], []
        for text in texts:
            found = words(text)
            sizes.append(len(found))
            row = [get(w, 0) for w in found]
            row.append(0)
            rows.append(np.array(row, dtype=np.int64))
        return np.concatenate(rows) if rows else np.empty(0, dtype=np.int64), np.array(sizes, dtype=np.int64)

    def met(self, ids: np.ndarray, width: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``ids`` where a run is one of ``tokens`` (sorted), and which."""
        codes = self.codes(ids, width)
        at = np.flatnonzero(codes >= 0)
        which = np.searchsorted(tokens, codes[at])
        which[which == len(tokens)] = 0
        hit = tokens[which] == codes[at] if len(tokens) else np.zeros(len(at), dtype=bool)
        return at[hit], which[hit]

    def choose(self, counts: dict[int, np.ndarray], shingle: int = SHINGLE) -> None:
        """List every window under its rarest shingle, the first of equally rare ones."""
        self.index = {}
        for width in self.widths:
            own = [k for k, w in enumerate(self.windows) if min(shingle, len(w)) == width]
            best = [int(np.argmin(counts[width][self.places[k]])) for k in own]
            token = np.array([self.places[k][b] for k, b in zip(own, best, strict=True)])
            order = np.argsort(token, kind="stable")
            prefixes, first = np.unique(token[order], return_index=True)
            self.index[width] = (self.tokens[width][prefixes], np.append(first, len(order)), np.array(own)[order], np.array(best)[order])
        longest = max((len(w) for w in self.windows), default=0)
        self.lengths = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.matrix = np.zeros((len(self.windows), longest), dtype=np.int64)
        for k, w in enumerate(self.windows):
            self.matrix[k, : len(w)] = w

    def occurrences(self, ids: np.ndarray, chunk: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(starts, windows) for all occurrences of windows in ``ids``, in pieces."""
        for width, (prefixes, first, window, offset) in self.index.items():
            at, which = self.met(ids, width, prefixes)
            many = first[which + 1] - first[which]
            done = np.append(0, np.cumsum(many))
            # Pieces of so many candidates that memory stays small also where one run of words lists many windows.
            cuts = [0, *np.unique(np.searchsorted(done, np.arange(chunk, done[-1], chunk))).tolist(), len(at)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                n = many[a:b]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                listed = np.repeat(first[which[a:b]], n) + inside
                w = window[listed]
                start = np.repeat(at[a:b], n) - offset[listed]
                fits = (start >= 0) & (start + self.lengths[w] <= len(ids))
                start, w = start[fits], w[fits]
                for k in range(self.matrix.shape[1]):
                    more = self.lengths[w] > k
                    same = ~more
                    same[more] = ids[start[more] + k] == self.matrix[w[more], k]
                    start, w = start[same], w[same]
                yield start, w


def _counting(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums = {w: np.zeros(len(t), dtype=np.int64) for w, t in m.tokens.items()}
        for batch in batches:
            ids, _ = m.ids(batch.column("text").to_pylist())
            for width, tokens in m.tokens.items():
                sums[width] += np.bincount(m.met(ids, width, tokens)[1], minlength=len(tokens))
        for width, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), width), pa.int64()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["width", "token", "n"])

    return run


def _marking(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = m.ids(batch.column("text").to_pylist())
            ends = np.cumsum(sizes + 1)
            begins = ends - sizes - 1
            edge = np.zeros(len(ids) + 1, dtype=np.int64)
            met: list[np.ndarray] = []
            for start, w in m.occurrences(ids):
                np.add.at(edge, start, 1)
                np.add.at(edge, start + m.lengths[w], -1)
                doc = np.searchsorted(ends, start, side="right")
                met.append(np.unique(doc * len(m.windows) + w))
            covered = np.cumsum(edge[:-1]) > 0
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for pair in np.unique(np.concatenate(met)).tolist() if met else ():
                items[pair // len(m.windows)].update(m.items[pair % len(m.windows)])
            hits = [int(covered[a : a + n].sum()) for a, n in zip(begins.tolist(), sizes.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["id", "n_words", "n_hit", "items"]
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted ids), n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    cut = materialize(windows(benchmark, size))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    if cut.count() > block:
        return _columns(decontam_join.hits(spark, rows, cut, size, SHINGLE, words), share, id_col)
    own = [(r["words"], r["items"]) for r in cut.orderBy("words").toLocalIterator()]
    m = Matcher(own)
    shared = spark.sparkContext.broadcast(m)
    counts = {w: np.zeros(len(t), dtype=np.int64) for w, t in m.tokens.items()}
    if own:
        seen = rows.select("text").mapInArrow(_counting(shared), "width long, token long, n long")
        for r in seen.groupBy("width", "token").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["width"]][r["token"]] = r["n"]
    m.choose(counts)
    # Sent anew with the index chosen; no row is marked without it.
    state = rows.mapInArrow(_marking(spark.sparkContext.broadcast(m)), STATE)
    shared.unpersist()
    return _columns(state, share, id_col)


def _columns(state: DataFrame, share: int, id_col: str) -> DataFrame:
    listed: Column = F.array_join("items", ",")
    return state.select(
        F.col("id").alias(id_col), "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS s
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, i, n, item FROM grams JOIN win USING (n, s)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS u(p) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
