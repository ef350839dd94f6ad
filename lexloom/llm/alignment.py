"""Alignment of two tokenizers over the same bytes.

A text is encoded by a byte-level vocabulary (A) and by a vocabulary of pieces with byte fallback (B). Both cut the same
bytes; a merge of the two ascending lists of token ends gives the groups (cuts that both make) and the links (pairs of
tokens whose byte ranges overlap: one for each stretch between neighbouring ends of either). Spark counts the links of
each pair of ids over the corpus, finds each B id's largest count, and joins both back to the documents.

A pair of ids is one integer. A document carries its pairs once each, with how often it has them, through a table in the
shared folder; so a pair that all documents hold counts a row a document, not a link. Pairs with more than one in
``COMMON`` of all links, of which there are fewer than ``COMMON`` whatever the corpus, meet the documents by a broadcast;
all others by shuffle, where no pair can have more rows than that share.

Cases. Texts null or empty, and those whose A or B bytes are not the text's with a space in front (the piece vocabulary
takes U+2581 for a space), have no tokens: zeros and an empty string. Strings of special tokens are plain text. Texts of
any length are taken whole. Rows that repeat an id, or have none, are rows of their own. An empty table gives an empty
result. Only the id and text columns are read; other columns do not matter.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, small_batches

#: Pairs that are broadcast: fewer than this many (16 bytes each).
COMMON = 1_000_000
ALIGNED = "id long, n_a long, n_b long, n_groups long, groups string, pairs array<int>, times array<int>"
#: Texts that are encoded and aligned together.
TOGETHER = 200


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes as: printable Latin-1 bytes stand for themselves,
    all others are numbered from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class Bytes:
    """A byte-level vocabulary: ids of texts and each id's bytes. Strings of special tokens are plain text.

    Where merges stand in the order of what they make, as they do in vocabularies of this kind, ids are ranks, and the
    tiktoken library merges by them, four times as fast; all else, and texts with long runs of white space (which its
    pattern takes too much memory for), go to the tokenizers library.
    """

    #: Fixed value: the pattern that byte-level vocabularies cut texts by.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    SPACES = 1000

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        config = json.loads(Path(tokenizer_file).read_text(encoding="utf-8"))
        model, pre, special = config["model"], config.get("pre_tokenizer") or {}, {x["content"] for x in config.get("added_tokens", [])}
        self.library = Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        letters, vocabulary = byte_letters(), self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.bytes[k] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        ranked = made == list(range(256, 256 + len(made))) and not model.get("dropout") and not model.get("ignore_merges")
        self.fast = None
        if ranked and not config.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            import tiktoken

            ranks = {self.bytes[k]: k for piece, k in vocabulary.items() if piece not in special}
            self.fast = tiktoken.Encoding("byte_level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced = re.compile(rf"\s{{{self.SPACES}}}")

    def encode(self, text: str) -> list[int]:
        if self.fast is None or (len(text) > self.SPACES and self.spaced.search(text)):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class Pieces:
    """The piece vocabulary: ids of texts and each id's bytes."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes = [self._bytes(k) for k in range(self.model.get_piece_size())]

    def _bytes(self, k: int) -> bytes:
        piece = self.model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Table:
    """Byte strings by number, written one after the other for arrays of numbers."""

    def __init__(self, items: list[bytes]):
        self.size = np.array([len(x) for x in items], np.int64)
        self.begun = np.append(0, np.cumsum(self.size))[:-1]
        self.raw = np.frombuffer(b"".join(items), np.uint8)

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.size[numbers]
        begun = np.append(0, np.cumsum(sizes))
        return self.raw[np.repeat(self.begun[numbers] - begun[:-1], sizes) + np.arange(begun[-1])]


class Aligner:
    """Tokens of texts by both vocabularies, their groups and links."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.b = Bytes(a_file), Pieces(b_file)
        self.a_bytes, self.b_bytes = self.a.bytes, self.b.bytes
        self.base = len(self.b_bytes)
        if len(self.a_bytes) * self.base >= 1 << 31:
            raise ValueError("a pair of ids does not fit into an integer")
        self.a_table, self.b_table = Table(self.a_bytes), Table(self.b_bytes)
        # An id's text inside a group, then all ids' texts at a group's end.
        self.a_text, self.b_text = (np.array([f"{k}{mark}" for mark in marks for k in range(n)], "S8") for n, marks in ((len(self.a_bytes), ",|"), (self.base, ",;")))

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, groups, pairs, times) for each text; pairs ascend."""
        for text, b in zip(texts, self.b.encode([t or "" for t in texts]), strict=True):
            led = " " + (text or "")
            a, b, want = np.array(self.a.encode(led), np.int64), np.array(b, np.int64), np.frombuffer(led.encode(), np.uint8)
            if not text or not np.array_equal(self.a_table.joined(a), want) or not np.array_equal(self.b_table.joined(b), want):
                yield 0, 0, 0, "", a[:0], a[:0]
            else:
                yield self.aligned(a, b)

    def aligned(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        """Merge the ends of both: every end of either closes one link, every end of both closes one group."""
        a_end, b_end = np.cumsum(self.a_table.size[a]), np.cumsum(self.b_table.size[b])
        mark = np.zeros(int(a_end[-1]) + 1, np.int8)  # which side ends at a byte: 1 A, 2 B, 3 both
        mark[a_end] = 1
        mark[b_end] += 2
        sides = mark[mark > 0]
        # The pointer into either side at an end: tokens of the side that ended before it.
        of_a, of_b = sides & 1, sides >> 1
        pairs, times = np.unique(a[np.cumsum(of_a, dtype=np.int64) - of_a] * self.base + b[np.cumsum(of_b, dtype=np.int64) - of_b], return_counts=True)
        shut_a, shut_b = mark[a_end] == 3, mark[b_end] == 3
        # A token's place in the text of groups: its own number, and the other side's tokens of the groups before it
        # (of A, which comes first in a group, also of its own group).
        upto_a, upto_b = np.append(0, np.flatnonzero(shut_a) + 1), np.append(0, np.flatnonzero(shut_b) + 1)
        group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        out = np.empty(len(a) + len(b), self.a_text.dtype)
        out[np.arange(len(a)) + upto_b[group_a]] = self.a_text[a + shut_a * len(self.a_bytes)]
        out[np.arange(len(b)) + upto_a[group_b + 1]] = self.b_text[b + shut_b * self.base]
        letters = out.view(np.uint8)
        return len(a), len(b), len(upto_a) - 1, letters[letters > 0][:-1].tobytes().decode(), pairs, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One per worker process."""
    if (a_file, b_file) not in _ALIGNERS:
        _ALIGNERS[a_file, b_file] = Aligner(a_file, b_file)
    return _ALIGNERS[a_file, b_file]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(x) for x in arrays]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays), pa.int32()))


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``: ids of A and B in order), pairs (A id times
    the size of B, plus B id, ascending) and times (how many links of the document hold the pair).

    The files must be at the same place on all executors.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_file, b_file)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                n_a, n_b, n_groups, groups, pairs, times = zip(*own.texts(some.column("text").to_pylist()), strict=True)
                counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)]
                yield pa.RecordBatch.from_arrays([some.column("id"), *counts, pa.array(groups, pa.string()), _lists(pairs), _lists(times)], names=["id", "n_a", "n_b", "n_groups", "groups", "pairs", "times"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ALIGNED).withColumnRenamed("id", id_col)


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(pair, n, is_best): links of each pair over all documents, and whether no pair of its B id has more."""
    links = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.*")
    counts = materialize(links.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")))
    b = (F.col("pair") % base).alias("b")
    most = counts.groupBy(b).agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))


def with_link_counts(aligned: DataFrame, base: int, common: int = COMMON) -> DataFrame:
    """``aligned`` with n_links, n_best (links whose count is their B id's highest) and count_sum (over links) in place
    of pairs and times. ``aligned`` is read several times: it is written to the shared folder first."""
    spark = aligned.sparkSession
    path = posixpath.join(shared_dir(spark), f"aligned-{uuid.uuid4().hex}")
    aligned.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    counts = materialize(pair_counts(rows, base))
    least = (counts.agg(F.sum("n")).first()[0] or 0) / common
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    # Fewer than ``common`` pairs have more than that share of the links.
    known = F.broadcast(counts.where(F.col("n") > least).select("pair", F.col("n").alias("own"), F.col("is_best").alias("own_best")))
    met = links.join(known, "pair", "left")
    score = lambda n, best: (F.sum(F.when(best, F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * n).alias("count_sum"))
    often = met.where("own is not null").groupBy("row").agg(*score(F.col("own"), F.col("own_best")))
    rare = met.where("own is null").select("row", "pair", "times").join(counts.where(F.col("n") <= least), "pair").groupBy("row").agg(*score(F.col("n"), F.col("is_best")))
    found = often.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    total = F.aggregate("times", F.lit(0).cast("long"), lambda s, x: s + x)
    kept = rows.withColumn("n_links", total).drop("pairs", "times")
    zero = {"n_best": 0, "count_sum": 0}
    return kept.join(found, "row", "left").fillna(zero).drop("row")


def alignment(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups, or their SHA-256 (``groups_sha256``,
    empty without tokens) where the text of the groups is not wanted."""
    import sentencepiece

    rows = align(docs, a_file, b_file, id_col, text_col)
    if digest:
        rows = rows.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    return with_link_counts(rows, sentencepiece.SentencePieceProcessor(model_file=b_file).get_piece_size())
