"""Token counts of a BPE piece vocabulary, by merging over a linked list with a heap; no identifiers are made.

A text's spaces become the space mark and one mark goes in front. Its characters are the first symbols; the adjacent
pair of the lowest rank (best score, then leftmost) merges, again and again, until no pair is in the vocabulary. The
count is the number of symbols less the merges, where a character without a piece counts its UTF-8 bytes.

As no piece of the vocabulary has a mark behind another character (checked when it is loaded), no merge crosses the
start of a word, and words can be counted one by one; counts of words seen are kept, up to a bound.

Cases. Null counts as empty: 0 bytes, 0 tokens. Strings of special tokens inside texts are ordinary text, as the
library takes them. Texts of any length are counted whole: time grows as n log n of the longest run without spaces.
Repeated rows and ids stay; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
LIMIT = 4096
#: Words whose counts a worker keeps before it starts anew (some 60 MB).
KEPT_WORDS = 400_000


class PieceCounter:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        normal = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: Lower is better.
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in normal}
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.rank)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.known: dict[str, int] = {}
        if model.normalize("Aﬁ  ½ ") != f"{MARK}Aﬁ{MARK}{MARK}½{MARK}":
            raise ValueError("only models that keep their text as it is, with one mark in front, are supported")

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.merged(marked)
        known, total = self.known, 0
        for word in self.words.findall(marked):
            n = known.get(word)
            if n is None:
                n = self.merged(word)
                if len(word) < 64:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                    known[word] = n
            total += n
        return total

    def merged(self, symbols: str) -> int:
        """Symbols left after all merges, each without a piece counted by its bytes."""
        rank = self.rank
        n = len(symbols)
        part = list(symbols)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(symbols[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, 2))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, j, size = heapq.heappop(heap)
            # Either side may have merged since: then the sizes no longer fit.
            if not part[i] or not part[j] or len(part[i]) + len(part[j]) != size:
                continue
            merges += 1
            part[i] += part[j]
            part[j] = ""
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                joined = part[i] + part[k]
                r = rank.get(joined)
                if r is not None:
                    heapq.heappush(heap, (r, i, k, len(joined)))
            h = before[i]
            if h >= 0:
                joined = part[h] + part[i]
                r = rank.get(joined)
                if r is not None:
                    heapq.heappush(heap, (r, h, i, len(joined)))
        return n - merges + sum(len(p.encode()) - 1 for p in part if p and p not in rank)


_COUNTERS: dict[str, PieceCounter] = {}


def counter(model_file: str) -> PieceCounter:
    """One per worker process."""
    if model_file not in _COUNTERS:
        _COUNTERS[model_file] = PieceCounter(model_file)
    return _COUNTERS[model_file]


def token_counts(docs: DataFrame, model_file: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit. ``model_file`` must be at the same place on executors."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file).count
        for batch in batches:
            tokens = np.fromiter((count(t) for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(tokens), pa.array(tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
