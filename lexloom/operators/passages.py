"""Passages that texts hold word for word: an automaton over all passages of a block, one pass over the texts for each."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of passages in one automaton, about (some 100 bytes of memory each); a longer set takes more passes.
BLOCK = 2_000_000
_BUILT: dict[str, tuple] = {}


def blocks(passages: DataFrame, size: int = BLOCK) -> Iterator[list[tuple]]:
    """(id, text) of passages, in lists of about ``size`` characters: a set of queries, held a block at a time."""
    held, n = [], 0
    for key, text in passages.toLocalIterator():
        if text is None:
            continue
        held.append((key, text))
        n += len(text)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def automaton(name: str, passages: list[tuple]):
    """(automaton, ids by its values, ids of empty passages), built once by each worker and block (``name``)."""
    if name not in _BUILT:
        import ahocorasick

        of: dict[str, list] = {}
        for key, text in passages:
            of.setdefault(text, []).append(key)
        none = of.pop("", [])
        built = ahocorasick.Automaton()
        for k, text in enumerate(of):
            built.add_word(text, (k, len(text)))
        if of:
            built.make_automaton()
        _BUILT.clear()  # blocks come one after the other
        _BUILT[name] = built if of else None, list(of.values()), none
    return _BUILT[name]


def first_places(text: str, name: str, passages: list[tuple]) -> list[tuple]:
    """(id, start) of the first occurrence of every passage in a text."""
    built, ids, none = automaton(name, passages)
    found: dict[int, int] = {}
    for end, (k, n) in built.iter(text) if built else ():
        found.setdefault(k, end - n + 1)
    return [(key, at) for k, at in found.items() for key in ids[k]] + [(key, 0) for key in none]


def find_passages(docs: DataFrame, passages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id, start) for docs (doc_id, text) and passages (item_id, text): where each text first holds each
    passage. An empty passage is in every text; null texts and passages are in none. Texts are never shuffled."""
    spark = docs.sparkSession
    kinds = f"item_id {passages.dtypes[0][1]}, doc_id {docs.dtypes[0][1]}, start int"
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    item, doc = types[passages.dtypes[0][1]], types[docs.dtypes[0][1]]

    def finder(name: str, shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(key, own, at) for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text is not None for key, at in first_places(text, name, shared.value)]
                a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, item), pa.array(b, doc), pa.array(c, pa.int32())], names=["item_id", "doc_id", "start"])

        return run

    found = None
    for some in blocks(passages, block):
        part = docs.mapInArrow(finder(uuid.uuid4().hex, spark.sparkContext.broadcast(some)), kinds)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], kinds) if found is None else found
