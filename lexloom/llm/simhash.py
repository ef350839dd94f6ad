"""SimHash near-dedup through an inverted index on byte positions.

A fingerprint has 8 bytes. Two that differ in at most 3 bits agree in at least 5 byte positions. Of the 70 sets of 4
positions, 14 (the planes of the 3-bit cube, whose places XOR to zero) are enough for any 5 positions to contain one:
each fingerprint is posted under the 4 bytes of each of these 14 sets, a list of 2^32 times fewer pairs than all. Per
pair met in a list the shared positional bytes are tallied; 5 or more are kept, and the bits verified.

Equal fingerprints are one class, entered once; the links between classes give components. Long lists (of near copies
that all have fingerprints of their own) do not write out their pairs: from one fingerprint after the other, those of
the list that it links and that nothing reached before are linked, m - 1 links at most for m fingerprints, which leave
the list's components what they are. Lists of more than ``LONG`` are cut by a fifth byte, which linked pairs share too,
in each of the four places outside the list's own where it may be: before the shuffle where a sample of the fingerprints
shows that a list is hot, so that it is dealt over 1,024 lists, in its task otherwise. In a cut of more than ``LONG``
five bytes are fixed, and fingerprints are points of 24 bits: those linked to one are looked up in a table of the points,
so that time is linear in a list's length, whatever the list holds.

Cases. Texts of any length are fingerprinted whole. Null and blank texts have fingerprint zero and link like any other. Shingles that repeat count each time.
Rows that repeat an id keep their rows. A row with a null id takes part, but never names a component unless no other
row of it has an id. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import about, materialize, small_batches
from .components import components

BYTES = 8
#: Sets of 4 of 8 byte positions of which any 5 positions hold one.
PLANES = [p for p in itertools.combinations(range(BYTES), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
CHUNK = 1 << 16
#: Lists up to this length write out all their links; longer ones only what joins their members.
SHORT = 8
#: Lists over this length are cut by a further byte, and cuts over this length are looked up in a table.
LONG = 4096
#: Fingerprints (about) in the sample that finds hot lists, and those of one list in it that make it hot. It decides only
#: where a list is cut, and never what is linked; there are at most 14 * 100,000 / 20 = 70,000 hot lists (560 KB).
SAMPLE, OFTEN = 100_000, 20
#: A fingerprint of more than one in so many rows is hot; there are fewer than that many, whatever the table's size.
HOT = 1000


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of word shingles: a bit is 1 if it is in over half of the shingles' hashes."""
    words = text.lower().split()  # bytes: only A-Z and only the six separators
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1))[: len(words) - width + 1].tolist()
        ends = np.append(gaps, len(joined))[width - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), CHUNK):
        raw = np.array(hashes[k : k + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), pa.array(marks.view(np.int64))], names=["id", "row", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(id, row, fp) for every row; fp holds the 64 bits as a long."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    row = F.col(row_col) if row_col else F.lit(None).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), text.alias("text")).mapInArrow(_fingerprints, "id long, row long, fp long")


def _byte(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(255)


def _lists(marks: Column) -> list[Column]:
    """The list of each plane: the 4 bytes of a fingerprint there, and the plane's number in the upper half."""
    keys = []
    for n, plane in enumerate(PLANES):
        key = F.lit(n).cast("long")
        for k in plane:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(marks, k))
        keys.append(key)
    return keys


def _hot_lists(classes: DataFrame) -> DataFrame:
    """(hot): lists that hold at least a share of OFTEN / SAMPLE of the fingerprints, as a sample shows them."""
    some = about(classes, "fp", SAMPLE, 11)
    counts = some.select(F.explode(F.array(*_lists(F.col("fp")))).alias("hot")).groupBy("hot").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > OFTEN).select("hot")


def _postings(classes: DataFrame) -> DataFrame:
    """(fp, key, cut): each fingerprint under the 4 bytes of each plane; in hot lists once for each of the four other
    bytes, whose place and value are the cut (-1 in all other lists)."""
    fp = F.col("fp")
    posts = classes.select("fp", F.posexplode(F.array(*_lists(fp))).alias("n", "key"))
    posts = posts.join(F.broadcast(materialize(_hot_lists(classes))), F.col("key") == F.col("hot"), "left")
    cut = lambda k: (_byte(fp, k) + 256 * k).cast("int")
    cuts = F.array(*[F.array(*[cut(k) for k in range(BYTES) if k not in plane]) for plane in PLANES])
    return posts.select("fp", "key", F.explode(F.when(F.col("hot").isNull(), F.array(F.lit(-1))).otherwise(F.get(cuts, F.col("n")))).alias("cut"))


def _near(differ: np.ndarray, bits: int) -> np.ndarray:
    """Whether differences of pairs leave enough bytes the same, and then few enough bits unlike."""
    alike = (differ[..., None].view(np.uint8) == 0).sum(axis=-1)
    return (alike >= BYTES - bits) & (np.bitwise_count(differ) <= bits)


def reach(marks: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (a, b) that join what a list's links join, each fingerprint being reached once."""
    left = marks
    while len(left) > 1:
        waiting, left = [left[0]], left[1:]
        while waiting and len(left):
            at = waiting.pop()
            near = _near(left ^ at, bits)
            if near.any():
                found = left[near]
                yield np.full(len(found), at), found
                waiting.extend(found)
                left = left[~near]


def masks(bits: int) -> np.ndarray:
    """All differences of 1 to ``bits`` of 24 bits: 2,324 for 3."""
    return np.array([sum(1 << b for b in x) for n in range(1, bits + 1) for x in itertools.combinations(range(24), n)], np.uint32)


def reach_cut(marks: np.ndarray, free: list[int], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``reach`` for distinct fingerprints that differ in the three ``free`` bytes only: links of a point are looked up
    in a table of 2^24 points (16 MB), 2,324 look-ups for each fingerprint."""
    whole = marks[:, None].view(np.uint8)
    points = sum(whole[:, k].astype(np.uint32) << (8 * n) for n, k in enumerate(free))
    base = int(marks[0]) & ~sum(0xFF << (8 * k) for k in free)

    def at(points: np.ndarray) -> np.ndarray:
        out = np.full(len(points), base, np.uint64)
        for n, k in enumerate(free):
            out |= ((points >> np.uint32(8 * n)) & np.uint32(255)).astype(np.uint64) << np.uint64(8 * k)
        return out

    waiting = np.zeros(1 << 24, bool)  # points that nothing reached yet
    waiting[points] = True
    steps = masks(bits)
    for begun in points.tolist():
        if not waiting[begun]:
            continue
        waiting[begun] = False
        front = np.array([begun], np.uint32)
        while len(front):
            now, front = front[:256], front[256:]
            beside = now[:, None] ^ steps
            a, b = np.nonzero(waiting[beside])
            found, first = np.unique(beside[a, b], return_index=True)
            if len(found):
                waiting[found] = False
                yield at(now[a[first]]), at(found)
                front = np.concatenate([front, found])


def _list_links(marks: np.ndarray, bits: int, plane: tuple[int, ...], cut: int = -1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join a list's members. All agree in the bytes of ``plane``, and in that of ``cut`` unless it is -1."""
    if len(marks) <= LONG:
        yield from reach(marks, bits)
        return
    others = [k for k in range(BYTES) if k not in plane]
    if cut >= 0:
        yield from reach_cut(marks, [k for k in others if k != cut // 256], bits)
        return
    for place in others:
        own = marks[:, None].view(np.uint8)[:, place]
        order = np.argsort(own, kind="stable")
        for part in np.split(marks[order], np.flatnonzero(np.diff(own[order])) + 1):
            yield from _list_links(part, bits, plane, place * 256)


def _linking(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, cuts: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links of whole lists."""
            edges = np.flatnonzero((np.diff(keys) != 0) | (np.diff(cuts) != 0)) + 1
            starts, ends = np.append(0, edges), np.append(edges, len(keys))
            sizes = ends - starts
            which, few = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes <= SHORT, sizes)
            for k in range(1, SHORT):
                near = (which[k:] == which[:-k]) & few[k:] & _near(marks[k:] ^ marks[:-k], bits) if len(keys) > k else which[:0] > 0
                if near.any():
                    yield links_of(marks[:-k][near], marks[k:][near])
            for k in np.flatnonzero(sizes > SHORT):
                for a, b in _list_links(marks[starts[k] : ends[k]], bits, PLANES[keys[starts[k]] >> 32], cuts[starts[k]]):
                    yield links_of(a, b)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of the last list, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            new = batch.column("key").to_numpy(), batch.column("cut").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
            goes_on = (new[0] == new[0][-1]) & (new[1] == new[1][-1])
            begun = int(np.argmax(goes_on))
            if begun or (held and (held[0][0][0] != new[0][0] or held[0][1][0] != new[1][0])):
                yield from out(*(np.concatenate(x) for x in zip(*held, tuple(x[:begun] for x in new), strict=True)))
                held = []
            held.append(tuple(x[begun:] for x in new))
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints that differ in at most ``bits`` (3 or fewer) bits, all of short lists,
    enough of long ones to join whatever is linked. ``classes`` holds each fingerprint once."""
    if bits > 3:
        raise ValueError("5 shared byte positions are certain for 3 bits or fewer only")
    lists = _postings(classes).repartition("key", "cut").sortWithinPartitions("key", "cut")
    return lists.select("key", "cut", "fp").mapInArrow(_linking(bits), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 3, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable over links), kept.

    One row of each component is kept: that with the smallest id, then row. row_col: a long column that is carried
    along, for callers whose ids may repeat.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, row_col))
    # Per fingerprint, its smallest id; null ids come last.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    classes = materialize(marks.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")))
    found = components(links(classes.select("fp"), bits))
    named = found.join(classes, found["node"] == classes["fp"]).groupBy("component").agg(F.min("first").alias("least"))
    linked = found.join(named, "component").select(F.col("node").alias("fp"), F.col("least").alias("joined"))
    groups = materialize(classes.join(linked, "fp", "left").select("fp", "n", F.coalesce("joined", "first").alias("least")))
    # Rows of hot fingerprints meet theirs by broadcast, all others by shuffle: no copies of one text fill a task.
    hot = F.broadcast(groups.where(F.col("n") * HOT > marks.count()).select(F.col("fp").alias("hot"), F.col("least").alias("hot_least")))
    met = marks.join(hot, F.col("fp") == F.col("hot"), "left")
    cold = met.where("hot is null").join(groups.select("fp", "least"), "fp")
    marks = met.where("hot is not null").select("id", "row", "fp", F.col("hot_least").alias("least")).unionByName(cold.select("id", "row", "fp", "least"))
    own = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    return marks.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.id").alias("component_id"),
        own.eqNullSafe(F.col("least")).alias("kept"), *([F.col("row").alias(row_col)] if row_col else []),
    )
