"""Token ids of a corpus in flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by id. Each partition is a shard of three files:

* ``ids-<shard>.bin``: the ids of its documents one after the other, each document's end id behind it, as little-endian
  unsigned integers: two bytes if the vocabulary has 65,536 ids or fewer, four otherwise;
* ``docs-<shard>.bin``: the document ids, signed 64-bit integers;
* ``offsets-<shard>.bin``: unsigned 64-bit integers, where each document starts in the whole corpus, and the shard's end.

Tasks write ids and lengths; the shards' bases are prefix sums of the shards' totals (a row for each shard, of which
there are ``MOST_SHARDS`` at most); a second pass over the lengths alone writes the offsets. Each file gets a temporary
name that no other attempt uses, and then its own, in the place of what an attempt before left there; a repeated attempt
writes the same bytes. The manifest comes last, and readers open what it lists. They map the files into memory (on local
and mounted file systems; elsewhere a shard is read whole, which ``shard_bytes`` bounds).

Cases. A null text counts as empty: its end id is its only one. Texts of any length are encoded whole, and may make a shard
longer. Strings of special tokens inside texts are what the library makes of them. Rows that repeat an id are documents
of their own, ordered by a hash of their text; null ids come last, and their number is in the manifest. An empty table
gives an empty manifest and no files. Only the id and text columns are read; other columns do not matter.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, small_batches
from .wordwise import encoder

END = 1
#: Bytes of text in a shard, about, and the most shards that a corpus is cut into (they get longer beyond).
SHARD_BYTES, MOST_SHARDS = 16 << 20, 50_000
WRITTEN = "shard long, docs long, ids long, nulls long, width int"
SHARD = f"{WRITTEN}, base_docs long, base_ids long"
DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"
#: Bytes of ids in one Arrow batch that a reader gives, about.
CHUNK = 8 << 20


def name_of(kind: str, shard: int) -> str:
    return f"{kind}-{shard:06d}.bin"


class _Output:
    """A file under its temporary name, until it is committed."""

    def __init__(self, out: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(out)
        self.temporary, self.final = posixpath.join(base, "_temporary", f"{name}.{uuid.uuid4().hex}"), posixpath.join(base, name)
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)

    def commit(self) -> None:
        self.stream.close()
        # Not every file system moves onto a name that an attempt before has taken; the bytes there are the same.
        if self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)


def mapped(files: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file's numbers: a map into memory where the file system is a local one."""
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def _writer(out: str, tokenizer_file: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own = TaskContext.get().partitionId(), encoder(tokenizer_file)
        files: list[_Output] = []
        docs = ids = nulls = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files = files or [_Output(out, name_of(kind, shard)) for kind in ("ids", "docs", "lengths")]
            found, starts = own.encode(batch.column("text"))
            lengths = np.diff(starts) + 1
            names = batch.column("id")
            files[0].stream.write(np.insert(found, starts[1:], end).tobytes())
            files[1].stream.write(names.fill_null(0).to_numpy().astype("<i8").tobytes())
            files[2].stream.write(lengths.astype("<u8").tobytes())
            docs, ids, nulls = docs + len(lengths), ids + int(lengths.sum()), nulls + names.null_count
        for f in files:
            f.commit()
        rows = [[x] for x in (shard, docs, ids, nulls, own.dtype.itemsize)] if docs else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, [pa.int64()] * 4 + [pa.int32()], strict=True)], names=["shard", "docs", "ids", "nulls", "width"])

    return run


def _offsets(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for shard, first in zip(batch.column("shard").to_pylist(), batch.column("base_ids").to_pylist(), strict=True):
                lengths = mapped(files, posixpath.join(base, name_of("lengths", shard)), "<u8")
                starts = np.cumsum(np.append(np.uint64(first), lengths), dtype="<u8")
                file = _Output(out, name_of("offsets", shard))
                file.stream.write(starts.tobytes())
                file.commit()
            yield batch

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer_file: str, end: int = END, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write all documents below ``out`` (a folder that driver and executors share); returns the manifest's path.

    tokenizer_file: of the tokenizers library, at the same place on all executors.
    """
    spark = docs.sparkSession
    small_batches(spark)
    files, base = pafs.FileSystem.from_uri(out)
    files.create_dir(posixpath.join(base, "_temporary"), recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, min(MOST_SHARDS, -(-size // shard_bytes)))
    # The row's number parts copies of rows, so that no shard needs to hold all rows of one id.
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_last(), F.col("hash"), F.col("row")]
    dealt = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("id", "text")
    listed = posixpath.join(out, "shards")
    dealt.mapInArrow(_writer(out, tokenizer_file, end), WRITTEN).write.mode("overwrite").parquet(listed)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    based = spark.read.schema(WRITTEN).parquet(listed).select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in ("docs", "ids")))
    # A number given keeps Spark from doing all shards in one task because their rows are short.
    manifest = posixpath.join(out, "manifest")
    based.repartitionByRange(shards, "shard").mapInArrow(_offsets(out), SHARD).write.mode("overwrite").parquet(manifest)
    files.delete_dir_contents(posixpath.join(base, "_temporary"))
    return manifest


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(shard, docs, ids, nulls, width, base_docs, base_ids), a row for each shard."""
    return spark.read.schema(SHARD).parquet(posixpath.join(out, "manifest"))


def _reader(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(out)
        for batch in batches:
            for x in batch.to_pylist():
                path = lambda kind: posixpath.join(base, name_of(kind, x["shard"]))  # noqa: E731, B023
                ids, names, starts = mapped(files, path("ids"), f"<u{x['width']}"), mapped(files, path("docs"), "<i8"), mapped(files, path("offsets"), "<u8")
                if len(starts) != x["docs"] + 1 or len(ids) != x["ids"] or int(starts[-1]) - int(starts[0]) != x["ids"]:
                    raise ValueError(f"shard {x['shard']}: its files do not have the lengths that the manifest gives")
                local = (starts - starts[0]).astype(np.int64)
                k, known = 0, x["docs"] - x["nulls"]  # null ids come last
                while k < x["docs"]:
                    to = max(k + 1, int(np.searchsorted(local, local[k] + CHUNK // 4, "right")) - 1)
                    raw = ids[local[k] : local[to]].astype("<u4").tobytes()
                    bounds = pa.py_buffer(((local[k : to + 1] - local[k]) * 4).astype(np.int64).tobytes())
                    some = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - k, [None, bounds, pa.py_buffer(raw)]).cast(pa.binary())
                    who = pa.array(names[k:to], pa.int64(), mask=np.arange(k, to) >= known)
                    yield pa.RecordBatch.from_arrays([who, pa.array(starts[k:to].astype(np.int64)), pa.array(np.diff(local[k : to + 1])), some], names=["doc_id", "start", "n_tokens", "ids"])
                    k = to

    return run


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files: ids as little-endian unsigned 32-bit integers."""
    listed = manifest(spark, out)
    return listed.repartitionByRange(max(1, listed.count()), "shard").mapInArrow(_reader(out), DOCUMENT)


def token_files(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Write the documents to a new folder below the shared one and read them back."""
    out = posixpath.join(shared_dir(docs.sparkSession), f"tokens-{uuid.uuid4().hex}")
    write_tokens(docs, out, tokenizer_file, **options)
    return read_tokens(docs.sparkSession, out)
