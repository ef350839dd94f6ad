"""Deterministic, sharded WARC archives of web pages: written by tasks, committed by name, and read back.

Pages are range-sorted by (id, SHA-1 of the payload) into shards. The splitters are quantiles of keys chosen by hash,
so they depend on the rows alone (Spark's own range partitioner samples differently from run to run), and rows that
share an id, or have none, are still cut apart by payload. Every shard is a partition of its own, about ``shard_bytes``,
or more where that would make over ``most_shards``. Its task writes its records in order, one gzip member each, and begins a new file when the
compressed size passes ``roll_bytes``. A file is written under a temporary name that no other attempt uses and then
takes its final name, in the place of what an attempt before left there; headers, digests and record ids are made from
the row, so a repeated attempt puts the same bytes there. The job's last act is the manifest, written by Spark: readers
read only the files that it lists.

Of records with equal payloads the one with the smallest page id is a response, the others are revisits without
payload. Equality is by the SHA-1 of the whole payload, which the records carry anyway, and its length.

Cases. A payload of any length is one record, held by its task alone. A null html is an empty payload; empty payloads equal each other (from ``min_bytes`` 0 on). Of rows that repeat
a page id with an equal payload one is the response and the others revisit it. Rows with a null id sort first; they
never are a response that others refer to unless the whole group has no id, and then refers_to is null. A null url
becomes ``urn:page:<id>``; control characters and spaces in urls are percent-encoded. Further columns are not
written. An empty table gives an empty manifest and no files.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches

SHARD_BYTES = 16 << 20  # of payload in a shard, about; more where that would make over MOST_SHARDS
MOST_SHARDS = 50_000  # so that 800,000 sampled keys (60 MB) at most come to the driver, whatever the table's size
ROLL_BYTES = 4 << 20  # compressed, in a file; a single record may be larger
DATE = "2020-01-01T00:00:00Z"  # of all records: a clock would make archives differ
SAMPLED_KEYS = 20_000  # keys from which splitters are chosen, about, or PER_SHARD of each shard if these are more
PER_SHARD = 16
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value of RFC 9562 for URLs
MANIFEST = "file string, shard long, number long, records long, bytes long, sha256 string"
COLUMNS = ["shard", "page_id", "sha1", "is_page", "url", "payload", "size", "least", "grouped"]
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def clean_url(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record, as a gzip member."""
    digest = base64.b32encode(sha1).decode()
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % size, b"", b""]
    block = b"\r\n".join(http) + (b"" if revisit else payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}" if not revisit else f"WARC-Record-ID: {record_id(page_id, digest + '/revisit')}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean_url(url, page_id)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {size}"]
        if refers_to is not None:
            head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(head).encode() + block + b"\r\n\r\n"
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(raw) + member.flush()


class _File:
    """One archive file under its temporary name, until it is moved."""

    def __init__(self, out: str, shard: int, number: int):
        self.fs, base = open_fs(out)
        self.name = f"shard-{shard:06d}-{number:05d}.warc.gz"
        self.temporary = posixpath.join(base, "_temporary", f"{self.name}.{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}")
        self.final = posixpath.join(base, self.name)
        self.shard, self.number, self.records, self.bytes, self.sha = shard, number, 0, 0, hashlib.sha256()
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        info = f"format: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
        head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, self.name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {self.name}", "Content-Type: application/warc-fields", f"Content-Length: {len(info)}", "", ""]
        member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.write(member.compress("\r\n".join(head).encode() + info + b"\r\n\r\n") + member.flush())
        self.records = 0

    def write(self, member: bytes) -> None:
        self.stream.write(member)
        self.sha.update(member)
        self.records += 1
        self.bytes += len(member)

    def commit(self) -> list:
        self.stream.close()
        # Not every file system moves onto a name that an attempt before has taken; the bytes there are the same.
        if self.fs.get_file_info(self.final).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)
        return [self.name, self.shard, self.number, self.records, self.bytes, self.sha.hexdigest()]


def _writer(out: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, before, mark, done = None, None, None, []
        for batch in batches:
            columns = [batch.column(c) for c in COLUMNS]
            for k in range(batch.num_rows):
                shard, page_id, sha1, is_page, url, payload, size, least, grouped = (c[k].as_py() for c in columns)
                if not is_page:
                    mark = page_id, sha1, size, least
                    continue
                least = mark[3] if mark and mark[:3] == (page_id, sha1, size) else page_id
                if file and (file.shard != shard or file.bytes >= roll_bytes):
                    done.append(file.commit())
                    file = _File(out, shard, file.number + 1 if file.shard == shard else 0)
                file = file or _File(out, shard, 0)
                again = grouped and before == (page_id, sha1)
                before = (page_id, sha1)
                file.write(record(page_id, url, payload, size, sha1, least, grouped and (again or page_id != least)))
        if file:
            done.append(file.commit())
        rows = list(zip(*done, strict=True)) if done else [[]] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names=["file", "shard", "number", "records", "bytes", "sha256"])

    return run


def place(page_id: Column, sha1: Column) -> Column:
    """A string that sorts as (id, payload) do, null ids first."""
    ordered = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(page_id.isNull(), "0").otherwise(F.concat(F.lit("1"), ordered)), F.hex(sha1))


def splitters(keys: DataFrame, shards: int, rows: int) -> list[str]:
    """Keys that cut the rows into ``shards`` ranges of about equal size, the same for the same rows."""
    if shards <= 1:
        return []
    grain = 1 << 30
    part = min(1.0, max(SAMPLED_KEYS, PER_SHARD * shards) / max(rows, 1))
    chosen = keys.where(F.pmod(F.xxhash64(F.lit(7), "place"), F.lit(grain)) < int(grain * part))
    found = sorted(r[0] for r in chosen.toLocalIterator())
    return sorted({found[k * len(found) // shards] for k in range(1, shards)}) if found else []


def write_warc(pages: DataFrame, out: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, most_shards: int = MOST_SHARDS, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> str:
    """Write all pages below ``out`` (a folder that driver and executors share) and return the manifest's path."""
    spark = pages.sparkSession
    small_batches(spark, 500)
    files, base = open_fs(out)
    files.create_dir(posixpath.join(base, "_temporary"), recursive=True)
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("grouped", F.col("size") >= min_bytes)
    least = rows.where("grouped").groupBy("sha1", "size").agg(F.min("page_id").alias("least"))
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    keys = rows.select(place(F.col("page_id"), F.col("sha1")).alias("place"))
    cuts = splitters(keys, min(most_shards, -(-(total["bytes"] or 0) // shard_bytes)), total["n"])

    @F.pandas_udf("int")
    def shard(places: pd.Series) -> pd.Series:
        return places.map(lambda x: bisect.bisect_right(cuts, x)).astype("int32")

    # Which pages revisit which is found without payloads, and told to the writer by rows that sort in front of the
    # pages they are about: so payloads are shuffled once. A payload that many pages share is a hot key of this join,
    # whose many rows are on the side that Spark can split.
    keys = rows.where("grouped").select("page_id", "size", "sha1")
    marks = keys.join(least, ["sha1", "size"]).where("least is not null and not page_id <=> least")
    marks = marks.select("page_id", "sha1", F.lit(False).alias("is_page"), "size", "least", F.lit(True).alias("grouped"))
    paged = rows.select("page_id", "sha1", F.lit(True).alias("is_page"), "url", "payload", "size", "grouped")
    both = paged.unionByName(marks, allowMissingColumns=True).withColumn("shard", shard(place(F.col("page_id"), F.col("sha1"))))
    # One partition per shard: hashing shard numbers would put several into one task and leave others empty.
    dealt = both.repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha1", "size", "is_page", "url").select(*COLUMNS)
    manifest = posixpath.join(out, "manifest")
    dealt.mapInArrow(_writer(out, roll_bytes), MANIFEST).write.mode("overwrite").json(manifest)
    files.delete_dir_contents(posixpath.join(base, "_temporary"))
    return manifest


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    left = b""
    while True:
        piece = zlib.decompressobj(31)
        parts = []
        while not piece.eof:
            data = left or stream.read(chunk)
            left = b""
            if not data:
                if parts:
                    raise ValueError("the archive ends inside a record")
                return
            parts.append(piece.decompress(data))
        left = piece.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, lengths checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC/1.1 record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit its header")
    return fields, rest[:size]


def _reader(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        files, base = open_fs(out)
        for name in (x for batch in batches for x in batch.column("file").to_pylist()):
            rows = []
            with files.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                for fields, block in map(parse, members(stream)):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    number = lambda key: int(fields[key]) if key in fields else None  # noqa: E731, B023
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        size = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{name}: a payload does not have its digest")
                    else:
                        size = number("x-payload-length")
                    rows.append({"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page-id")})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """Every record of the archives that the manifest lists, digests checked."""
    listed = spark.read.schema(MANIFEST).json(posixpath.join(out, "manifest")).where("file is not null").select("file")
    # A number given keeps Spark from reading all archives in one task because their names are short; ranges deal them
    # evenly, which hashes of so few names would not.
    return listed.repartitionByRange(max(1, listed.count()), "file").mapInArrow(_reader(out), RECORD)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a new folder below the shared one and read them back."""
    out = posixpath.join(shared_dir(pages.sparkSession), f"warc-{uuid.uuid4().hex}")
    write_warc(pages, out, **options)
    return read_warc(pages.sparkSession, out)


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, unhex(sha1(coalesce(html, ''))) AS sha FROM pages
), bits AS (
  SELECT page_id, html, sha, list_transform(range(0, 20), lambda k: CAST(('0x' || substr(hex(sha), CAST(k * 2 + 1 AS INT), 2)) AS INT)) AS b FROM p
), coded AS (
  SELECT page_id, html, sha, array_to_string(list_transform(range(0, 32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((b[k * 5 // 8 + 1] * 256 + coalesce(b[k * 5 // 8 + 2], 0)) >> CAST(11 - k * 5 % 8 AS INT)) & 31 AS INT) + 1, 1)), '') AS digest
  FROM bits
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER (PARTITION BY html) THEN min(page_id) OVER (PARTITION BY html) END AS refers_to
FROM coded
"""
