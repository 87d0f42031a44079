"""WARC archives: writing, normalising whole-file gzip streams, reading by offset.

Many archives are one gzip stream over all their records, which allows no access to a single
record. The normaliser inflates such a stream once, front to back, and writes every record as
its own gzip member, with a sidecar table of offsets. A record is then one ranged read.

Layout of an archive folder (in a store that driver and executors share):
  stream/part-NNNNN-X.warc.gz   whole-file streams, as written
  files/                        Parquet: number and name of each stream
  members/part-NNNNN-X.warc.gz  one gzip member a record
  index/                        Parquet, a file a stream: file, offset, length, page_id, record_type, ...

Every attempt of a task writes a file of its own name (X), and only the committed attempt's name
reaches the tables, so a task that runs again or twice at once takes no file from the other.

Parallel work: as many normalising tasks as there are streams, dealt by their running number;
reading is dealt by runs of neighbouring records, into tasks of about `READ_BYTES`.

Defined cases: a null payload counts as empty; null ids are written as records of their own and
never answer for another; repeated rows (same id and payload) are of one kind:
all responses, or all revisits of the same response. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, materialise, remove, shared_path

BUFFER = 1 << 20
READ_BYTES = 64 << 20  # of compressed members that one reading task takes, where every core has work
FILES_SCHEMA = "number long, file string, records long"
INDEX_SCHEMA = "file string, offset long, length long, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"


def make_record(page_id, url, payload: bytes, payload_digest: str, refers_to) -> bytes:
    """A response with its HTTP block, or a revisit that names the record holding the same payload."""
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", "".join((url or "").split())), ("WARC-Page-Id", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        return _record(headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers_to)), ("WARC-Refers-To-Page-Id", str(refers_to))]
    return _record(headers, http)


class Records:
    """Reads WARC records one after the other from a file object of inflated bytes."""

    def __init__(self, raw):
        self.raw = io.BufferedReader(raw, BUFFER) if isinstance(raw, io.RawIOBase) else raw

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        while line := self.raw.readline():
            if line == b"\r\n":
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head, headers = [line], {}
            while (line := self.raw.readline()) not in (b"\r\n", b""):
                head.append(line)
                name, _, value = line.decode().partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers["content-length"])
            block = self.raw.read(size)
            if len(block) != size:
                raise ValueError("a record ends early")
            yield headers, b"".join(head) + b"\r\n", block


class Inflated(io.RawIOBase):
    """The inflated bytes of a gzip file of one or more members, read once from front to back."""

    def __init__(self, source):
        self.source, self.z, self.rest, self.out = source, zlib.decompressobj(31), b"", b""

    def readable(self):
        return True

    def readinto(self, into) -> int:
        while not self.out:
            data = self.rest or self.source.read(BUFFER)
            if not data:
                return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            self.out = self.z.decompress(data, BUFFER)
            self.rest = self.z.unconsumed_tail or self.z.unused_data
        n = min(len(into), len(self.out))
        into[:n], self.out = self.out[:n], self.out[n:]
        return n


def _store(uri: str):
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _write(uri: str, name: str, write) -> None:
    """Writes a file by write(stream)."""
    fs, path = _store(uri)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
        write(out)


def _attempt(number: int) -> str:
    return f"part-{number:05d}-{uuid.uuid4().hex[:8]}.warc.gz"


def with_references(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, payload, payload_digest, refers_to: the largest page_id of equal payloads answers for all.

    Decided over (digest, id) pairs alone; payloads are not shuffled by digest, so a payload that
    a third of the pages share costs a partial maximum and no hot task.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    keys = rows.where((F.length("payload") >= smallest) & F.col("page_id").isNotNull()).groupBy("sha1", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    of = keys.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("ids")).where("ids > 1").select("sha1", "refers_to")
    revisits = keys.select("sha1", "page_id").join(of, "sha1").where("page_id <> refers_to")
    # stored first, so that its size is known: if it is small, it travels to the payloads, else both are shuffled by id
    revisits = materialise(revisits, "warc-revisits")
    return rows.join(revisits, ["page_id", "sha1"], "left").select("page_id", "url", "payload", "refers_to")


def write_streams(rows: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes each partition as a whole-file gzip stream of its records; a table of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, count = TaskContext.get().partitionId(), 0
        name = _attempt(number)

        def write(out):
            nonlocal count
            z = zlib.compressobj(level, zlib.DEFLATED, 31)
            for batch in in_slices(batches, "payload"):
                for page_id, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))):
                    out.write(z.compress(make_record(page_id, url, payload, digest(payload), refers)))
                    count += 1
            out.write(z.flush())

        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        batches = chain([first], batches)
        _write(f"{folder}/stream", name, write)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([name]), pa.array([count], pa.int64())], ["number", "file", "records"])

    return rows.mapInArrow(run, FILES_SCHEMA)


def normalise(files: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Rewrites each stream as one member a record; the offset index.

    A stream is one task's work, never more in memory than a record and its part of the index. The
    number of tasks is stated, so adaptive execution leaves it; ranges of the streams' running
    numbers give each task one stream, where hashes of names would leave every third task empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(f"{folder}/stream")
        for batch in batches:
            for number, stream in zip(batch.column("number").to_pylist(), batch.column("file").to_pylist()):
                rows: list[tuple] = []
                name = _attempt(number)

                def write(out, stream=stream, name=name, rows=rows):
                    offset = 0
                    with fs.open_input_stream(f"{path}/{stream}", compression=None) as source:
                        for h, head, block in Records(Inflated(source)):
                            z = zlib.compressobj(level, zlib.DEFLATED, 31)
                            member = z.compress(head + block + b"\r\n\r\n") + z.flush()
                            out.write(member)
                            rows.append((name, offset, len(member), _int(h["warc-page-id"]), h["warc-type"], _int(h.get("warc-refers-to-page-id")), _int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")))
                            offset += len(member)

                _write(f"{folder}/members", name, write)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX.types)], schema=_INDEX)

    return files.repartitionByRange(max(1, files.count()), "number").mapInArrow(run, INDEX_SCHEMA)


_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _int(value: str | None) -> int | None:
    return int(value) if value else None


def write_archive(pages: DataFrame, folder: str, smallest: int = 0) -> None:
    """Writes the pages as streams, normalises them and leaves members and index in the folder."""
    spark = pages.sparkSession
    write_streams(with_references(pages, smallest), folder).write.parquet(f"{folder}/files")
    normalise(spark.read.schema(FILES_SCHEMA).parquet(f"{folder}/files"), folder).write.parquet(f"{folder}/index")
    remove(spark, f"{folder}/stream")


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")


def dealt(index: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """file, offset, length of the indexed records, dealt to tasks in runs of neighbours.

    Ranges come from a sample of (file, offset); there is a task for each `read_bytes` of members,
    and one a core at least. Only places travel, not records.
    """
    size, rows = index.agg(F.sum("length"), F.count(F.lit(1))).first()
    tasks = max(-(-(size or 0) // read_bytes), min(rows, index.sparkSession.sparkContext.defaultParallelism), 1)
    return index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")


def read_members(index: DataFrame, folder: str) -> DataFrame:
    """Reads each indexed record by its offset; payload null for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _store(f"{folder}/members")
        name, source = None, None
        for batch in batches:
            out: list[dict] = []
            held = 0
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{path}/{file}")
                member = zlib.decompress(source.read_at(length, offset), 31)
                ((h, _, block),) = Records(io.BytesIO(member))
                kind = h["warc-type"]
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                if payload is not None and digest(payload) != h["warc-payload-digest"].removeprefix("sha1:"):
                    raise ValueError(f"{file}@{offset}: the payload is not the one that was written")
                out.append({"page_id": _int(h["warc-page-id"]), "payload_bytes": _int(h["warc-payload-length"]), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"), "record_type": kind, "refers_to": _int(h.get("warc-refers-to-page-id")), "url": h["warc-target-uri"], "payload": payload, "file": file, "offset": offset})
                held += len(member)
                if held > 8 * BUFFER:
                    yield pa.RecordBatch.from_pylist(out, schema=_MEMBER)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_MEMBER)

    return dealt(index).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, file string, offset long")


_MEMBER = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives the pages and reads every record back."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    write_archive(pages, folder)
    return read_members(index_of(spark, folder), folder)


def oracle() -> str:
    """round_trip's rows over the pages in DuckDB SQL; base32 is spelled from twenty bits of the hash at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    part = "('0x' || substr(h, 5 * i + 1, 5))::BIGINT"
    four = " || ".join(f"substr('{letters}', (({part} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
spelled AS (SELECT page_id, payload_bytes, h, array_to_string(list_transform(range(8), lambda i: {four}), '') AS payload_digest, max(page_id) OVER (PARTITION BY h) AS response FROM hashed)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> response THEN response END AS refers_to FROM spelled"""
