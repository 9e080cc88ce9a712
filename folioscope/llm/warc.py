"""A deterministic, sharded WARC writer and its reader.

Records are range-sorted by page id. A task writes its range as files that roll by compressed size, each
under a temporary name that is renamed once the file is whole; a second attempt writes the same bytes to
the same name. The manifest, written by Spark after all tasks, says which files count: readers open no
others. Headers and digests are made anew from the payloads. Of equal payloads of at least ``REVISIT``
bytes the one with the largest page id is a response record, and the others are revisits of it.

Defined results: a null html is an empty payload, a null url an empty one; null page ids come first and
are the smallest; of repeated rows one is the response and the others revisit it; an empty table gives an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.tasks import released

REVISIT = 1000
#: A file is closed once it has so many compressed bytes.
ROLL = 16 << 20
LEVEL = 6
# Fixed values of the format.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = {"response": "application/http; msgtype=response", "revisit": "application/http; msgtype=response"}


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Any file system that Arrow knows by the URI's scheme; a path without one is local."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri)


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}:{repeat}')}>"


def record(page: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, repeat: int) -> bytes:
    """One record, uncompressed."""
    sha1 = hashlib.sha1(payload).hexdigest()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}"
            "\r\n\r\n").encode()
    block = http if revisit else http + payload
    kind = "revisit" if revisit else "response"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, sha1, repeat)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join(url.split())}", f"Content-Type: {TYPES[kind]}",
        f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}"]
        lines += [] if refers_to is None else [f"X-Refers-To-Page: {refers_to}"]
    lines += [] if page is None else [f"X-Page-ID: {page}"]
    lines += [f"X-Payload-Length: {len(payload)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Roll:
    """Files of one task, one after the other."""

    def __init__(self, folder: str, partition: int, attempt: int, size: int) -> None:
        self.fs, self.path = filesystem(folder)
        self.partition, self.attempt, self.size = partition, attempt, size
        self.number, self.out = 0, None

    def add(self, page: int | None, data: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.partition:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/_{self.name}.{self.attempt}"
            self.out = self.fs.open_output_stream(self.temporary, compression=None)
            self.bytes, self.records, self.sha, self.first = 0, 0, hashlib.sha256(), page
        member = gzip.compress(data, LEVEL, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.bytes, self.records, self.last = self.bytes + len(member), self.records + 1, page

    def full(self) -> bool:
        return self.out is not None and self.bytes >= self.size

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, f"{self.path}/{self.name}")
        self.out, self.number = None, self.number + 1
        return self.name, self.records, self.bytes, self.sha.hexdigest(), self.first, self.last


def revisits(pages: DataFrame, least: int = REVISIT) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload others share."""
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")) \
        .where(F.col("bytes") >= least)
    shared = keyed.groupBy(F.col("digest").alias("of")).agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return keyed.join(shared, F.col("digest") == F.col("of")).select("page_id", "digest", "refers_to")


def write(pages: DataFrame, folder: str, least: int = REVISIT, roll: int = ROLL) -> DataFrame:
    """Writes the archives and the manifest below the folder; returns the manifest as read back."""
    spark = pages.sparkSession
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    none = F.lit(None)
    kind = pages.schema["page_id"].dataType
    rows = pages.select(
        "page_id", F.lit(1).alias("kind"), "url", "html", none.cast("string").alias("digest"),
        none.cast(kind).alias("refers_to")).unionAll(revisits(pages, least).select(
            "page_id", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("string").alias("html"),
            "digest", "refers_to").distinct())
    ranged = rows.repartitionByRange("page_id").sortWithinPartitions("page_id", "kind", "url", "html")

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files = _Roll(folder, context.partitionId(), context.taskAttemptId(), roll)
        done, marks, seen, current = [], {}, {}, object()
        for batch in batches:
            for page, mark, url, html, digest, refers in zip(*(c for c in batch.columns), strict=True):
                page = page.as_py()
                if page != current:
                    marks, seen, current = {}, {}, page
                if mark.as_py() == 0:
                    marks[digest.as_py()] = refers.as_py()
                    continue
                payload = (html.as_py() or "").encode()
                sha1 = hashlib.sha1(payload).hexdigest()
                repeat = seen.get(sha1, 0)
                seen[sha1] = repeat + 1
                revisit = sha1 in marks and (marks[sha1] != page or repeat > 0)
                files.add(page, record(page, url.as_py() or "", payload, marks.get(sha1), revisit, repeat))
                if files.full():
                    done.append(files.close())
        if files.out is not None:
            done.append(files.close())
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in list(zip(*done, strict=True))[:4]] + [
                    pa.array([None if x is None else str(x) for x in c]) for c in list(zip(*done, strict=True))[4:]],
                ["file", "records", "bytes", "sha256", "first_page", "last_page"])

    ranged.mapInArrow(
        work, "file string, records long, bytes long, sha256 string, first_page string, last_page string",
    ).write.mode("error").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def _members(stream: pa.NativeFile) -> Iterator[bytes]:
    """The uncompressed records of an archive, one gzip member each."""
    rest = b""
    while True:
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts or unzip.unconsumed_tail:
                    raise ValueError("an archive ends inside a record")
                return
            parts.append(unzip.decompress(rest))
            rest = unzip.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record whose digests hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[:int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    whole = fields["WARC-Type"] == "revisit" or _digest(payload) == fields["WARC-Payload-Digest"]
    if version != "WARC/1.1" or not whole or _digest(block) != fields["WARC-Block-Digest"]:
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return (fields.get("X-Page-ID"), int(fields["X-Payload-Length"]), digest, fields["WARC-Type"],
            fields.get("X-Refers-To-Page"))


def read(spark: SparkSession, folder: str, page_type: str = "long") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all records in the files that
    the manifest names."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "records")
    files = manifest.repartition(max(1, manifest.count()))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    @released
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    rows, n = [], 0
                    for data in _members(stream):
                        rows.append(parse(data))
                        n += 1
                        if len(rows) == 4096:
                            yield _batch(rows, names)
                            rows = []
                    if n != records:
                        raise ValueError(f"{name} has {n} records; the manifest says {records}")
                    yield _batch(rows, names)

    return files.mapInArrow(work, "page_id string, payload_bytes long, payload_digest string, record_type string,"
                                  " refers_to string").withColumns({
        "page_id": F.col("page_id").cast(page_type), "refers_to": F.col("refers_to").cast(page_type)})


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
