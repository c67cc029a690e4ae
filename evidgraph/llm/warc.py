"""Deterministic sharded WARC writer and reader.

Pages are range-partitioned and sorted by page_id. Each task streams its range
into gzip-per-record files that roll at a compressed size, under a temporary
name that is renamed when the file is whole. The manifest, itself committed as
a table, names the files that count; a retried task writes the same bytes to
the same names. Dates and record ids come from parameters and content, never
from the clock.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch_path, settle

CRLF = b"\r\n"
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL namespace
_MANIFEST = "file string, records long, bytes long, sha256 string"
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # gzip frame without time or name
    return packer.compress(data) + packer.flush()


def _header(fields: list[tuple[str, str]]) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields)]
    return CRLF.join(lines) + CRLF + CRLF


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page}/{digest}')}>"


def _uri(url: str | None, page: int | None) -> str:
    if not url:
        return f"urn:page:{page}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url)


def make_record(page, url, payload: bytes, digest: str, refers_to, date: str, has_html: bool = True) -> bytes:
    """One WARC record, uncompressed. A revisit carries no payload; its digest
    and length are those of the full payload."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url, page)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    body = http + payload
    if refers_to is not None:
        body = http
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _record_id(refers_to, digest)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    fields += [
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    return _header(fields) + body + CRLF + CRLF


class _File:
    def __init__(self, store: pafs.FileSystem, folder: str, name: str, attempt: int, date: str):
        self.store, self.final, self.temp = store, f"{folder}/{name}", f"{folder}/.{name}.{attempt}.tmp"
        self.out, self.digest, self.bytes, self.records, self.name = store.open_output_stream(self.temp), hashlib.sha256(), 0, 0, name
        body = b"software: evidgraph\r\nformat: WARC File Format 1.1\r\n"
        self.put(_member(_header([
            ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_IDS, name)}>"), ("WARC-Date", date),
            ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body))),
        ]) + body + CRLF + CRLF))

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.bytes += len(data)

    def close(self) -> tuple:
        self.out.close()
        self.store.move(self.temp, self.final)
        return self.name, self.records, self.bytes, self.digest.hexdigest()


def _writer(folder: str, roll_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        file, seq, done = None, 0, []
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for page, url, html, digest, refers in zip(*cols, strict=True):
                payload = (html.as_py() or "").encode()
                if file is None:
                    file = _File(store, path, f"part-{part:05d}-{seq:05d}.warc.gz", attempt, date)
                file.put(_member(make_record(page.as_py(), url.as_py(), payload, digest.as_py(), refers.as_py(), date)))
                file.records += 1
                if file.bytes >= roll_bytes:
                    done.append(file.close())
                    file, seq = None, seq + 1
        if file is not None:
            done.append(file.close())
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
            ["file", "records", "bytes", "sha256"],
        )

    return run


def plan_records(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of pages with equal payloads of
    at least ``min_bytes`` the largest page_id is the response, others refer to
    it. Shorter payloads never refer. Rows that repeat the largest page_id are
    all responses; a row without page_id is a revisit if any equal page has one.
    """
    page = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
        F.sha1(F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).alias("digest"),
        F.octet_length(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("n"),
    )
    first = page.filter(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("k"))
    first = settle(first.filter("k > 1").select("digest", "top"), "responses")
    return page.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = 32 << 20, min_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archive below ``folder`` (any scheme that Arrow opens) and
    return its manifest (file, records, bytes, sha256), read back from
    ``folder/manifest``. Null html is an empty payload, null url a urn."""
    spark = pages.sparkSession
    store, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    store.create_dir(f"{path}/data", recursive=True)
    ordered = plan_records(pages, min_bytes).repartitionByRange("page_id", "digest").sortWithinPartitions("page_id", "digest")
    ordered.mapInArrow(_writer(f"{folder}/data", roll_bytes, date), _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (CRLF, b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (CRLF, b"\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("truncated record")
        yield head, block


def _reader(folder: str, with_payload: bool):
    def rows(file: str, size: int) -> Iterator[tuple]:
        import gzip

        store, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        with store.open_input_file(f"{path}/{file}") as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as whole:
            for head, block in parse_records(io.BufferedReader(whole, 1 << 18)):
                if head["warc-type"] == "warcinfo":
                    continue
                payload = block.partition(CRLF + CRLF)[2]
                digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                if head["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"payload digest differs in {file}")
                refers, page = head.get("x-refers-to-page"), head.get("x-page-id")
                yield (
                    None if page is None else int(page), int(head["x-payload-length"]), digest, head["warc-type"],
                    None if refers is None else int(refers), head["warc-target-uri"], payload.decode() if with_payload else None,
                )

    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in _RECORD.split(", ")]

    def pack(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: list[tuple] = []
                for row in rows(file, size):
                    held.append(row)
                    if len(held) >= (256 if with_payload else 5000):
                        yield pack(held)
                        held = []
                if held:
                    yield pack(held)

    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest names; digests are checked."""
    files = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file", "bytes")
    n = max(1, files.count())  # files, not rows: one task each
    return files.repartition(min(n, 10_000)).mapInArrow(_reader(f"{folder}/data", with_payload), _RECORD)


def op8_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_warc(read(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
t AS (SELECT digest, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN t.top IS NULL OR t.top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN t.top <> page_id THEN t.top END AS refers_to
FROM p LEFT JOIN t ON p.digest = t.digest
"""
