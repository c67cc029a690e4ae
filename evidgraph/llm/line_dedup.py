"""Line dedup by range-partitioned hashes.

Each document's distinct line keys become rows (key, document, positions).
They are range-partitioned by (key, document) and sorted, so that equal keys
lie together and one very common key still spreads over many partitions. One
streaming pass counts the documents of every run; a run that touches the edge
of a partition is summed with its continuation. Lines of frequent keys are
returned as a compressed keep bitmap for each document, never as text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read, settle

_LINES = "k1 long, k2 long, doc_id long, th long, n_lines long, pos array<int>"


def _key(line: bytes) -> bytes:
    return line.strip().lower()  # bytes methods touch ASCII only


def _line_rows(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = (batch.column(i) for i in range(3))
            out: list[tuple] = []
            for doc, th, text in zip(ids.to_pylist(), hashes.to_pylist(), texts, strict=True):
                lines = (text.as_py() or "").encode().split(b"\n")
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(lines):
                    key = _key(line)
                    if key and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        found.setdefault(key, []).append(i)
                for key, pos in found.items():
                    out.append((xxhash.xxh3_128_digest(key), doc, th, len(lines), pos))
                if len(out) >= 50_000:
                    yield _pack(out)
                    out = []
            if out:
                yield _pack(out)

    return run


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    keys = np.frombuffer(b"".join(r[0] for r in rows), dtype="<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.ascontiguousarray(keys[:, 0])),
            pa.array(np.ascontiguousarray(keys[:, 1])),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int64()),
            pa.array([r[3] for r in rows], pa.int64()),
            pa.array([r[4] for r in rows], pa.list_(pa.int32())),
        ],
        ["k1", "k2", "doc_id", "th", "n_lines", "pos"],
    )


def _stream_runs(min_docs: int):
    """Counts documents in each run of equal keys of a sorted partition. Runs
    that end inside the partition with too few documents are settled here;
    the first and the last run may continue next door and are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, int] | None = None  # the open run: k1, k2, documents
        last_doc: tuple | None = None
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            k1 = batch.column(0).to_numpy()
            k2 = batch.column(1).to_numpy()
            doc = batch.column(2).fill_null(0).to_numpy()
            null = batch.column(2).is_null().to_numpy(zero_copy_only=False)
            new_key = np.ones(len(k1), bool)
            new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            new_doc = np.ones(len(k1), bool)
            new_doc[1:] = new_key[1:] | (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
            if held is not None:
                new_key[0] = (int(k1[0]), int(k2[0])) != held[:2]
                new_doc[0] = new_key[0] or (int(doc[0]), bool(null[0])) != last_doc
            last_doc = (int(doc[-1]), bool(null[-1]))
            starts = np.flatnonzero(new_key)
            counts = np.add.reduceat(new_doc.astype(np.int64), np.concatenate(([0], starts)).astype(int)) if len(starts) and starts[0] else np.add.reduceat(new_doc.astype(np.int64), starts) if len(starts) else np.array([new_doc.sum()])
            out = []
            if held is not None and (not len(starts) or starts[0]):
                held = (*held[:2], held[2] + int(counts[0]))
                counts = counts[1:]
            if len(starts):
                if held is not None:
                    out.append((held, first))
                    first = False
                runs1, runs2 = k1[starts], k2[starts]
                inner = slice(0, len(starts) - 1)
                if held is None and len(starts) > 1:  # the very first run of the partition
                    out.append(((int(runs1[0]), int(runs2[0]), int(counts[0])), True))
                    first = False
                    inner = slice(1, len(starts) - 1)
                often = np.flatnonzero(counts[inner] >= min_docs) + inner.start
                out += [((int(runs1[i]), int(runs2[i]), int(counts[i])), False) for i in often]
                held = (int(runs1[-1]), int(runs2[-1]), int(counts[-1]))
            keep = [r for r, edge in out if edge or r[2] >= min_docs]
            if keep:
                yield _counts(keep)
        if held is not None:
            yield _counts([held])

    return run


def _counts(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["k1", "k2", "docs"]
    )


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, pos in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            bits = np.ones(n, np.uint8)
            bits[np.asarray(pos.values)] = 0
            dropped.append(int(n - bits.sum()))
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
            ["doc_id", "th", "n_lines", "n_dropped", "keep"],
        )


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, th, n_lines, n_dropped, keep) for each document that loses lines.

    ``keep`` is a zlib-compressed bit string, first line in the highest bit;
    ``th`` is ``xxhash64(text)``. A document without a row keeps every line.
    Documents are counted by doc_id: rows that repeat an id count once, and
    all rows without an id count as one document. Lines whose stripped,
    lower-cased form has fewer than ``min_chars`` code points always stay.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    lines = settle(rows.mapInArrow(_line_rows(min_chars), _LINES), "lines")
    often = (
        lines.select("k1", "k2", "doc_id")
        .repartitionByRange("k1", "k2", "doc_id")
        .sortWithinPartitions("k1", "k2", "doc_id")
        .mapInArrow(_stream_runs(min_docs), "k1 long, k2 long, docs long")
        .groupBy("k1", "k2")
        .agg(F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= min_docs)
        .select("k1", "k2")
    )
    often = settle(often, "frequent")
    hit = lines.join(often, ["k1", "k2"]).groupBy("doc_id", "th").agg(
        F.max("n_lines").alias("n_lines"), F.array_distinct(F.flatten(F.collect_list("pos"))).alias("pos")
    )
    return hit.select("doc_id", "th", "n_lines", "pos").mapInArrow(
        _bitmaps, "doc_id long, th long, n_lines long, n_dropped long, keep binary"
    )


def _kept(text: str | None, keep: bytes | None) -> tuple[int, int, bytes]:
    lines = (text or "").encode().split(b"\n")
    if keep is None:
        return len(lines), 0, b"\n".join(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
    kept = [line for line, bit in zip(lines, bits, strict=True) if bit]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("th")).alias("d")
    b = bitmaps.select("doc_id", "th", "keep").alias("b")
    same = (F.col("d.th") == F.col("b.th")) & F.col("d.doc_id").eqNullSafe(F.col("b.doc_id"))
    return d.join(b, same, "left").select("d.doc_id", "d.text", "b.keep")


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, text) with the lines that ``bitmaps`` keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if t.as_py() is None else _kept(t.as_py(), k.as_py())[2].decode()
                for t, k in zip(batch.column(1), batch.column(2), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _with_bitmaps(docs, bitmaps).mapInArrow(run, "doc_id long, text string")


def line_digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_kept(t.as_py(), k.as_py()) for t, k in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in got], pa.int64()),
                    pa.array([x[1] for x in got], pa.int64()),
                    pa.array([hashlib.sha256(x[2]).hexdigest() for x in got], pa.string()),
                ],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    joined = _with_bitmaps(docs, line_keep_bitmaps(docs, min_docs))
    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_digests(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
),
k AS (
  SELECT doc_id, line, i,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""
