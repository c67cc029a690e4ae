"""Removal of repeated byte strings by bucket refinement.

Suffixes are sampled: every 200-byte window contains, at the same place in
each copy, an anchor, the least of its q-byte grams. Anchors with equal grams
form the initial buckets; a bucket of one ends there. What remains is refined
recursively. A node of the recursion is a range of window offsets around an
anchor. Its core, the bytes all its windows share, forms buckets; its hull, the
bytes they cover together, forms classes within a bucket. A lone core has no
repeated window; all windows of a hull that occurs twice repeat. A bucket that
still holds a lone hull beside others is split by later offsets, one member of
each class standing for it, down to single windows. Each step is a partial
aggregation and a join that may be split, so one very frequent passage does
not gather in a task; the result is exact up to 64-bit hash collisions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_windows import Windows, anchors
from .common import discard, read, settle

#: Widths of the offset ranges at each level of the recursion below the root.
WIDTHS = (21, 5, 1)
#: Rows or bytes that a Python task gathers before it yields, whatever its input batch holds.
BATCH_ROWS, BATCH_BYTES = 100_000, 4 << 20
_U = np.uint64


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long"), text.alias("text"))


def _valid(pos: np.ndarray, n: int, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance from a window's start to the anchor, for
    windows that lie in the text and hold the anchor's gram."""
    return np.maximum(0, pos + length - n), np.minimum(length - gram, pos)


def _salt(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out + p.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(29)
    return out


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, parts, found = batch.column(0).to_numpy(), ([], [], [], []), 0
            for rid, text in zip(rids, batch.column(1), strict=True):
                data = text.as_py().encode()
                if len(data) < length:
                    continue
                w = Windows(data)
                grams = w.grams(gram)
                pos = anchors(grams, length - gram + 1)
                low, high = _valid(pos, len(data), length, gram)
                hull = w.hash(pos - high, pos - low + length) ^ _salt(low, high)
                for part, x in zip(parts, (np.full(len(pos), rid), pos.astype(np.int32), grams[pos].view(np.int64), hull.view(np.int64)), strict=True):
                    part.append(x)
                found += len(pos)
                if found >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["rid", "pos", "g", "e"])
                    parts, found = ([], [], [], []), 0
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["rid", "pos", "g", "e"])

    return run


def _contexts(placed: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around each anchor that any of its windows can reach, cut by
    Spark from (rid, text, pos): no texts pass through Python."""
    pos, n = F.col("pos"), F.octet_length("text")
    start = F.greatest(F.lit(0), pos - (length - gram))
    return placed.select("rid", "text", F.explode("pos").alias("pos")).select(
        "rid", "pos", (pos - start).cast("int").alias("at"),
        F.greatest(F.lit(0), pos + length - n).cast("int").alias("low"),
        F.least(F.lit(length - gram), pos).cast("int").alias("high"),
        F.col("text").cast("binary").substr(start + 1, pos + length - start).alias("bytes"),
    )


def _split(length: int, level: int, width: int):
    """Rows (rid, pos, lo, hi, start, end, core, hull) for the ranges of
    ``width`` offsets inside each anchor's open ranges."""
    step = max(1, BATCH_ROWS // (length // width + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            data = b"".join(batch.column("bytes").to_pylist())
            sizes = np.array([len(x.as_buffer()) for x in batch.column("bytes")], np.int64)
            if not len(sizes):
                continue
            w = Windows(data)  # one string for the batch: a slice's hash does not depend on where it lies
            base = np.concatenate(([0], np.cumsum(sizes)[:-1])) + batch.column("at").to_numpy()
            lists = batch.column("open")
            owner = np.repeat(np.arange(len(sizes)), np.array([len(x) for x in lists], np.int64))
            flat = lists.flatten()
            lo0, hi0 = flat.field("lo").to_numpy().astype(np.int64), flat.field("hi").to_numpy().astype(np.int64)
            steps = -(-(hi0 - lo0 + 1) // width)
            parent = np.repeat(np.arange(len(lo0)), steps)
            nth = np.arange(len(parent)) - np.repeat(np.cumsum(steps) - steps, steps)
            lo = lo0[parent] + nth * width
            hi = np.minimum(hi0[parent], lo + width - 1)
            own = owner[parent]
            low, high = batch.column("low").to_numpy().astype(np.int64)[own], batch.column("high").to_numpy().astype(np.int64)[own]
            from_, to = np.maximum(lo, low), np.minimum(hi, high)
            ok = from_ <= to
            lo, hi, own, from_, to = lo[ok], hi[ok], own[ok], from_[ok], to[ok]
            a = base[own]
            core = w.hash(a - lo, a - hi + length) ^ _salt(np.full(len(lo), level), lo)
            hull = w.hash(a - to, a - from_ + length) ^ _salt(from_, to)
            pos = batch.column("pos").to_numpy().astype(np.int64)[own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(batch.column("rid").to_numpy()[own]),
                    *(pa.array(x.astype(np.int32)) for x in (pos, lo, hi, pos - to, pos - from_ + length)),
                    pa.array(core.view(np.int64)),
                    pa.array(hull.view(np.int64)),
                ],
                ["rid", "pos", "lo", "hi", "start", "end", "core", "hull"],
            )

    return run


_SPLIT = "rid long, pos int, lo int, hi int, start int, end int, core long, hull long"


def repeated_ranges(docs: DataFrame, length: int = 200, gram: int = 100) -> DataFrame:
    """(rid, start, end): byte ranges made of repeated windows. An end of -1
    stands for all windows around the anchor at ``start``. ``rid`` is
    ``xxhash64(doc_id, text)``; rows alike in both repeat each other."""
    rows = _rows(docs).select("rid", "text")
    sample = settle(rows.mapInArrow(_find_anchors(length, gram), "rid long, pos int, g long, e long"), "anchors")
    shared = settle(sample.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g"), "grams")
    repeated = settle(sample.join(shared, "g"), "buckets")
    discard(sample, shared)
    classes = settle(
        repeated.groupBy("g", "e").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "pos")).alias("first")), "classes"
    )
    mixed = settle(
        classes.groupBy("g").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).filter("k > 1 AND least = 1").select("g"),
        "mixed",
    )
    alike = settle(classes.filter("c > 1").select("g", "e"), "alike")
    marks = [settle(repeated.join(alike, ["g", "e"]).select("rid", F.col("pos").alias("start"), F.lit(-1).alias("end")), "sure")]
    members = settle(
        classes.join(mixed, "g").select("first.rid", "first.pos").groupBy("rid").agg(F.collect_list("pos").alias("pos")),
        "members",
    )
    discard(repeated, classes, mixed, alike)
    around = settle(
        _contexts(rows.join(members, "rid").select("rid", "text", "pos"), length, gram), "contexts"
    )
    discard(members)
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.lit(length - gram).alias("hi")))
    todo = around.withColumn("open", whole)
    for level, width in enumerate(WIDTHS):
        parts = settle(
            todo.select("rid", "pos", "at", "low", "high", "bytes", "open").mapInArrow(_split(length, level, width), _SPLIT), "split"
        )
        classes = settle(
            parts.groupBy("core", "hull").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rid", "pos", "lo", "hi")).alias("first")),
            "classes",
        )
        alike = settle(classes.filter("c > 1").select("core", "hull"), "alike")
        marks.append(settle(parts.join(alike, ["core", "hull"]).select("rid", "start", "end"), "sure"))
        if width == 1:
            discard(parts, classes, alike)
            break
        mixed = settle(
            classes.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("least")).filter("k > 1 AND least = 1").select("core"),
            "mixed",
        )
        open_ = settle(
            classes.join(mixed, "core").groupBy("first.rid", "first.pos").agg(F.collect_list(F.struct("first.lo", "first.hi")).alias("open")),
            "open",
        )
        discard(parts, classes, alike, mixed)
        todo = around.join(open_, ["rid", "pos"])
    out = marks[0]
    for m in marks[1:]:
        out = out.union(m)
    return out


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(length: int, gram: int):
    def out_batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text, starts, ends in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = text.as_py().encode()
                gone, runs, rest = 0, 0, data
                if starts.is_valid and len(starts.values):
                    s = np.asarray(starts.values, np.int64)
                    e = np.asarray(ends.values, np.int64)
                    low, high = _valid(s, len(data), length, gram)
                    whole = e < 0
                    s, e = np.where(whole, s - high, s), np.where(whole, s - low + length, e)
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e, -1)
                    out = np.cumsum(edge[:-1]) > 0
                    gone = int(out.sum())
                    runs = int(out[0]) + int((out[1:] & ~out[:-1]).sum())
                    rest = np.frombuffer(data, np.uint8)[~out].tobytes()
                rows.append((doc.as_py(), len(data), gone, runs, hashlib.sha256(rest).hexdigest(), rest))
                held += len(rest)
                if held >= BATCH_BYTES:
                    yield out_batch(rows)
                    rows, held = [], 0
            if rows:
                yield out_batch(rows)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), one row for
    each input row, in any order. Null is an empty text. Texts under ``length``
    bytes keep everything; of texts that occur in two rows nothing stays if
    they have ``length`` bytes. ``kept`` is binary, for a cut may part a
    character."""
    ranges = repeated_ranges(docs, length, gram)
    marks = ranges.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("m"))
    joined = _rows(docs).join(marks, "rid", "left").select("doc_id", "text", F.col("m.start").alias("s"), F.col("m.end").alias("e"))
    return joined.mapInArrow(_cut(length, gram), _KEPT)


def op3_bucket_refinement(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, md5(h[s + 1:s + 200]) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS s FROM d WHERE n >= 200)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
p AS (SELECT doc_id, s, lag(s) OVER o AS a, lead(s) OVER o AS b FROM w JOIN r USING (k) WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
t AS (SELECT doc_id, sum(least(200, coalesce(b - s, 200))) AS n_removed, count(*) FILTER (WHERE a IS NULL OR s > a + 200) AS n_spans FROM p GROUP BY doc_id),
g AS (  -- kept pieces: before the first, between and after the last repeated window
  SELECT doc_id, CASE WHEN a IS NULL THEN 0 ELSE a + 200 END AS x, s AS y FROM p WHERE a IS NULL OR s > a + 200
  UNION ALL SELECT p.doc_id, s + 200, n FROM p JOIN d USING (doc_id) WHERE b IS NULL
  UNION ALL SELECT doc_id, 0, n FROM d WHERE doc_id NOT IN (SELECT doc_id FROM t)
),
k AS (SELECT g.doc_id, sha256(unhex(string_agg(hex(h[x + 1:y]), '' ORDER BY x))) AS kept_sha256 FROM g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, kept_sha256
FROM d LEFT JOIN t USING (doc_id) JOIN k USING (doc_id)
"""
