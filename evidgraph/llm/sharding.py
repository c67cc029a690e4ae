"""Sharding by jump consistent hashing, with DataFrame functions only.

The jump chain of a key is the same for every shard count, so one fold gives
the shard among ``n`` and among ``n + 1``. Slots number the rows of a shard
without gaps: rows fall into 4,096 digest buckets a shard, a bucket's offset
is the running count of the buckets before it, and only single buckets are
ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, read

# Fixed values of the published jump hash: the multiplier 2862933555777941757
# in two 32-bit halves, the increment 1 and the 31-bit scale.
_MUL_HIGH = 2862933555777941757 >> 32
_MUL_LOW = 2862933555777941757 & 0xFFFFFFFF
_SCALE = 2147483648.0
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``value`` evaluated once and called ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _advance(k: str) -> str:
    """SQL for ``k * multiplier + 1`` modulo 2^64 without leaving a long's range."""
    limb = lambda i: f"(shiftrightunsigned({k}, {16 * i}) & 65535L)"
    high = (
        f"((shiftright(t1, 16) + {limb(2)} * {_MUL_LOW}L"
        f" + shiftleft(({limb(3)} * {_MUL_LOW}L) & 65535L, 16)"
        f" + ({k} & 4294967295L) * {_MUL_HIGH}L) & 4294967295L)"
    )
    whole = f"(shiftleft({high}, 32) | (t0 & 65535L) | shiftleft(t1 & 65535L, 16))"
    inner = _let("t1", f"{limb(1)} * {_MUL_LOW}L + shiftright(t0, 16)", whole)
    return _let("t0", f"{limb(0)} * {_MUL_LOW}L + 1L", inner)


def jump_hash(key: str, n: int) -> Column:
    """struct(s, b): the shard of a long column among ``n`` and among ``n + 1``.

    A state past the last shard stays as it is, so its key is never advanced
    again; each step evaluates the multiplication and the jump once."""
    jump = f"cast(floor((a.b + 1) * ({_SCALE}D / (shiftrightunsigned(a.k, 33) + 1L))) AS BIGINT)"
    start = f"named_struct('k', {_advance(key)}, 'b', 0L, 's', 0L, 'done', false)"
    moved = (
        f"if(j > {n}L, named_struct('k', a.k, 'b', a.b, 's', a.s, 'done', true),"
        f" named_struct('k', {_advance('a.k')}, 'b', j, 's', if(j < {n}L, j, a.s), 'done', false))"
    )
    step = f"if(a.done, a, {_let('j', jump, moved)})"
    return F.expr(f"aggregate(sequence(1, {n}), {start}, (a, i) -> {step})")


def shard(docs: DataFrame, n: int = 40) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    The key is doc_id; rows without one use key 0. The shard depends on the
    key and ``n`` alone, and shard ``n``, when added, takes rows only into
    itself. Size is the text's UTF-8 bytes (null: none) plus 16. Slots follow
    md5(doc_id), then doc_id, checksum and size; rows alike in all of them get
    consecutive slots in any order. Columns of ``docs`` with one of these
    names are replaced.
    """
    key, h, j, b, off = free_names(docs, "key", "digest", "jump", "bucket", "offset")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        *[c for c in docs.columns if c not in ADDED],
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias(key),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias(h),
    ).withColumn(j, jump_hash(f"`{key}`", n))
    base = base.select(
        *[c for c in base.columns if c not in (j, key)],
        # never null, so that no filter of a join evaluates the jump again
        F.coalesce(F.col(f"{j}.s").cast("int"), F.lit(0)).alias("shard"),
        F.col(f"{j}.b").cast("int").alias("grown_shard"),
        F.coalesce(F.substring(h, 1, 3), F.lit("")).alias(b),
    )
    counts = base.groupBy("shard", b).agg(F.count(F.lit(1)).alias(off))
    before = Window.partitionBy("shard").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", b, F.coalesce(F.sum(off).over(before), F.lit(0)).alias(off))
    inside = Window.partitionBy("shard", b).orderBy(h, F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    return (
        base.join(offsets, ["shard", b])
        .withColumn("slot", (F.col(off) + F.row_number().over(inside) - 1).cast("long"))
        .select(*[c for c in docs.columns if c not in ADDED], *ADDED)
    )


def op6_jump_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


SQL = """
WITH RECURSIVE bits AS (
  SELECT b AS i, list_reduce(list_concat([b::BIGINT], range(8)),
    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(b)
),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
x AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n,
         list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' '), lambda h: ('0x' || h)) AS hx FROM documents
),
d AS (
  SELECT doc_id, n + 16 AS size,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(hx[1:n], lambda h: h::BIGINT)),
           lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         coalesce(doc_id, 0)::HUGEINT AS key FROM x, tab
),
j AS (
  SELECT DISTINCT key, ((key + CASE WHEN key < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END) * 2862933555777941757 + 1) % 18446744073709551616 AS k, 0::BIGINT AS b, 0::BIGINT AS s FROM d
  UNION ALL
  SELECT key, (k * 2862933555777941757 + 1) % 18446744073709551616,
         floor((b + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT,
         CASE WHEN floor((b + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE)) < 40
              THEN floor((b + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE))::BIGINT ELSE s END
  FROM j WHERE floor((b + 1) * (2147483648.0::DOUBLE / ((k // 8589934592) + 1)::DOUBLE)) <= 40
),
f AS (SELECT key, max(s) AS s, max(b) AS b FROM j GROUP BY key)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, f.s::INTEGER AS shard,
       (row_number() OVER (PARTITION BY f.s ORDER BY h, doc_id, text_crc32, size) - 1)::BIGINT AS slot, f.b::INTEGER AS grown_shard
FROM d JOIN f USING (key)
"""
