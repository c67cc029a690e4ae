"""MinHash near-duplicates with tensored banding.

Two small collections of half keys are computed for each document, ``tables``
half keys each, of ``rows`` minhashes a half key. The key of table (i, j) pairs
half i of the first collection with half j of the second: ``tables`` squared
tables from 2 * tables * rows minhashes instead of tables^2 * 2 * rows. A pair
with similarity s meets in some table with probability
(1 - (1 - s^rows)^tables)^2: 0.996 at 0.8, over 0.99999 at 0.9.

Documents with equal shingle sets form one class from the start. In each
table's bucket every class is compared with one representative, on the full
shingle sets. Classes of buckets with more members are then compared through,
dealt out by the half keys of the first collection, of which any two classes
that met share one. Of a half key's classes those of its most frequent component
are its main ones; the others, a minority, meet each other and the main ones,
block by block. Two classes of different components are compared at the first
half key they share, if they share one of the second collection too, inside the
task that holds both blocks, and only links that join two components leave it.
So no two classes that met and that their sizes admit stay uncompared, unless
links join them already, and no pairs are ever written out; joins make one row a
class. Sets of up to ``SKETCH`` shingles
are compared there in full; of longer ones the least ``SKETCH`` hashes tell the
similarity to within 0.01, and pairs within ``SLACK`` of the threshold go to
the confirmation on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, read, settle
from .components import components

_GOLDEN = 0x9E3779B97F4A7C15
#: Hashes of a shingle set that travel with it, the least ones of longer sets.
SKETCH = 2048
#: How far the similarity that the least hashes show may be below the threshold
#: for the full sets to be compared: over 5 standard deviations.
SLACK = 0.05
#: Sets up to this size are compared as Python sets, larger ones as sorted arrays.
_SMALL = 512
#: Classes of a half key in a block; two blocks meet in one task.
BLOCK = 128


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + np.uint64(salt))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles. A shorter
    text is one shingle; a text without words has none."""
    words = (text or "").encode().lower().split()  # bytes methods touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    span = min(width, len(h))
    factors = _series(span, width) | np.uint64(1)
    total = np.full(len(h) - span + 1, span, np.uint64)
    for i in range(span):
        total += _mix(h[i : len(h) - span + 1 + i] * factors[i])
    return np.unique(_mix(total))


class Sketcher:
    """Half keys of shingle sets."""

    def __init__(self, tables: int, rows: int):
        n = 2 * tables * rows
        self.shape = (2 * tables, rows)
        self.a = (_series(n, 101) | np.uint64(1))[:, None]
        self.b = _series(n, 202)[:, None]
        self.fold = (_series(rows, 303) | np.uint64(1))[None, :]
        self.salt = _series(2 * tables, 404)

    def halves(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 2048):
            least = np.minimum(least, (shingles[None, i : i + 2048] * self.a + self.b).min(1))
        folded = (_mix(least).reshape(self.shape) * self.fold).sum(1, dtype=np.uint64)
        return _mix(folded + self.salt)


def _sketch(width: int, tables: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sketcher(tables, rows)
        for batch in batches:
            sizes, keys, halves = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                keys.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) if len(s) else None)
                halves.append(make.halves(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array([None if k is None else int(k[0]) for k in keys], pa.int64()),
                    pa.array([None if k is None else int(k[1]) for k in keys], pa.int64()),
                    pa.array(halves, pa.list_(pa.int64())),
                ],
                ["doc_id", "th", "n", "k1", "k2", "halves"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets overlap by ``percent`` of their union."""
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("su")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("s").alias("sv")), "v")
    shared = both.select("u", "v", F.size(F.array_intersect("su", "sv")).alias("i"), (F.size("su") + F.size("sv")).alias("t"))
    return shared.filter(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("u", "v").distinct()


_PAIRS = "u long, v long, sure boolean"


def _through(tables: int, percent: int):
    """Compares the classes of each block pair (h, lo, hi), whose rows follow
    one another with block lo first, and yields links that join two components:
    ``sure`` ones as found on whole sets, others to be confirmed."""

    def block(rows: list[tuple]) -> list[tuple[int, int, bool]]:
        node, n, comps = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5))
        halves = np.array([r[7] for r in rows], np.int64)
        a, b = halves[:, :tables], halves[:, tables:]
        h, lo, hi = rows[0][:3]
        first = sum(r[6] == lo for r in rows) if lo != hi else len(rows) - 1
        sets = [r[8] if len(r[8]) > _SMALL else frozenset(r[8].tolist()) for r in rows]
        root = {r[5]: r[5] for r in rows}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for i in range(first):
            js = np.arange(first if lo != hi else i + 1, len(rows))
            js = js[(comps[js] != comps[i]) & (100 * np.minimum(n[i], n[js]) >= percent * np.maximum(n[i], n[js]))]
            js = js[(b[js] == b[i]).any(1)]
            js = js[a[i][(a[js] == a[i]).argmax(1)] == h]
            for j in js.tolist():
                p, q = find(rows[i][5]), find(rows[j][5])
                if p == q:
                    continue
                sure, near = _alike(sets[i], sets[j], int(n[i]), int(n[j]), percent)
                if near:
                    out.append((min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j])), sure))
                    if sure:
                        root[p] = q
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        links: list[tuple[int, int, bool]] = []
        for batch in batches:
            least = batch.column(8)
            columns = [batch.column(i).to_pylist() for i in range(7)]
            halves = batch.column(7)
            halves = halves.flatten().to_numpy().reshape(len(halves), -1)
            for k in range(batch.num_rows):
                row = (*(c[k] for c in columns), halves[k], least[k].values.to_numpy())
                if rows and row[:3] != rows[0][:3]:
                    links += block(rows)
                    rows = []
                rows.append(row)
            if len(links) >= 4096:
                yield _pair_batch(links)
                links = []
        if rows:
            links += block(rows)
        if links:
            yield _pair_batch(links)

    return run


def _pair_batch(links: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    u, v, sure = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sure)], ["u", "v", "sure"])


def _alike(x: np.ndarray | frozenset, y: np.ndarray | frozenset, n: int, m: int, percent: int) -> tuple[bool, bool]:
    """(whether it is certain, whether the sets may overlap by ``percent``),
    from their least ``SKETCH`` hashes in ascending unsigned order."""
    if len(x) == n and len(y) == m:
        both_small = isinstance(x, frozenset) and isinstance(y, frozenset)
        i = len(x & y) if both_small else len(np.intersect1d(_array(x), _array(y), assume_unique=True))
        return True, 100 * i >= percent * (n + m - i)
    x, y = _array(x).view(np.uint64), _array(y).view(np.uint64)
    both = np.union1d(x, y)[:SKETCH]
    shared = np.intersect1d(x, y, assume_unique=True)
    return False, int((shared <= both[-1]).sum()) >= (percent / 100 - SLACK) * len(both)


def _array(x: np.ndarray | frozenset) -> np.ndarray:
    return np.fromiter(x, np.int64, len(x)) if isinstance(x, frozenset) else x


def _compared_through(crowded: DataFrame, found: DataFrame, sets: DataFrame, tables: int, percent: int) -> DataFrame:
    """Links (u, v) that join components of ``found`` among the classes
    ``crowded`` (node, n, halves) that share a bucket."""
    member = settle(
        crowded.join(found, "node", "left").select("node", "n", "halves", F.coalesce("component", "node").alias("c")), "members"
    )
    at = member.select("node", "c", F.explode(F.slice("halves", 1, tables)).alias("h"))
    parts = at.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m")).groupBy("h").agg(
        F.max(F.struct("m", "c")).alias("top"), F.sum("m").alias("all")
    )
    blocks = settle(
        parts.filter("all > 2 AND all > top.m").select(
            "h", F.col("top.c").alias("main"),
            F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("minor"),
            F.ceil(F.col("top.m") / BLOCK).cast("int").alias("major"),
        ),
        "blocks",
    )
    # one row a class up to here, with its half keys in a list: what is dealt out is made from it without a join
    lists = settle(at.join(blocks, "h").groupBy("node").agg(F.collect_list(F.struct("h", "main", "minor", "major")).alias("g")), "lists")
    whole = member.join(lists, "node").join(sets.select("node", F.slice("s", 1, SKETCH).alias("s")), "node")
    minor, major, main = F.col("g.minor"), F.col("g.major"), F.col("g.main") == F.col("c")
    dealt = F.xxhash64("node")
    placed = (
        whole.select("node", "n", "c", "halves", "s", F.explode("g").alias("g"))
        .withColumn("own", F.when(main, minor + F.pmod(dealt, major)).otherwise(F.pmod(dealt, minor)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(main, minor).otherwise(minor + major) - 1)))
        .select(
            F.col("g.h").alias("h"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
            "node", "n", "c", "own", "halves", "s",
        )
    )
    dealt = placed.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi", "own")
    links = settle(dealt.mapInArrow(_through(tables, percent), _PAIRS), "through")
    open_ = settle(links.filter("NOT sure").select("u", "v").distinct(), "unsure")
    return settle(links.filter("sure").select("u", "v").union(_links(open_, sets, percent)).distinct(), "more-links")


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, tables: int = 12, rows: int = 4
) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept), one row for each input row.

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` is
    true where it is the row's own. ``th`` is ``xxhash64(text)``. A text
    without words links with nothing. A row without doc_id links with nothing
    either: its component is null and it is kept. Rows that share a doc_id are
    one document with the links of each.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))
    sketches = settle(
        base.mapInArrow(_sketch(width, tables, rows), "doc_id long, th long, n long, k1 long, k2 long, halves array<long>"),
        "sketches",
    )
    classes = settle(
        sketches.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("halves").alias("halves")),
        "classes",
    )
    half = classes.select("node", "n", F.posexplode("halves").alias("i", "h"))
    shared = settle(half.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "halves")
    kept = (
        half.join(shared, "h").groupBy("node", "n")
        .agg(
            F.collect_list(F.when(F.col("i") < tables, F.col("h"))).alias("a"),
            F.collect_list(F.when(F.col("i") >= tables, F.col("h"))).alias("b"),
        )
    )
    keys = settle(
        kept.select("node", "n", F.explode("a").alias("a"), "b")
        .select("node", "n", F.explode("b").alias("b"), "a")
        .select(F.xxhash64("a", "b").alias("key"), "node", "n"),
        "keys",
    )
    reps = settle(
        keys.groupBy("key").agg(F.min(F.struct("node", "n")).alias("r"), F.count(F.lit(1)).alias("c")).filter("c > 1")
        .select("key", F.col("r.node").alias("rep"), F.col("r.n").alias("rn"), (F.col("c") > 2).alias("crowd")),
        "representatives",
    )
    met = settle(
        keys.join(reps, "key").groupBy("rep", "rn", "node", "n").agg(F.max("crowd").alias("crowd")), "met"
    )
    discard(keys, reps, shared)
    fits = (F.least("n", "rn") * 100 >= F.greatest("n", "rn") * percent)
    pairs = settle(
        met.filter((F.col("node") != F.col("rep")) & fits).select(F.col("rep").alias("u"), F.col("node").alias("v")), "pairs"
    )
    crowded = settle(
        classes.select("node", "n", "halves").join(met.filter("crowd").select("node").distinct(), "node"), "crowded"
    )
    nodes = settle(
        pairs.select(F.col("u").alias("node")).union(pairs.select("v")).union(crowded.select("node")).distinct(), "nodes"
    )
    # the candidates grow with the documents, so this is a merge join at every size
    texts = base.join(nodes.hint("merge"), base["doc_id"] == nodes["node"]).select("node", "text")
    sets = settle(texts.mapInArrow(_sets(width), "node long, s array<long>"), "sets")
    links = settle(_links(pairs, sets, percent), "links")
    found = settle(components(links), "components")
    more = _compared_through(crowded, found, sets, tables, percent)
    if not more.isEmpty():
        found = settle(components(links.union(more)), "components")
    named = settle(
        classes.select("k1", "k2", "node").join(found, "node", "left")
        .select("k1", "k2", F.coalesce("component", "node").alias("component")),
        "named",
    )
    rows_out = sketches.select("doc_id", "th", F.col("n").alias("n_shingles"), "k1", "k2").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows_out.select("doc_id", "th", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op2_tensored_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM d
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY u, v),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT DISTINCT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
c AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(c.v, d.doc_id), d.doc_id) AS component_id,
       coalesce(least(c.v, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.u = d.doc_id
"""
