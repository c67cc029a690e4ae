"""Mixing sources to target weights by weighted fair queueing.

Each source is a flow whose rate is its target. Its documents, shuffled by
md5(doc_id), are queued twice over; a queued copy finishes at the virtual time
(tokens of its source so far, itself included) / target. All copies are put in
order of finish time and the order is cut at the total budget. Running sums go
through digest or time buckets, so that no source and no queue is ever ordered
in one task. DataFrame functions only; the driver sees single rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, read, settle

#: Time buckets for each unit of virtual time, and the last time told apart.
TICKS, LATEST = 4096, 64
WEIGHTS = (3, 1, 2)
NAMES = ("size", "source_size", "target", "taken")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn. Targets are
    ``min(epochs * source_size, weight * level)`` with the level at which they
    add up to ``share`` of all words, as found by capping the sources in order
    of ``size / weight``. An empty source has target 0.
    """
    everything = Window.partitionBy()
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn(
        "w", turn[(F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)]
    ).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    order = everything.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    # the level holds for the first source that it does not fill, and so for all after it
    found = ranked.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    at = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("level")))).over(everything)
    return found.withColumn("at", at["level"]).select(
        "source",
        "source_size",
        F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("w"))).alias("target"),
    )


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row for each input row.

    ``taken`` is the size times the number of copies in the mix, 0 to
    ``epochs``. Whole documents are taken, so a source ends within one
    document of its target. Null or blank text has size 0 and is taken with 0
    words. Rows that repeat in doc_id, source and size are queued next to each
    other and cut together. An empty table gives an empty plan.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        count_words(F.col("text").cast("string")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
    )
    sized = settle(rows.withColumn("b", F.substring("h", 1, 3)), "sizes")
    sums = sized.groupBy("source", "b").agg(F.sum("size").alias("n"))
    targets = settle(
        source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, epochs), "targets"
    )
    ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("os"), F.col("b").alias("ob"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("off")
    )
    rates = targets.withColumnRenamed("source", "ts")
    inside = Window.partitionBy("source", "b").orderBy("h", F.col("doc_id").asc_nulls_first(), "size")
    queued = (
        sized.withColumn("inside", F.sum("size").over(inside))  # rows alike share their last one's sum
        .join(offsets, F.col("source").eqNullSafe(F.col("os")) & (F.col("b") == F.col("ob")))
        .withColumn("cum", F.col("inside") + F.col("off"))
        .join(rates, F.col("source").eqNullSafe(F.col("ts")))
        .select("doc_id", "source", "size", "h", "cum", "source_size", "target")
    )
    queued = settle(queued, "queued")

    def finish(k: int):
        return F.when(F.col("target") > 0, (F.col("cum") + F.col("source_size") * k) / F.col("target"))

    def place(time):
        return F.struct(
            time.alias("f"),
            F.col("source").isNull().alias("n"),
            F.coalesce("source", F.lit("")).alias("s"),
            F.col("h").alias("h"),
            F.coalesce("doc_id", F.lit(-(2**63))).alias("d"),
            F.col("size").alias("z"),
        )

    copies = queued.select(
        "size", F.explode(F.array(*[place(finish(k)) for k in range(epochs)])).alias("p")
    ).filter(F.col("p.f").isNotNull())
    copies = copies.withColumn("tick", F.floor(F.least(F.col("p.f"), F.lit(float(LATEST))) * TICKS))
    budget = (targets.agg(F.sum("source_size")).collect()[0][0] or 0) * share
    upto = F.sum("m").over(Window.orderBy("tick"))
    cut = (
        copies.groupBy("tick").agg(F.sum("size").alias("m")).withColumn("upto", upto)
        .filter(F.col("upto") > budget).orderBy("tick").limit(1).collect()
    )
    if not cut:  # everything fits
        within = lambda k: finish(k).isNotNull()
    else:
        tick, base = cut[0]["tick"], cut[0]["upto"] - cut[0]["m"]
        rows_before = Window.partitionBy("tick").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        last = (
            copies.filter(F.col("tick") == tick).withColumn("upto", F.sum("size").over(rows_before) + base)
            .filter(F.col("upto") <= budget).agg(F.max("p").alias("p")).collect()[0]["p"]
        )
        if last is None:
            within = lambda k: F.floor(F.least(finish(k), F.lit(float(LATEST))) * TICKS) < tick
        else:
            end = F.struct(*[F.lit(last[c]).alias(c) for c in "fnshdz"])
            within = lambda k: place(finish(k)) <= end
    taken = sum((F.when(finish(k).isNotNull() & within(k), F.col("size")).otherwise(F.lit(0)) for k in range(epochs)), F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the plan takes it,
    with its own columns. Rows without words are never part of it."""
    plan = mix_plan(docs, weights, share, epochs).filter("taken > 0")
    plan = settle(plan.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"),
                              (F.col("taken") / F.col("size")).cast("int").alias("__n")).distinct(), "plan")
    sized = docs.withColumn("__size", count_words(F.col("text").cast("string")))
    same = (
        F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__z"))
    )
    return (
        sized.join(plan.hint("merge"), same)  # the plan grows with the documents: never a broadcast
        .select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy"))
        .drop("__copy")
    )


def op9_fair_mix(spark, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
r AS (SELECT source, n, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, (n * 2)::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(n) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((sum(w) OVER ()) - coalesce(sum(w) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
a AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE level * w <= cap),
t AS (SELECT source, n, CASE WHEN a.level IS NULL THEN cap ELSE least(cap, a.level * w) END AS target FROM l, a),
q AS (
  SELECT d.*, t.n, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
c AS (SELECT *, k, (cum + n * k)::DOUBLE / target AS f FROM q, range(2) x(k) WHERE target > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY f, source NULLS LAST, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM c),
g AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM o WHERE upto <= 1.5 * (SELECT sum(n) FROM s) GROUP BY doc_id)
SELECT q.doc_id, q.source, q.size, q.n AS source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM q LEFT JOIN g USING (doc_id)
"""
