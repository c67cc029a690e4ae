"""Benchmark decontamination over a positional inverted index.

DataFrame functions only. A first pass counts the benchmark's terms in the
corpus. Each window of an item is then looked up by its rarest terms alone: a
second pass stores their postings (term, document, position); positions less
the term's offset in the item meet on the same diagonal where all rare terms
of a window agree. On those diagonals the item's words meet the document's in
an exact join on (document, position, word), so no task holds more than one
text and a text's repeats cost what they are long. Terms are indexed by a 64-bit
hash; the comparison is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, read, settle, settled_bytes

#: Everything that cannot be part of a word once A-Z are lower-cased.
_GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: A settled benchmark side is broadcast only below this size on disk, as measured.
BROADCAST_BYTES = 8 << 20


def _tokens(text: Column) -> Column:
    """Words, with an empty string first or last where a gap leads or trails."""
    return F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), _GAPS)


def _n_words(tokens: Column) -> Column:
    lead = (F.element_at(tokens, 1) == "").cast("long")
    trail = ((F.size(tokens) > 1) & (F.element_at(tokens, -1) == "")).cast("long")
    return F.size(tokens) - lead - trail


def words(text: Column) -> Column:
    return F.filter(_tokens(text), lambda w: w != "")


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is small; ``df`` must be settled."""
    return F.broadcast(df) if settled_bytes(df) <= BROADCAST_BYTES else df


def items_table(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words, n), one row for each distinct item with words."""
    rows = benchmark.select(F.col("item_id").cast("string"), words(F.col("text")).alias("words")).distinct()
    rows = rows.filter(F.size("words") > 0)
    key = F.xxhash64(F.coalesce("item_id", F.lit("")), F.col("item_id").isNull(), "words")
    return settle(rows.select(key.alias("item"), "item_id", "words", F.size("words").alias("n")), "items")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), F.col("text").cast("string"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(h, count) of the terms (h) in all documents."""
    tokens = docs.select(F.explode(_tokens(F.col("text"))).alias("w")).select(F.xxhash64("w").alias("h"))
    return tokens.join(_bounded(terms), "h").groupBy("h").agg(F.count(F.lit(1)).alias("count"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The inverted index for the terms (h): (h, doc_id, th, pos)."""
    placed = _documents(docs).select("doc_id", "th", F.posexplode(_tokens(F.col("text"))).alias("pos", "w"))
    return placed.select(F.xxhash64("w").alias("h"), "doc_id", "th", "pos").join(_bounded(terms), "h")


def rare_offsets(items: DataFrame, counts: DataFrame, width: int, rarest: int) -> DataFrame:
    """(item, start, h, j): for each window of each item its rarest distinct
    terms, with their first offset j in the window."""
    at = items.select(
        "item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - width, F.lit(0)))).alias("start")
    ).select("item", "start", F.posexplode(F.slice("words", F.col("start") + 1, width)).alias("k", "w"))
    at = at.groupBy("item", "start", F.xxhash64("w").alias("h")).agg((F.min("k") + F.col("start")).alias("j"))
    order = Window.partitionBy("item", "start").orderBy(F.coalesce("count", F.lit(0)), "h")
    ranked = at.join(counts, "h", "left").withColumn("r", F.row_number().over(order))
    return ranked.filter(F.col("r") <= rarest).select("item", "start", "h", "j")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, width: int = 10, rarest: int = 2) -> DataFrame:
    """(doc_id, th, item_id, start, end): word positions (from 0, a leading gap
    counting as one; end exclusive) of the occurrences of the items' windows.

    A window is ``width`` consecutive item words; a shorter item is one
    window. Repeated rows of either table are matched once.
    """
    items = items_table(benchmark)
    vocabulary = settle(items.select(F.explode("words").alias("w")).select(F.xxhash64("w").alias("h")).distinct(), "terms")
    counts = settle(term_counts(docs, vocabulary), "counts")
    rare = settle(rare_offsets(items, counts, width, rarest), "rare")
    lists = settle(postings(docs, settle(rare.select("h").distinct(), "rare-terms")), "postings")
    anchors = settle(rare.select("h", "item", "j").distinct(), "anchors")
    windows = settle(
        rare.groupBy("item", "start").agg(F.collect_list("j").alias("js"))
        .groupBy("item").agg(F.collect_set("js").alias("windows")),
        "windows",
    )
    met = (
        lists.join(_bounded(anchors), "h")
        .groupBy("doc_id", "th", "item", (F.col("pos") - F.col("j")).alias("diag"))
        .agg(F.collect_set("j").alias("at"))
        .join(_bounded(windows), "item")
        .filter(F.exists("windows", lambda w: F.forall(w, lambda j: F.array_contains(F.col("at"), j))))
        .select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "item", "diag")
    )
    met = settle(met, "candidates")
    where = settle(met.select("d", "t").distinct(), "candidate-documents")
    texts = _documents(docs).join(where, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi")
    there = texts.select("doc_id", "th", F.posexplode(_tokens(F.col("text"))).alias("pos", "w"))
    due = met.join(_bounded(items), "item").select("d", "t", "item", "item_id", "n", "diag", F.posexplode("words").alias("k", "word"))
    same = there.join(
        due,
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
        & (F.col("pos") == F.col("diag") + F.col("k")) & (F.col("w") == F.col("word")),
    )
    # as many offsets at most as the item has words
    agreed = same.groupBy("doc_id", "th", "item", "item_id", "n", "diag").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    span = F.least("n", F.lit(width))
    runs = F.filter(
        F.sequence(F.lit(0), F.size("ks") - span), lambda i: F.get("ks", i + span - 1) == F.get("ks", i) + span - 1
    )
    starts = agreed.filter(F.size("ks") >= span).select("doc_id", "th", "item_id", "ks", "diag", span.alias("span"), F.explode(runs).alias("i"))
    start = F.col("diag") + F.get("ks", F.col("i"))
    return starts.select("doc_id", "th", "item_id", start.alias("start"), (start + F.col("span")).alias("end")).distinct()


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 30) -> DataFrame:
    """(doc_id, th, item_id, pos): places where every distinct term of an item
    lies within ``slop`` words of an occurrence, at ``pos``, of its rarest."""
    items = items_table(benchmark)
    terms = settle(items.select("item", "item_id", F.explode(F.array_distinct("words")).alias("w")).select(
        "item", "item_id", F.xxhash64("w").alias("h")), "terms")
    vocabulary = settle(terms.select("h").distinct(), "vocabulary")
    lists = settle(postings(docs, vocabulary), "postings")
    counts = lists.groupBy("h").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("count", F.lit(0)), "h"))
    ranked = terms.join(counts, "h", "left").withColumn("r", rank).withColumn(
        "k", F.count(F.lit(1)).over(Window.partitionBy("item"))
    )
    step = slop + 1
    first = ranked.filter("r = 1").join(lists, "h").select(
        "item", "item_id", "k", "doc_id", "th", F.col("pos").alias("p"),
        F.explode(F.array(*[F.floor(F.col("pos") / step) + i for i in (-1, 0, 1)])).alias("cell"),
    )
    others = ranked.select(F.col("item").alias("i"), "h").join(lists, "h").select(
        "i", "h", F.col("doc_id").alias("d"), F.col("th").alias("t"), "pos", F.floor(F.col("pos") / step).alias("c")
    )
    near = first.join(
        others,
        (F.col("item") == F.col("i")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
        & (F.col("cell") == F.col("c")) & (F.abs(F.col("pos") - F.col("p")) <= slop),
    )
    seen = near.groupBy("doc_id", "th", "item", "item_id", "k", "p").agg(F.countDistinct("h").alias("n"))
    return seen.filter("n = k").select("doc_id", "th", "item_id", F.col("p").alias("pos"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, rarest: int = 2) -> DataFrame:
    """(doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated), one
    row for each input row.

    Null text has no words. Rows alike in doc_id and text get the same
    result. An item without item_id marks words but is neither counted nor
    listed. ``th`` is ``xxhash64(text)``. An empty benchmark hits nothing.
    """
    matches = settle(phrase_matches(docs, benchmark, width, rarest), "matches")
    before = Window.partitionBy("doc_id", "th").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("start", F.coalesce(F.max("end").over(before), F.col("start")))
    covered = matches.select("doc_id", "th", "start", "end").distinct().withColumn("new", F.greatest(F.col("end") - reached, F.lit(0)))
    hits = (
        covered.groupBy("doc_id", "th").agg(F.sum("new").alias("n_hit"))
        .join(
            matches.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.array_sort(F.collect_set("item_id")).alias("items")),
            F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")),
        )
        .select("d", "t", "n_hit", "items")
    )
    hits = settle(hits, "hits")
    tokens = _tokens(F.col("text"))
    sized = _documents(docs).select("doc_id", "th", tokens.alias("tokens")).select(
        "doc_id", "th", _n_words(F.col("tokens")).cast("long").alias("n_words")
    )
    out = sized.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "th", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("th")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
),
ln AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ln WHERE len(w) >= n)
),
h AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.p = iw.p),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""
