"""Lexical search: inverted index, BM25, coverage re-rank, diversification
(O01-O04, O08, J01).

Every operator takes a table of queries, so one plan answers many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import demoted
from ..functions.text import match_forms, query_terms, stem, tokens
from ..schema import TYPE_PRIORITY
from .state import settle

#: Column weights; a larger one counts more.
WEIGHTS = {"label": 0.4, "body": 5.0, "path": 0.3}
K1, B = 1.2, 0.75


#: Documents whose matches one task holds at a time.
_HELD = 2_000


#: Forms up to so many go to the hits.
_FEW_FORMS = 20_000


def _tasks(documents: DataFrame) -> int:
    """Tasks that documents are dealt to: a task's memory does not grow with them."""
    return documents.count() // _HELD + 1


def postings(documents: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(node_id, term, f, c): weighted and plain term frequency over the indexed
    columns. Texts are dealt out by document, so splitting runs in parallel
    however few splits the source has, and counting needs no further exchange."""
    weights = weights or WEIGHTS
    parts = [_weighted(c, w) for c, w in weights.items()]
    dealt = documents.select("node_id", *weights).repartition(_tasks(documents), "node_id")
    exploded = dealt.select("node_id", F.explode(F.concat(*parts)).alias("x"))
    return exploded.groupBy("node_id", F.col("x.term").alias("term")).agg(F.sum("x.w").alias("f"), F.count(F.lit(1)).alias("c"))


def _weighted(column: str, weight: float) -> Column:
    return F.transform(
        tokens(F.coalesce(F.col(column), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w"))
    )


@dataclass
class TextIndex:
    """An inverted index, written once and read by any number of searches:
    postings (node_id, term, f), lengths (node_id, d) and the one-row totals."""

    postings: DataFrame
    lengths: DataFrame
    totals: DataFrame


def build_index(documents: DataFrame, weights: dict[str, float] | None = None) -> TextIndex:
    """Every text is split once; lengths and totals follow from the postings.
    Rows without a token count as rows."""
    made = settle(postings(documents, weights), "postings")
    lengths = settle(made.groupBy("node_id").agg(F.sum("c").alias("d")), "lengths")
    rows = documents.agg(F.count(F.lit(1)).alias("rows"))
    totals = lengths.agg(F.sum("d").alias("all")).crossJoin(rows)  # one row each
    totals = settle(totals.select("rows", (F.coalesce("all", F.lit(0)) / F.col("rows")).alias("avg_d")), "totals")
    return TextIndex(made.select("node_id", "term", "f"), lengths, totals)


def query_forms(queries: DataFrame) -> DataFrame:
    """(query_id, form, is_prefix) from (query_id, query): literals and stems."""
    terms = queries.select("query_id", F.explode(query_terms(F.col("query"))).alias("term"))
    return terms.select("query_id", F.explode(match_forms(F.col("term"))).alias("x")).select("query_id", "x.form", "x.is_prefix").distinct()


def bm25(documents: DataFrame | TextIndex, queries: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, node_id, bm25) for every match; smaller is better. Documents
    are indexed here unless they come as an index.

    Prefix forms meet the vocabulary through its prefixes of three or more
    characters, so both kinds of form are equi-joins, and postings join on the
    matched terms only. Forms come from queries: they are the small side, and
    Catalyst broadcasts them while their measured size allows.
    """
    index = documents if isinstance(documents, TextIndex) else build_index(documents, weights)
    forms = query_forms(queries)
    vocabulary = index.postings.select("term").distinct()
    prefixes = vocabulary.select(
        "term", F.explode(F.when(F.length("term") >= 3, F.sequence(F.lit(3), F.length("term"))).otherwise(F.array().cast("array<int>"))).alias("n")
    ).select("term", F.expr("left(term, n)").alias("form"))
    literal = forms.filter("NOT is_prefix").select("form", "is_prefix", F.col("form").alias("term")).distinct()
    prefix = forms.filter("is_prefix").select("form", "is_prefix").distinct().join(prefixes, "form").select("form", "is_prefix", "term")
    # what a form matches does not depend on the query that asks for it
    tasks = _tasks(index.lengths)
    matched = literal.unionByName(prefix).join(index.postings, "term").repartition(tasks, "node_id")
    hits = settle(matched.groupBy("form", "is_prefix", "node_id").agg(F.sum("f").alias("f")), "hits")
    df = settle(hits.groupBy("form", "is_prefix").agg(F.count(F.lit(1)).alias("n")), "df")
    if df.count() <= _FEW_FORMS:  # else hits would be sorted by form, a common one in one task
        df = F.broadcast(df)
    scored = hits.join(df, ["form", "is_prefix"]).repartition(tasks, "node_id").join(index.lengths, "node_id").crossJoin(F.broadcast(index.totals))
    idf = F.greatest(F.log((F.col("rows") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("avg_d")))
    scored = scored.select("form", "is_prefix", "node_id", part.alias("part"))
    return scored.join(forms, ["form", "is_prefix"]).groupBy("query_id", "node_id").agg((-F.sum("part")).alias("bm25"))


def containing(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """P20: (query_id, node_id): rows whose label or body holds the query text
    as it stands, for queries without a usable term. The queries without a term
    are few by nature; each is held against every row."""
    bare = queries.filter((F.size(query_terms(F.col("query"))) == 0) & (F.trim("query") != ""))
    inside = F.contains(F.lower(F.coalesce("label", F.lit(""))), F.lower("query")) | F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lower("query"))
    return documents.join(bare, inside).select("query_id", "node_id")


def coverage(path: Column, label: Column, terms: Column) -> Column:
    """Distinct query terms that the path or label credits, by the literal
    or by equal stems."""
    identity = tokens(F.concat_ws(" ", F.coalesce(path, F.lit("")), F.coalesce(label, F.lit(""))))
    stems = F.transform(identity, stem)
    hit = F.filter(terms, lambda t: F.array_contains(identity, t) | F.array_contains(stems, stem(t)))
    return F.size(hit)


def rerank(hits: DataFrame, documents: DataFrame, queries: DataFrame, over_fetch: int = 200) -> DataFrame:
    """O01 + O02: the best ``over_fetch`` hits a query, by coverage and score:
    (query_id, node_id, label, path, bm25, coverage, pos)."""
    best = Window.partitionBy("query_id").orderBy("score", "node_id")
    top = hits.withColumn("score", F.round("bm25", 6)).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= over_fetch)
    asked = queries.select("query_id", query_terms(F.col("query")).alias("terms"))
    joined = top.join(documents.select("node_id", "label", "path"), "node_id").join(asked, "query_id")
    scored = joined.withColumn("coverage", coverage(F.col("path"), F.col("label"), F.col("terms")))
    order = Window.partitionBy("query_id").orderBy(F.desc("coverage"), "score", "node_id")
    return scored.select(
        "query_id", "node_id", "label", "path", F.col("score").alias("bm25"), "coverage", F.row_number().over(order).alias("pos")
    )


def diversify(ranked: DataFrame, per_file: int = 3) -> DataFrame:
    """At most ``per_file`` hits of a path come first, the rest after, in order."""
    within = Window.partitionBy("query_id", "path").orderBy("pos")
    marked = ranked.withColumn("rn", F.row_number().over(within))
    order = Window.partitionBy("query_id").orderBy(F.col("rn") > per_file, "pos")
    return marked.withColumn("rank", F.row_number().over(order)).drop("rn")


def search(documents: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, node_id, label, path, bm25, coverage, pos, rank)."""
    ranked = rerank(bm25(documents, queries), documents, queries, max(20 * limit, 200))
    return diversify(ranked).filter(F.col("rank") <= limit)


def seeds(found: DataFrame, nodes: DataFrame, max_items: int = 20) -> DataFrame:
    """O04 + P09: (query_id, node_id, seed_rank): search hits whose type may
    seed, demoted ones last."""
    typed = found.join(nodes.select(F.col("id").alias("node_id"), "type"), "node_id")
    typed = typed.filter(F.col("type").isin([t for t in TYPE_PRIORITY]))
    order = Window.partitionBy("query_id").orderBy(demoted(F.col("type"), F.col("path")), "rank")
    ranked = typed.withColumn("seed_rank", F.row_number().over(order))
    return ranked.filter(F.col("seed_rank") <= min(max_items, 5)).select("query_id", "node_id", "seed_rank")


def flat_overlap(documents: DataFrame, queries: DataFrame, top: int = 8) -> DataFrame:
    """The baseline: distinct shared tokens of three or more characters."""
    long_tokens = lambda c: F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) > 2))
    asked = queries.select("query_id", F.explode(long_tokens(F.col("query"))).alias("term"))
    dealt = documents.select("node_id", "label", "body", "path").repartition(_tasks(documents), "node_id")
    body = dealt.select("node_id", F.explode(long_tokens(F.concat_ws(" ", "label", "body", "path"))).alias("term"))
    scored = body.join(asked, "term").groupBy("query_id", "node_id").agg(F.count(F.lit(1)).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
