"""O01-O04, O08, J01."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import search as s
from . import views as v
from .views import ctes, view

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))


def terms_sql(column: str) -> str:
    return (
        "list_filter(regexp_extract_all(lower(strip_accents(replace(regexp_replace("
        f"{column}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', '-'))), '[\\pL\\pN]+'), lambda x: len(x) > 1 AND x NOT IN ({_STOP}))"
    )


def stem_sql(x: str) -> str:
    from ..functions.text import SUFFIXES

    whens = " ".join(f"WHEN ends_with({x}, '{e}') AND len({x}) - {len(e)} >= 3 THEN left({x}, len({x}) - {len(e)})" for e in SUFFIXES)
    return f"(CASE {whens} ELSE {x} END)"


def tokens_sql(x: str) -> str:
    return f"regexp_extract_all(lower(strip_accents(coalesce({x}, ''))), '[\\pL\\pN]+')"


def bm25_sql(corpus: str, tasks: str, w: dict[str, float]) -> str:
    """CTEs up to scored(query_id, node_id, bm25)."""
    tf = " UNION ALL ".join(f"SELECT node_id, unnest({tokens_sql(c)}) AS term, {x}::DOUBLE AS w FROM corpus" for c, x in w.items())
    d = " + ".join(f"len({tokens_sql(c)})" for c in w)
    return f"""{ctes(corpus=corpus, tasks=tasks)},
tf AS (SELECT node_id, term, sum(w) AS f FROM ({tf}) GROUP BY node_id, term),
qt AS (SELECT DISTINCT query_id, unnest({terms_sql('query')}) AS term FROM tasks),
forms AS (SELECT query_id, term AS form, FALSE AS p FROM qt UNION SELECT query_id, {stem_sql('term')}, TRUE FROM qt WHERE {stem_sql('term')} <> term),
vocab AS (SELECT DISTINCT term FROM tf),
fm AS (SELECT form, p, term FROM (SELECT DISTINCT form, p FROM forms) JOIN vocab ON CASE WHEN p THEN starts_with(term, form) ELSE term = form END),
hits AS (SELECT query_id, forms.form, forms.p, node_id, sum(f) AS f FROM forms JOIN fm ON fm.form = forms.form AND fm.p = forms.p JOIN tf USING (term) GROUP BY ALL),
df AS (SELECT query_id, form, p, count(*) AS n FROM hits GROUP BY ALL),
len_ AS (SELECT node_id, {d} AS d FROM corpus),
tot AS (SELECT count(*) AS rows_, avg(d) AS avg_d FROM len_),
scored AS (
  SELECT query_id, node_id, -sum(greatest(ln((rows_ - n + 0.5) / (n + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / avg_d))) AS bm25
  FROM hits JOIN df USING (query_id, form, p) JOIN len_ USING (node_id), tot GROUP BY query_id, node_id)"""


_TOP = """, top AS (SELECT *, round(bm25, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6), node_id) AS r FROM scored)"""
_RANKED = (
    _TOP
    + f""", asked AS (SELECT query_id, {terms_sql('query')} AS terms FROM tasks),
ident AS (SELECT node_id, label, path, {tokens_sql("coalesce(path, '') || ' ' || coalesce(label, '')")} AS ident FROM corpus),
cov AS (
  SELECT top.query_id, top.node_id, label, path, score AS bm25,
         len(list_filter(list_distinct(terms), lambda t: list_contains(ident, t) OR list_contains(list_transform(ident, lambda i: {stem_sql('i')}), {stem_sql('t')}))) AS coverage
  FROM top JOIN ident USING (node_id) JOIN asked USING (query_id) WHERE r <= %d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, bm25, node_id) AS pos FROM cov)"""
)


def _corpus(spark, d):
    return view(spark, d, v.CORPUS), view(spark, d, v.TASKS)


def _parts(spark, d):
    return view(spark, d, v.PARTS), view(spark, d, v.PART_TASKS)


def bm25_search(spark, d):
    """The ten best documents for every benchmark item."""
    c, q = _corpus(spark, d)
    from pyspark.sql import Window

    hits = s.bm25(c, q).withColumn("score", F.round("bm25", 6))
    w = Window.partitionBy("query_id").orderBy("score", "node_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("query_id", "node_id", "score", "rank")


def bm25_field_weighted(spark, d):
    """All matches of the part tasks under label-heavy weights."""
    c, q = _parts(spark, d)
    return s.bm25(c, q, {"label": 4.0, "body": 1.0, "path": 0.5}).select("query_id", "node_id", F.round("bm25", 6).alias("score"))


def coverage_rerank(spark, d):
    c, q = _parts(spark, d)
    out = s.rerank(s.bm25(c, q), c, q)
    return out.select("query_id", "node_id", "bm25", F.col("coverage").cast("long"), F.col("pos").cast("long"))


def diversify_top3(spark, d):
    c, q = _parts(spark, d)
    out = s.search(c, q, limit=20)
    return out.select("query_id", "node_id", "path", F.col("rank").cast("long"))


def seed_selection(spark, d):
    c, q = _parts(spark, d)
    nodes = view(spark, d, v.NODES)
    return s.seeds(s.search(c, q, limit=60), nodes).select("query_id", "node_id", F.col("seed_rank").cast("long"))


def flat_overlap_search(spark, d):
    c, q = _corpus(spark, d)
    return s.flat_overlap(c, q).select("query_id", "node_id", "score", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (bm25_search, bm25_field_weighted, coverage_rerank, diversify_top3, seed_selection, flat_overlap_search)}
_DIV = """, div AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rn > 3, pos) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY pos) AS rn FROM ranked))"""
ORACLES = {
    "bm25_search": f"WITH {bm25_sql(v.CORPUS, v.TASKS, s.WEIGHTS)}{_TOP} SELECT query_id, node_id, score, r::INTEGER AS rank FROM top WHERE r <= 10",
    "bm25_field_weighted": f"WITH {bm25_sql(v.PARTS, v.PART_TASKS, {'label': 4.0, 'body': 1.0, 'path': 0.5})} SELECT query_id, node_id, round(bm25, 6) AS score FROM scored",
    "coverage_rerank": f"WITH {bm25_sql(v.PARTS, v.PART_TASKS, s.WEIGHTS)}{_RANKED % 200} SELECT query_id, node_id, bm25, coverage::BIGINT AS coverage, pos FROM ranked",
    "diversify_top3": f"WITH {bm25_sql(v.PARTS, v.PART_TASKS, s.WEIGHTS)}{_RANKED % 400}{_DIV} SELECT query_id, node_id, path, rank FROM div WHERE rank <= 20",
    "seed_selection": f"""WITH {bm25_sql(v.PARTS, v.PART_TASKS, s.WEIGHTS)}{_RANKED % 1200}{_DIV}
SELECT query_id, node_id, rank AS seed_rank FROM div WHERE rank <= 5""",
    "flat_overlap_search": f"""WITH {ctes(corpus=v.CORPUS, tasks=v.TASKS)},
b AS (SELECT DISTINCT node_id, t FROM (SELECT node_id, unnest({tokens_sql("label || ' ' || body || ' ' || path")}) AS t FROM corpus) WHERE len(t) > 2),
q AS (SELECT DISTINCT query_id, t FROM (SELECT query_id, unnest({tokens_sql('query')}) AS t FROM tasks) WHERE len(t) > 2),
s AS (SELECT query_id, node_id, count(*) AS score FROM b JOIN q USING (t) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s)
SELECT * FROM r WHERE rank <= 8""",
}
