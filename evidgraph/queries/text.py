"""P01-P28 as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as p
from ..functions import text as t
from . import views as v
from .search import stem_sql, terms_sql, tokens_sql
from .views import plain, view


def tokenize_terms(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.explode(t.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def searchable_text(spark, d):
    return view(spark, d, v.NODES).select("id", t.searchable_text(F.col("label")).alias("searchable"))


def query_terms(spark, d):
    return view(spark, d, v.TASKS).select("query_id", F.array_join(t.query_terms(F.col("query")), " ").alias("terms"))


def stem_terms(spark, d):
    terms = spark.read.parquet(f"{d}/documents.parquet").select(F.explode(t.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", t.stem(F.col("term")).alias("stem"))


def path_kinds(spark, d):
    """P07, P12, P15, S03 over paths made from urls."""
    urls = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace("url", "^https?://[^/]+/", "").alias("path"))
    return urls.select(
        "page_id", "path", t.one_line(F.array_join(p.file_kinds(F.col("path")), ",")).alias("kinds"),
        p.path_like(F.col("path")).alias("path_like"), p.is_test_path(F.col("path")).alias("is_test"), p.has_ignored_directory(F.col("path")).alias("ignored"))


def status_normal(spark, d):
    """P10, P21."""
    r = view(spark, d, v.RECORDS).groupBy("status", "type").agg(F.countDistinct("id").alias("n"))
    title = F.initcap("type")
    return r.select("status", "type", "n", p.normal_status(F.col("status")).alias("normal"),
                    p.is_governing(title, F.col("status")).alias("governing"), p.is_proposed(title, F.col("status")).alias("proposed"))


def evidence_paths(spark, d):
    """P13, P23, P25 over urls and relative specifiers."""
    urls = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace("url", "^https?://", "./").alias("src"))
    spec = F.concat(F.lit("../"), F.substring_index("src", "/", -1))
    return urls.select("page_id", p.evidence_path(F.concat("src", F.lit(":12"))).alias("evidence"),
                       p.relative_stem(spec, F.lit("src/app/main.ts")).alias("stem"), p.record_target(F.col("src")).alias("target"), t.slug(F.col("src")).alias("slug"))


QUERIES = {f.__name__: f for f in (tokenize_terms, searchable_text, query_terms, stem_terms, path_kinds, status_normal, evidence_paths)}
ORACLES = {
    "tokenize_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL",
    "searchable_text": f"""WITH n AS ({plain(v.NODES)}),
p AS (SELECT id, label, list_filter(string_split_regex(regexp_replace(regexp_replace(label, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[._/:-]+', ' ', 'g'), ' +'), lambda x: x <> '') AS x FROM n),
e AS (SELECT id, unnest(list_concat([label], x, list_transform(x, lambda y: lower(y)))) AS w, generate_subscripts(list_concat([label], x, x), 1) AS i FROM p),
f AS (SELECT id, w, min(i) AS i FROM e GROUP BY id, w)
SELECT id, string_agg(w, ' ' ORDER BY i) AS searchable FROM f GROUP BY id""",
    "query_terms": f"""WITH q AS ({plain(v.TASKS)}), e AS (SELECT query_id, unnest({terms_sql('query')}) AS t, generate_subscripts({terms_sql('query')}, 1) AS i FROM q),
f AS (SELECT query_id, t, min(i) AS i FROM e GROUP BY ALL) SELECT query_id, string_agg(t, ' ' ORDER BY i) AS terms FROM f GROUP BY query_id""",
    "stem_terms": f"SELECT DISTINCT term, {stem_sql('term')} AS stem FROM (SELECT unnest({tokens_sql('text')}) AS term FROM documents)",
    "path_kinds": r"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://[^/]+/', '') AS path FROM pages),
x AS (SELECT *, lower(string_split(path, '/')[-1]) AS name, string_split(lower(path), '/') AS parts FROM u),
y AS (SELECT *, coalesce(regexp_extract(name, '.(\.[^.]+)$', 1), '') AS suffix, CASE WHEN len(name) > 1 THEN left(name, 1) || regexp_replace(name[2:], '\.[^.]+$', '') ELSE name END AS stem FROM x)
SELECT page_id, path, concat_ws(',',
  CASE WHEN suffix IN ('.py', '.js', '.ts', '.go', '.rs', '.java') THEN 'source' END,
  CASE WHEN stem IN ('readme', 'contributing', 'architecture', 'design', 'security', 'changelog') OR suffix IN ('.md', '.rst') OR list_contains(parts, 'docs') THEN 'documentation' END,
  CASE WHEN list_contains(parts, 'test') OR list_contains(parts, 'tests') OR starts_with(name, 'test_') OR ends_with(name, '_test.py') THEN 'test' END,
  CASE WHEN name IN ('cargo.toml', 'composer.json', 'gemfile', 'go.mod', 'package.json', 'pom.xml', 'pyproject.toml', 'requirements.txt') THEN 'dependency' END,
  CASE WHEN name IN ('dockerfile', 'docker-compose.yml', 'docker-compose.yaml', 'makefile', 'tox.ini') OR starts_with(path, '.github/workflows/') OR suffix IN ('.tf', '.toml', '.yaml', '.yml') THEN 'configuration' END) AS kinds,
  regexp_matches(path, '[/\\]|\.[A-Za-z0-9]{1,8}$') AS path_like,
  regexp_matches(lower(path), '(^|/)tests?/|(^|/)test_|_test\.') OR contains(lower(path), '.spec.') OR contains(lower(path), '.test.') AS is_test,
  len(list_filter(parts[:-2], lambda q: q IN ('build', 'dist', 'target', 'vendor', 'obj', 'node_modules', 'venv', '.git'))) > 0 AS ignored
FROM y""",
    "status_normal": f"""WITH r AS ({plain(v.RECORDS)})
SELECT status, type, count(DISTINCT id) AS n, CASE status WHEN 'proposed' THEN 'draft' WHEN 'accepted' THEN 'stable' ELSE status END AS normal,
       status IN ('stable', 'accepted', 'implemented') AS governing, status IN ('draft', 'proposed') AS proposed FROM r GROUP BY status, type""",
    "evidence_paths": r"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', './') AS src FROM pages)
SELECT page_id, CASE WHEN NOT contains(src, ' ') THEN src[3:] END AS evidence,
       CASE WHEN regexp_replace(string_split(src, '/')[-1], '\.(tsx?|jsx?|mjs|cjs)$', '') = '' THEN 'src' ELSE 'src/' || regexp_replace(string_split(src, '/')[-1], '\.(tsx?|jsx?|mjs|cjs)$', '') END AS stem,
       src[3:] AS target, regexp_replace(regexp_replace(lower(src), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM u""",
}
