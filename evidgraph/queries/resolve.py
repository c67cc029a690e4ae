"""J03-J09, S10, S11, P22, A22 as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as r
from ..sources import comments, config_keys, html_links
from .views import ctes as _c
from .views import view

_POINTS = "SELECT user_id % 20 AS rel, event_id AS point_id, CAST(floor(value * 10) AS BIGINT) AS at FROM {events}"
_RANGES = "SELECT p_partkey % 20 AS rel, p_partkey AS id, CAST(p_size * 7 AS BIGINT) AS start, CAST(p_size * 7 + p_partkey % 90 AS BIGINT) AS stop FROM {part}"
_CLAIMS = "SELECT 'REC-' || c_custkey AS record, CASE WHEN c_custkey % 3 = 0 THEN r_name WHEN c_custkey % 3 = 1 THEN r_name || '/' || n_name ELSE 'nowhere/' || c_custkey END AS target FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"
_FILES = "SELECT r_name || '/' || n_name AS path FROM {nation} JOIN {region} ON n_regionkey = r_regionkey"
_CALLS = "SELECT DISTINCT 'c:' || o_custkey AS source, p_name AS name, CASE WHEN o_custkey % 4 = 0 THEN p_brand END AS alias_stem FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey"
_SYMBOLS = "SELECT 'part:' || p_partkey AS id, p_name AS label, p_brand AS stem FROM {part}"
_LINES = "SELECT doc_id, text FROM {documents}"


def resolve_name_confidence(spark, d):
    """Calls by part name, some with an alias that names the brand."""
    return r.resolve_by_name(view(spark, d, _CALLS), view(spark, d, _SYMBOLS))


def resolve_priority_coalesce(spark, d):
    """J03's coalescing: a line's partner by supplier and part, by part, by brand."""
    lines = view(spark, d, "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey, l_suppkey, p_brand FROM {lineitem} JOIN {part} ON p_partkey = l_partkey")
    t = lambda text: view(spark, d, text)
    one = t("SELECT l_partkey, l_suppkey, 'ps:' || min(l_orderkey) AS target FROM {lineitem} WHERE l_quantity > 45 GROUP BY l_partkey, l_suppkey")
    two = t("SELECT l_partkey, 'p:' || min(l_orderkey) AS target FROM {lineitem} WHERE l_quantity > 40 GROUP BY l_partkey")
    three = t("SELECT p_brand, 'b:' || min(p_partkey) AS target FROM {part} GROUP BY p_brand")
    grade = lambda df, p, c: df.select("k", "n", "l_partkey", "l_suppkey", "target", F.lit(p).alias("provenance"), F.lit(c).alias("confidence"))
    return r.first_match([
        grade(lines.join(one, ["l_partkey", "l_suppkey"]), "EXTRACTED", 1.0),
        grade(lines.join(two, "l_partkey"), "INFERRED", 0.75),
        grade(lines.join(three, "p_brand"), "AMBIGUOUS", 0.5)], ["k", "n", "l_partkey", "l_suppkey"])


def tightest_enclosing_range(spark, d):
    return r.tightest_enclosing(view(spark, d, _POINTS), view(spark, d, _RANGES))


def prefix_expand(spark, d):
    return r.expand_targets(view(spark, d, _CLAIMS), view(spark, d, _FILES))


def config_keys_flatten(spark, d):
    """S10 over the JSON of events, values left out."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return config_keys.flatten_json(e.select(F.col("event_id").alias("source"), F.col("props").alias("content")))


def config_key_refs(spark, d):
    """Part types as keys, brands and names as references."""
    keys = view(spark, d, "SELECT 'cfg:' || p_partkey AS id, 'parts.' || p_type || '_' || (p_partkey % 400) AS key_path FROM {part}")
    refs = view(spark, d, "SELECT 'c:' || (l_suppkey % 50) AS source, p_type || '-' || (l_partkey % 400) AS target FROM {lineitem} JOIN {part} ON p_partkey = l_partkey")
    return r.config_references(refs, keys)


def comment_tags(spark, d):
    """S11 over the lines of documents: here any line with a marker and a tag."""
    docs = view(spark, d, _LINES).withColumn("content", F.regexp_replace("text", r"(?m)^(The|Das|Der|Los|Les|And) ", "# NOTE: "))
    return comments.tagged_lines(docs.select(F.col("doc_id").alias("path"), "content")).select("path", "line", "tag", "note")


def link_extract(spark, d):
    """Links of every page: (page_id, nth, href)."""
    return html_links.links(spark.read.parquet(f"{d}/pages.parquet"))


QUERIES = {f.__name__: f for f in (
    resolve_name_confidence, resolve_priority_coalesce, tightest_enclosing_range, prefix_expand, config_keys_flatten, config_key_refs, comment_tags, link_extract)}

ORACLES = {
    "resolve_name_confidence": f"""WITH {_c(calls=_CALLS, symbols=_SYMBOLS)},
n AS (SELECT source, name, alias_stem, id, stem FROM calls JOIN symbols ON name = label),
e AS (SELECT source, name, min(id) AS target FROM n WHERE alias_stem = stem GROUP BY ALL),
o AS (SELECT DISTINCT source, name, id FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = n.source AND e.name = n.name)),
g AS (SELECT source, name, min(id) AS target, count(*) AS candidates FROM o GROUP BY ALL)
SELECT source, name, target, 1::BIGINT AS candidates, 1.0::DOUBLE AS confidence, 'EXTRACTED' AS provenance FROM e
UNION ALL SELECT source, name, target, candidates, CASE candidates WHEN 1 THEN 0.9::DOUBLE ELSE round(1::DOUBLE / candidates, 2) END, 'INFERRED' FROM g""",
    "resolve_priority_coalesce": """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey, l_suppkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT l_partkey, l_suppkey, 'ps:' || min(l_orderkey) AS t FROM lineitem WHERE l_quantity > 45 GROUP BY ALL),
b AS (SELECT l_partkey, 'p:' || min(l_orderkey) AS t FROM lineitem WHERE l_quantity > 40 GROUP BY ALL),
c AS (SELECT p_brand, 'b:' || min(p_partkey) AS t FROM part GROUP BY ALL)
SELECT DISTINCT k, n, l_partkey, l_suppkey, coalesce(a.t, b.t, c.t) AS target, CASE WHEN a.t IS NOT NULL THEN 'EXTRACTED' WHEN b.t IS NOT NULL THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS provenance,
  (CASE WHEN a.t IS NOT NULL THEN 1.0 WHEN b.t IS NOT NULL THEN 0.75 ELSE 0.5 END)::DOUBLE AS confidence
FROM l LEFT JOIN a USING (l_partkey, l_suppkey) LEFT JOIN b USING (l_partkey) LEFT JOIN c USING (p_brand)""",
    "tightest_enclosing_range": f"""WITH {_c(p=_POINTS, r=_RANGES)}
SELECT p.rel, p.point_id, p.at, (SELECT r.id FROM r WHERE r.rel = p.rel AND p.at BETWEEN r.start AND r.stop ORDER BY r.stop - r.start, r.start, r.id LIMIT 1) AS enclosing FROM p""",
    "prefix_expand": f"""WITH {_c(c=_CLAIMS, f=_FILES)} SELECT record, target, coalesce(path, target) AS file FROM c LEFT JOIN f ON path = target OR starts_with(path, target || '/')""",
    "config_keys_flatten": """SELECT event_id AS source, k AS key_path, 'value' AS value_type FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)""",
    "config_key_refs": """WITH k AS (SELECT DISTINCT 'cfg:' || p_partkey AS target, regexp_replace(lower(p_type || '_' || (p_partkey % 400)), '[^a-z0-9]', '', 'g') AS k FROM part),
r AS (SELECT k FROM k WHERE len(k) >= 10 GROUP BY k HAVING count(*) <= 5),
u AS (SELECT 'c:' || (l_suppkey % 50) AS source, p_type || '-' || (l_partkey % 400) AS evidence FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT source, target, min(evidence) AS evidence, 0.65::DOUBLE AS confidence FROM u JOIN k ON regexp_replace(lower(evidence), '[^a-z0-9]', '', 'g') = k.k JOIN r USING (k) GROUP BY ALL""",
    "comment_tags": r"""WITH l AS (SELECT doc_id AS path, unnest(string_split(regexp_replace(text, '(?m)^(The|Das|Der|Los|Les|And) ', '# NOTE: ', 'g'), chr(10))) AS line_text,
  generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT path, line::INTEGER AS line, 'NOTE' AS tag, trim(regexp_replace(line_text, '^# NOTE: ', '')) AS note FROM l
WHERE starts_with(line_text, '# NOTE: ') AND trim(regexp_replace(line_text, '^# NOTE: ', '')) <> ''""",
    "link_extract": r"""SELECT page_id, i::INTEGER AS nth, h AS href FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS h, generate_subscripts(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), 1) AS i FROM pages)""",
}
