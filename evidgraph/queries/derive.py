"""Coverage, communities, conflicts, precedents, sampling, snapshots as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import signature
from ..operators import derive as dv
from . import views as v
from .views import ctes, plain, view

_MEMBERS = "SELECT r_name || '/' || n_name AS path, 'community:' || r_regionkey AS community FROM {nation} JOIN {region} ON n_regionkey = r_regionkey UNION ALL SELECT DISTINCT 'parts/' || p_brand, 'community:parts' FROM {part}"
_CLAIMS = "SELECT 'REC-' || c_custkey AS record, r_name || '/' || n_name AS file FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE c_acctbal > 8000"
_DOCS = "SELECT 'doc:' || doc_id AS id, lang || '/' || source AS path, md5(text) AS hash FROM {documents}"
_LABELED = "SELECT 'label:' || doc_id AS source, 'doc:' || doc_id AS target, 'APPLIES_TO' AS type FROM {labels}"
_GOVERNING = "SELECT 'label:' || doc_id AS id FROM {labels} WHERE quality = 1"
_TASK = "SELECT item_id AS task_id, text AS summary FROM {benchmark}"


def _records(spark, d):
    """Orders as records; seven of eight supersede the order before."""
    number = F.substring("id", 5, 20).cast("long")
    return view(spark, d, v.RECORDS).groupBy("id", "type", "title", "status").agg(F.array_sort(F.collect_set("target")).alias("targets")).withColumn(
        "supersedes", F.when(number % 8 > 0, F.array(F.concat(F.lit("REC-"), (number - 1).cast("string")))).otherwise(F.array().cast("array<string>")))


def covered(spark, d):
    return dv.covered(view(spark, d, _DOCS).select("id"), view(spark, d, _LABELED), view(spark, d, _GOVERNING))


def uncovered(spark, d):
    return dv.uncovered(view(spark, d, _DOCS).select("id"), view(spark, d, _LABELED), view(spark, d, _GOVERNING))


def changed_scope(spark, d):
    """Documents whose path is among the changed ones."""
    changed = view(spark, d, "SELECT DISTINCT lang || '/' || source AS path FROM {documents} WHERE n_chars > 9000")
    return dv.changed_only(view(spark, d, _DOCS), changed).select("id", "path")


def stale_hash(spark, d):
    return dv.stale(view(spark, d, v.INDEXED), view(spark, d, v.CURRENT))


def incremental_diff(spark, d):
    return dv.snapshot_diff(view(spark, d, v.INDEXED), view(spark, d, v.CURRENT))


def changed_symbols(spark, d):
    """Customers in the nations that have a new large account."""
    symbols = view(spark, d, v.NODES).filter("type = 'Symbol'").select("path", "label")
    changed = view(spark, d, "SELECT DISTINCT r_name || '/' || n_name AS path FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE c_acctbal > 9900")
    return dv.changed_symbols(symbols, changed).select("path", F.array_join("labels", ",").alias("labels"))


def file_pair_weights(spark, d):
    n = view(spark, d, v.NODES)
    return dv.file_pair_weights(view(spark, d, v.EDGES), n.select("id", "path"))


def scope_groups(spark, d):
    groups = dv.scope_groups(view(spark, d, v.NODES).select("path"))
    return groups.groupBy("scope").agg(F.count(F.lit(1)).alias("files"), signature(F.collect_set("path")).alias("signature"))


def community_table(spark, d):
    """G10 with A06, A07: scopes as communities; singleton scopes join others."""
    n = view(spark, d, v.NODES)
    out = dv.communities(n.select("path").distinct(), view(spark, d, v.EDGES), n.select("id", "path"))
    return out.select("id", "label", "scope", F.col("files").cast("long").alias("files"))


def community_rollup(spark, d):
    return dv.community_rollup(view(spark, d, _MEMBERS), view(spark, d, v.NODES).select("id", "path"), view(spark, d, _CLAIMS))


def coverage_totals(spark, d):
    return dv.coverage_totals(community_rollup(spark, d))


def cross_community(spark, d):
    n = view(spark, d, v.NODES).select("id", "path")
    return dv.cross_community(view(spark, d, v.EDGES), n, view(spark, d, _MEMBERS))


def project_digest(spark, d):
    """A11 over all documents."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return dv.project_digest(docs.select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.md5("text").alias("hash")))


def signature_hash(spark, d):
    """One signature for each source's documents."""
    return view(spark, d, _DOCS).groupBy("path").agg(signature(F.collect_set("hash")).alias("signature"))


def jaccard_conflicts(spark, d):
    """J16, V06 over orders as records; conflicts by code."""
    out = dv.conflicts(_records(spark, d))
    return out.select("code", "a", "b", F.round("overlap", 6).alias("overlap"))


def dup_titles(spark, d):
    r = _records(spark, d).withColumn("title", F.concat_ws(" ", "title", F.array_join("targets", ",")))
    return dv.duplicate_titles(r).select("title", F.array_join("ids", ",").alias("ids"))


def dup_ids(spark, d):
    """Documents with the same text digest."""
    return dv.duplicate_ids(view(spark, d, "SELECT md5(text) AS id FROM {documents}"))


def broken_refs(spark, d):
    files = view(spark, d, "SELECT 'part/' || (p_partkey % 90) AS path FROM {part}").distinct()
    r = _records(spark, d).withColumn("constraints", F.array().cast("array<string>"))
    return dv.broken_references(r, files).select("code", "id", "reference")


def trust_gate(spark, d):
    """V04 over labels: high-quality documents without a positive review."""
    docs = view(spark, d, "SELECT doc_id, quality, toxic FROM {labels}")
    return docs.groupBy("doc_id").agg(F.max("quality").alias("q"), F.bool_or(F.col("toxic") == 0).alias("ok")).filter("q = 1 AND NOT ok").select("doc_id", F.lit("TRUST001").alias("code"))


def precedent_rank(spark, d):
    """Parts as decisions, benchmark items as tasks."""
    decisions = view(spark, d, "SELECT 'D-' || doc_id AS id, text AS title, 'stable' AS status, lang || '/' || source AS t FROM {documents}").withColumn("targets", F.array("t"))
    tasks = view(spark, d, _TASK).withColumn("changed", F.array(F.concat(F.lit("en/src"), (F.col("task_id") % 20).cast("string")), F.lit("de")))
    return dv.precedents(decisions, tasks).select("task_id", "id", "score", F.col("rank").cast("long"))


def stratified_sample(spark, d):
    """60 documents over the languages."""
    e = view(spark, d, "SELECT doc_id AS pos, lang AS kind FROM {documents}")
    return dv.stratified(e, 60).select("evd_id", "kind", "pos")


def evidence_kind_counts(spark, d):
    """A12."""
    return view(spark, d, "SELECT lang, source FROM {documents}").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


QUERIES = {f.__name__: f for f in (
    covered, uncovered, changed_scope, stale_hash, incremental_diff, changed_symbols, file_pair_weights, scope_groups, community_table, community_rollup,
    coverage_totals, cross_community, project_digest, signature_hash, jaccard_conflicts, dup_titles, dup_ids, broken_refs, trust_gate, precedent_rank,
    stratified_sample, evidence_kind_counts)}

_SCOPE = "CASE WHEN string_split(path, '/')[1] IN ('apps', 'lib', 'packages', 'services', 'src') AND len(string_split(path, '/')) > 2 THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END"
_DIFF = f"WITH {ctes(o=v.INDEXED, n=v.CURRENT)}, s AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash = n.hash THEN 'same' ELSE 'changed' END AS state FROM o FULL JOIN n ON o.path = n.path)"
_ROLL = f"""WITH {ctes(nodes=v.NODES, m=_MEMBERS, claims=_CLAIMS)}, p AS (SELECT path, count(*) AS n FROM nodes GROUP BY path),
b AS (SELECT community, count(*) AS files, greatest(sum(coalesce(n, 0) - 1), 0)::BIGINT AS symbols FROM m LEFT JOIN p USING (path) GROUP BY community),
l AS (SELECT community, count(DISTINCT record) AS records FROM m JOIN claims ON file = path GROUP BY community),
roll AS (SELECT community, files, symbols, coalesce(records, 0)::BIGINT AS records, CASE WHEN coalesce(records, 0) > 0 THEN 'recorded' ELSE 'missing' END AS status FROM b LEFT JOIN l USING (community))"""
_REC = f"""r0 AS ({plain(v.RECORDS)}), rec AS (SELECT id, type, title, status, list_sort(list_distinct(list(target))) AS targets FROM r0 GROUP BY id, type, title, status)"""
ORACLES = {
    "covered": f"SELECT id FROM ({plain(_DOCS)}) WHERE id IN (SELECT 'doc:' || doc_id FROM labels WHERE quality = 1)",
    "uncovered": f"SELECT id FROM ({plain(_DOCS)}) WHERE id NOT IN (SELECT 'doc:' || doc_id FROM labels WHERE quality = 1)",
    "changed_scope": f"SELECT id, path FROM ({plain(_DOCS)}) WHERE path IN (SELECT lang || '/' || source FROM documents WHERE n_chars > 9000)",
    "stale_hash": f"{_DIFF} SELECT path FROM s WHERE state IN ('changed', 'removed')",
    "incremental_diff": f"{_DIFF} SELECT path, state FROM s",
    "changed_symbols": f"""WITH {ctes(nodes=v.NODES)} SELECT path, string_agg(label, ',' ORDER BY label) AS labels FROM nodes WHERE type = 'Symbol' AND path IN (
  SELECT r_name || '/' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9900) GROUP BY path""",
    "file_pair_weights": f"WITH {ctes(nodes=v.NODES, edges=v.EDGES)} SELECT least(s.path, t.path) AS a, greatest(s.path, t.path) AS b, count(*) AS weight FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.path <> t.path GROUP BY 1, 2",
    "scope_groups": f"WITH {ctes(nodes=v.NODES)}, g AS (SELECT DISTINCT {_SCOPE} AS scope, path FROM nodes) SELECT scope, count(*) AS files, left(sha256(string_agg(path, chr(0) ORDER BY path)), 16) AS signature FROM g GROUP BY scope",
    "community_table": f"WITH {ctes(nodes=v.NODES)}, g AS (SELECT DISTINCT {_SCOPE} AS scope, path FROM nodes) SELECT 'community:' || left(sha256(string_agg(path, chr(0) ORDER BY path)), 16) AS id, scope AS label, scope, count(*) AS files FROM g GROUP BY scope",
    "community_rollup": f"{_ROLL} SELECT * FROM roll",
    "coverage_totals": f"{_ROLL} SELECT sum(files)::BIGINT AS assigned, count(*) AS communities, count(*) FILTER (WHERE status = 'recorded') AS with_records, count(*) FILTER (WHERE status = 'missing') AS without_records FROM roll",
    "cross_community": f"""WITH {ctes(nodes=v.NODES, edges=v.EDGES, m=_MEMBERS)}, h AS (SELECT id, community FROM nodes JOIN m USING (path))
SELECT source, target, type, s.community AS from_community, t.community AS to_community FROM edges JOIN h s ON s.id = source JOIN h t ON t.id = target WHERE s.community <> t.community ORDER BY source, target, type LIMIT 200""",
    "project_digest": "SELECT sha256(string_agg('d/' || doc_id || ':' || md5(text), chr(0) ORDER BY 'd/' || doc_id, md5(text))) AS digest FROM documents",
    "signature_hash": f"SELECT path, left(sha256(string_agg(hash, chr(0) ORDER BY hash)), 16) AS signature FROM (SELECT DISTINCT path, hash FROM ({plain(_DOCS)})) GROUP BY path",
    "jaccard_conflicts": f"""WITH RECURSIVE {_REC}, k AS (SELECT id, type, CASE status WHEN 'accepted' THEN 'stable' WHEN 'proposed' THEN 'draft' ELSE status END AS status, targets FROM rec),
f AS (SELECT id, type, status, len(targets) AS n, unnest(targets) AS t FROM k),
p AS (SELECT a.id AS a, b.id AS b, a.status AS sa, b.status AS sb, a.n AS na, b.n AS nb, count(*) AS shared FROM f a JOIN f b ON a.type = b.type AND a.t = b.t AND a.id < b.id GROUP BY ALL),
o AS (SELECT *, shared::DOUBLE / (na + nb - shared) AS overlap FROM p WHERE shared::DOUBLE / (na + nb - shared) >= 0.5 AND (sa = 'stable' OR sb = 'stable')),
x AS (SELECT id, 'REC-' || (substr(id, 5)::BIGINT - 1) AS v FROM rec WHERE substr(id, 5)::BIGINT % 8 > 0),
c AS (SELECT id AS u, v FROM x UNION SELECT c.u, x.v FROM c JOIN x ON x.id = c.v)
SELECT CASE WHEN sa = sb THEN 'CONFLICT002' ELSE 'CONFLICT003' END AS code, a, b, round(overlap, 6) AS overlap FROM o
WHERE NOT EXISTS (SELECT 1 FROM c WHERE (c.u = a AND c.v = b) OR (c.u = b AND c.v = a))""",
    "dup_titles": f"WITH {_REC}, t AS (SELECT id, lower(title || ' ' || array_to_string(targets, ',')) AS title FROM rec WHERE type = 'constraint' AND status IN ('accepted', 'stable')) SELECT title, string_agg(id, ',' ORDER BY id) AS ids FROM t GROUP BY title HAVING count(*) > 1",
    "dup_ids": "SELECT md5(text) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "broken_refs": f"""WITH {_REC}, f AS (SELECT DISTINCT 'part/' || (p_partkey % 90) AS path FROM part UNION SELECT 'part')
SELECT 'LINK001' AS code, id, t AS reference FROM (SELECT id, unnest(targets) AS t FROM rec) WHERE t NOT IN (SELECT path FROM f)
UNION ALL SELECT 'LINK002', id, 'REC-' || (substr(id, 5)::BIGINT - 1) FROM rec WHERE substr(id, 5)::BIGINT % 8 > 0 AND 'REC-' || (substr(id, 5)::BIGINT - 1) NOT IN (SELECT id FROM rec)""",
    "trust_gate": "SELECT doc_id, 'TRUST001' AS code FROM labels GROUP BY doc_id HAVING max(quality) = 1 AND NOT bool_or(toxic = 0)",
    "precedent_rank": f"""WITH d AS (SELECT 'D-' || doc_id AS id, text AS title, lang || '/' || source AS t FROM documents),
k AS (SELECT item_id AS task_id, text AS summary, 'en/src' || (item_id % 20) AS c FROM benchmark),
g AS (SELECT task_id, id, 2.0::DOUBLE AS s FROM k JOIN d ON t = c UNION ALL SELECT task_id, id, 1.0 FROM k JOIN d ON starts_with(t, 'de/')),
sw AS (SELECT DISTINCT task_id, unnest(regexp_extract_all(lower(summary), '[a-z0-9]{{3,}}')) AS w FROM k),
tw AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(title), '[a-z0-9]{{3,}}')) AS w FROM d),
a AS (SELECT * FROM g UNION ALL SELECT task_id, id, count(*)::DOUBLE FROM sw JOIN tw USING (w) GROUP BY ALL),
s AS (SELECT task_id, id, sum(s) AS score FROM a GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 3""",
    "stratified_sample": """WITH e AS (SELECT doc_id AS pos, lang AS kind, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
q AS (SELECT greatest(60 // count(DISTINCT lang), 1) AS q FROM documents),
p AS (SELECT kind, pos, row_number() OVER (ORDER BY rn > q, CASE WHEN rn > q THEN rn ELSE 0 END, kind, rn) AS i FROM e, q)
SELECT printf('EVD-%04d', i) AS evd_id, kind, pos FROM p WHERE i <= 60""",
    "evidence_kind_counts": "SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang",
}
