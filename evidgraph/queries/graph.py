"""A01-A03, J02, J10, J17, G01-G05, G08, G09, G12, O05, O09-O11 over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators.report import graph_totals as totals
from ..schema import EDGE_WEIGHTS
from . import views as v
from .views import ctes, view

_BASE = f"WITH RECURSIVE {ctes(nodes=v.NODES, edges=v.EDGES)}"
_ADJ = """, adj AS (SELECT source AS here, target AS there, type, TRUE AS forward FROM edges UNION ALL SELECT target, source, type, FALSE FROM edges)"""
_TARGETS = "SELECT 'supplier:' || s_suppkey AS id FROM {supplier} UNION ALL SELECT 'nation:' || n_nationkey FROM {nation}"
_SEEDS = "SELECT p_size AS query_id, 'part:' || min(p_partkey) AS id FROM {part} GROUP BY p_size"
_STARTS = "SELECT 'supplier:' || min(s_suppkey) AS id FROM {supplier} UNION ALL SELECT 'region:' || min(r_regionkey) FROM {region}"
#: Orders supersede an older order of the same customer; every customer's newest is also superseded by its oldest if their keys are odd together.
_CHAIN = """
SELECT o_orderkey AS u, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM {orders}
UNION ALL SELECT min(o_orderkey), max(o_orderkey) FROM {orders} GROUP BY o_custkey HAVING o_custkey % 50 = 1
"""
_CALLS = """
SELECT 'order.' || l_orderkey AS symbol, 'lib.part' || (l_partkey % 40) AS target, l_linenumber AS line FROM {lineitem}
"""
_NOISE = [f"part{i}" for i in (0, 7, 14)]
_NOISE_SQL = ", ".join(f"'{n}'" for n in _NOISE)
_WEIGHT = "CASE type " + " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in EDGE_WEIGHTS.items()) + " END * CASE WHEN forward THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END"


def _graph(spark, d):
    return view(spark, d, v.NODES), view(spark, d, v.EDGES)


def node_type_counts(spark, d):
    return g.type_counts(view(spark, d, v.NODES))


def edge_type_counts(spark, d):
    return g.type_counts(view(spark, d, v.EDGES))


def graph_totals(spark, d):
    n, e = _graph(spark, d)
    return totals(n, e, F.lit(None).cast("string"))


def degree_top(spark, d):
    n, e = _graph(spark, d)
    return g.degree_top(e, n, 25)


def neighbors(spark, d):
    n, e = _graph(spark, d)
    return g.neighbors(e, n, view(spark, d, _TARGETS))


def reverse_dependents(spark, d):
    n, e = _graph(spark, d)
    found = g.impact(e, n, view(spark, d, _TARGETS))
    return found.groupBy("target", "edge_type").agg(F.countDistinct("dependent").alias("dependents"))


def impact_surface(spark, d):
    n, e = _graph(spark, d)
    return g.impact(e, n, view(spark, d, "SELECT 'supplier:' || s_suppkey AS id FROM {supplier}")).select("target", "dependent", "dependent_type", "edge_type", "surface")


def bfs_distance(spark, d):
    _, e = _graph(spark, d)
    return g.bfs(e, view(spark, d, _STARTS), 3).select("start", "node", "distance")


def shortest_path_hops(spark, d):
    """The path between two suppliers, hop by hop."""
    n, e = _graph(spark, d)
    ends = n.filter("id LIKE 'supplier:%'").agg(F.min("id").alias("a"), F.max("id").alias("b")).head()
    path = g.shortest_path(e, ends["a"], ends["b"])
    return spark.createDataFrame([(len(path) - 1, path[0], path[-1])], "length int, first string, last string")


def weighted_reach(spark, d):
    n, e = _graph(spark, d)
    out = g.weighted_reach(e, n, view(spark, d, _SEEDS), 2)
    return out.select("query_id", "node", F.round("strength", 6).alias("strength"))


def traverse_items(spark, d):
    """The exact best-first traversal; greedy settling has no SQL form."""
    n, e = _graph(spark, d)
    return g.traverse(e, n, view(spark, d, _SEEDS), 2, 20).select("query_id", "node", "type", "score", "distance", "via_type")


def closure(spark, d):
    return g.closure(view(spark, d, f"SELECT u, v FROM ({_CHAIN}) WHERE v IS NOT NULL")).select("u", "v")


def cycle_members(spark, d):
    return g.reaches_cycle(view(spark, d, f"SELECT u, v FROM ({_CHAIN}) WHERE v IS NOT NULL"))


def resolve_target(spark, d):
    n, _ = _graph(spark, d)
    asked = view(spark, d, "SELECT n_name AS target FROM {nation} UNION ALL SELECT c_name FROM {customer} UNION ALL SELECT 'part:' || p_partkey FROM {part} UNION ALL SELECT r_name || '/x.py' FROM {region} UNION ALL SELECT r_name || '/' || n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
    return g.resolve_targets(n, asked)


def symbol_file_promotion(spark, d):
    """Files that contain seed symbols and are no seeds themselves."""
    n, _ = _graph(spark, d)
    seeds = view(spark, d, "SELECT 'customer:' || c_custkey AS id FROM {customer} WHERE c_acctbal > 9000")
    files = n.filter("type = 'File'").select(F.col("id").alias("file"), "source_path")
    return seeds.join(n, "id").join(files, "source_path").select("file").distinct().join(seeds.withColumnRenamed("id", "file"), "file", "left_anti")


def export_edges(spark, d):
    """O11 + J17: the edges among the first 600 nodes of the bounded view."""
    n, e = _graph(spark, d)
    return g.keep_endpoints(e, g.bounded_view(n, 600)).select("source", "target", "type")


def flow_ordered_calls(spark, d):
    out = g.ordered_calls(view(spark, d, _CALLS), _NOISE)
    return out.select("symbol", F.col("step").cast("long"), "name", "line")


def orchestrator_pick(spark, d):
    calls = view(spark, d, "SELECT 'cust.' || o_custkey AS owner, 'order.' || o_orderkey AS symbol, 'lib.part' || (l_partkey % 40) AS target FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey")
    return g.orchestrator(calls, _NOISE)


def flow_trace(spark, d):
    """Call skeletons of a few entries, two levels deep."""
    calls = view(spark, d, _CALLS)
    resolved = view(spark, d, "SELECT 'order.' || l_orderkey AS symbol, 'part' || (l_partkey % 40) AS name, 'order.' || min(l_partkey % 40 + 1) AS target FROM {lineitem} GROUP BY 1, 2")
    entries = view(spark, d, "SELECT 'order.' || min(o_orderkey) AS id FROM {orders} GROUP BY o_orderpriority")
    return g.flow(calls, resolved, entries, _NOISE, 2, 15).select("entry", "depth", "path", "symbol", "name", "line", "resolved")


QUERIES = {f.__name__: f for f in (
    node_type_counts, edge_type_counts, graph_totals, degree_top, neighbors, reverse_dependents, impact_surface, bfs_distance, shortest_path_hops,
    weighted_reach, traverse_items, closure, cycle_members, resolve_target, symbol_file_promotion, export_edges, flow_ordered_calls, orchestrator_pick, flow_trace)}

_IMPACT = f"""{_BASE}, t AS (SELECT * FROM (%s)),
s0 AS (SELECT id AS target, id AS node FROM t),
s1 AS (SELECT * FROM s0 UNION SELECT s0.target, e.target FROM s0 JOIN edges e ON e.source = s0.node AND e.type = 'CONTAINS'),
surf AS (SELECT s1.*, n.source_path AS place FROM s1 JOIN nodes n ON n.id = s1.node),
dep AS (SELECT DISTINCT surf.target, e.source AS dependent, n.type AS dependent_type, e.type AS edge_type, surf.node AS surface
        FROM surf JOIN edges e ON e.target = surf.node AND e.type IN ('CALLS', 'IMPORTS', 'INHERITS', 'REFERENCES', 'CONFIGURES')
        JOIN nodes n ON n.id = e.source WHERE n.source_path IS DISTINCT FROM surf.place AND NOT EXISTS (SELECT 1 FROM surf x WHERE x.target = surf.target AND x.node = e.source))"""
_REL = f"WITH RECURSIVE c AS (SELECT DISTINCT u, v FROM ({v.plain(_CHAIN)}) WHERE v IS NOT NULL), r AS (SELECT u, v FROM c UNION SELECT r.u, c.v FROM r JOIN c ON r.v = c.u)"
ORACLES = {
    "node_type_counts": f"{_BASE} SELECT type, count(*) AS count FROM nodes GROUP BY type",
    "edge_type_counts": f"{_BASE} SELECT type, count(*) AS count FROM edges GROUP BY type",
    "graph_totals": f"{_BASE} SELECT (SELECT count(*) FROM nodes) AS nodes, 0::BIGINT AS accepted, 0::BIGINT AS proposed, (SELECT count(*) FROM edges) AS edges",
    "degree_top": f"""{_BASE}, e AS (SELECT * FROM edges WHERE type IN ('CALLS', 'IMPORTS', 'INHERITS', 'REFERENCES', 'CONFIGURES') AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
x AS (SELECT source AS id FROM e UNION ALL SELECT target FROM e)
SELECT id, type, label, count(*) AS degree FROM x JOIN nodes USING (id) WHERE type IN ('File', 'Symbol') GROUP BY id, type, label ORDER BY degree DESC, id LIMIT 25""",
    "neighbors": f"{_BASE}{_ADJ} SELECT t.id, there AS neighbor, n.type AS neighbor_type, adj.type AS edge_type, forward FROM ({v.plain(_TARGETS)}) t JOIN adj ON adj.here = t.id JOIN nodes n ON n.id = there",
    "reverse_dependents": _IMPACT % v.plain(_TARGETS) + " SELECT target, edge_type, count(DISTINCT dependent) AS dependents FROM dep GROUP BY ALL",
    "impact_surface": _IMPACT % "SELECT 'supplier:' || s_suppkey AS id FROM supplier" + " SELECT * FROM dep",
    "bfs_distance": f"""{_BASE}{_ADJ}, b AS (
  SELECT id AS start, id AS node, 0 AS distance FROM ({v.plain(_STARTS)})
  UNION SELECT b.start, adj.there, b.distance + 1 FROM b JOIN adj ON adj.here = b.node WHERE b.distance < 3)
SELECT start, node, min(distance) AS distance FROM b GROUP BY start, node""",
    "shortest_path_hops": f"""{_BASE}{_ADJ}, k AS (SELECT min(id) AS a, max(id) AS b FROM nodes WHERE id LIKE 'supplier:%'),
b AS (SELECT a AS node, 0 AS distance FROM k UNION SELECT adj.there, b.distance + 1 FROM b JOIN adj ON adj.here = b.node WHERE b.distance < 4)
SELECT min(distance) AS length, any_value(k.a) AS first, any_value(k.b) AS last FROM b, k WHERE node = k.b""",
    "weighted_reach": f"""{_BASE}{_ADJ}, w AS (SELECT here, there, max({_WEIGHT}) AS w FROM adj WHERE there IN (SELECT id FROM nodes) GROUP BY here, there),
s0 AS (SELECT query_id, id AS node, 1.0::DOUBLE AS s FROM ({v.plain(_SEEDS)})),
s1 AS (SELECT query_id, there AS node, max(s * w) AS s FROM s0 JOIN w ON here = node GROUP BY ALL),
s2 AS (SELECT query_id, there AS node, max(s * w) AS s FROM s1 JOIN w ON here = node GROUP BY ALL)
SELECT query_id, node, round(max(s), 6) AS strength FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY query_id, node""",
    "closure": f"{_REL} SELECT DISTINCT u, v FROM r",
    "cycle_members": f"{_REL} SELECT DISTINCT u AS id FROM r WHERE v IN (SELECT u FROM r WHERE u = v)",
    "resolve_target": f"""{_BASE}, a AS (SELECT DISTINCT target FROM (SELECT n_name AS target FROM nation UNION ALL SELECT c_name FROM customer UNION ALL SELECT 'part:' || p_partkey FROM part
  UNION ALL SELECT r_name || '/x.py' FROM region UNION ALL SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey)),
c AS (SELECT target, id, 0 AS p, 'exact' AS how, 0 AS n FROM a JOIN nodes ON id = target
  UNION ALL SELECT target, id, CASE type WHEN 'File' THEN 1 ELSE 2 END, 'exact', len(id) FROM a JOIN nodes ON path = target
  UNION ALL SELECT target, id, 3, 'exact', len(id) FROM a JOIN nodes ON type = 'Symbol' AND lower(label) = lower(target)
  UNION ALL SELECT target, id, 4, 'suffix', len(path) FROM a JOIN nodes ON type = 'File' AND (path = target OR ends_with(path, '/' || target)) WHERE regexp_matches(target, '[/\\\\]|\\.[A-Za-z0-9]{{1,8}}$')),
b AS (SELECT target, id, how FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY p, n, id) = 1)
SELECT a.target, b.id, coalesce(b.how, 'missing') AS how FROM a LEFT JOIN b USING (target)""",
    "symbol_file_promotion": f"{_BASE} SELECT DISTINCT f.id AS file FROM nodes s JOIN nodes f ON f.type = 'File' AND f.source_path = s.source_path WHERE s.id IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_acctbal > 9000)",
    "export_edges": f"{_BASE}, k AS (SELECT id FROM nodes ORDER BY CASE type WHEN 'Community' THEN 1 ELSE 2 END, id LIMIT 600) SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)",
    "flow_ordered_calls": f"""WITH c AS ({v.plain(_CALLS)}), f AS (SELECT symbol, string_split(target, '.')[-1] AS name, min(line) AS line FROM c GROUP BY ALL HAVING name NOT IN ({_NOISE_SQL})),
s AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY line, name) AS step FROM f) SELECT symbol, step, name, line FROM s WHERE step <= 15""",
    "orchestrator_pick": f"""WITH c AS (SELECT 'cust.' || o_custkey AS owner, 'order.' || o_orderkey AS symbol, count(*) FILTER (WHERE 'part' || (l_partkey % 40) NOT IN ({_NOISE_SQL})) AS n
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) SELECT owner, symbol, n FROM c QUALIFY row_number() OVER (PARTITION BY owner ORDER BY n DESC, symbol) = 1""",
    "flow_trace": f"""WITH c AS ({v.plain(_CALLS)}), f AS (SELECT symbol, string_split(target, '.')[-1] AS name, min(line) AS line FROM c GROUP BY ALL HAVING name NOT IN ({_NOISE_SQL})),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY line, name) AS step FROM f QUALIFY step <= 15),
r AS (SELECT 'order.' || l_orderkey AS symbol, 'part' || (l_partkey % 40) AS name, 'order.' || min(l_partkey % 40 + 1) AS target FROM lineitem GROUP BY 1, 2),
st AS (SELECT o.*, r.target AS resolved FROM o LEFT JOIN r USING (symbol, name)),
e AS (SELECT 'order.' || min(o_orderkey) AS entry FROM orders GROUP BY o_orderpriority),
d0 AS (SELECT entry, 0 AS depth, printf('%03d', step) AS path, symbol, name, line, resolved FROM e JOIN st ON symbol = entry),
x1 AS (SELECT entry, resolved AS symbol, min(path) AS p FROM d0 WHERE resolved <> entry GROUP BY ALL),
d1 AS (SELECT entry, 1 AS depth, p || '.' || printf('%03d', step) AS path, symbol, name, line, resolved FROM x1 JOIN st USING (symbol)),
x2 AS (SELECT entry, resolved AS symbol, min(path) AS p FROM d1 WHERE resolved <> entry AND NOT EXISTS (SELECT 1 FROM x1 WHERE x1.entry = d1.entry AND x1.symbol = d1.resolved) GROUP BY ALL),
d2 AS (SELECT entry, 2 AS depth, p || '.' || printf('%03d', step) AS path, symbol, name, line, resolved FROM x2 JOIN st USING (symbol))
SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2""",
}
