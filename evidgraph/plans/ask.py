"""Questions over an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import agent_authored, is_governing, is_proposed, is_test_path, normal_status
from ..operators import derive, graph, report, search
from ..schema import RECORD_TYPES, TYPE_PRIORITY
from .index import Index

# Call names that say nothing about behaviour.
FLOW_NOISE = (
    "len range print isinstance str list dict set tuple int float bool append get keys values items startswith endswith join format split strip"
    " lower upper set_attribute debug info warning error exception isEnabledFor add update super getattr setattr hasattr enumerate zip sorted any all"
    " loads dumps type insert extend reversed field pop copy map filter next iter min max sum abs round repr async_trace_span trace_span span get_client"
    " clear sub group match search findall compile encode decode isoformat now utcnow time sleep gather create_task wait getLogger log count index"
    " replace rstrip lstrip title dataclass Field ConfigDict BaseModel Enum auto"
).split()


def _status():
    return F.get_json_object("data", "$.status")


def context(index: Index, tasks: DataFrame, max_depth: int = 2, max_items: int = 20) -> DataFrame:
    """(query_id, node, type, label, score, distance, via_type, group) for
    tasks (query_id, query): search seeds, their files, best-first traversal;
    group is governing, proposed, file, symbol or other."""
    found = search.search(index.documents, tasks, max(50, 3 * max_items))
    seeds = search.seeds(found, index.nodes, max_items).select("query_id", F.col("node_id").alias("id"))
    home = index.nodes.filter("type = 'Symbol'").select("id", F.concat(F.lit("file:"), "source_path").alias("file"))
    files = seeds.join(home, "id").select("query_id", F.col("file").alias("id"))
    walked = graph.traverse(index.edges, index.nodes, seeds.unionByName(files).distinct(), max_depth, max_items)
    state = index.nodes.select(F.col("id").alias("node"), _status().alias("status"))
    group = (
        F.when(is_governing(F.col("type"), F.col("status")), "governing").when(is_proposed(F.col("type"), F.col("status")), "proposed")
        .when(F.col("type") == "File", "file").when(F.col("type") == "Symbol", "symbol").otherwise("other")
    )
    return walked.join(state, "node").withColumn("group", group)


def compact(packet: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a query: records, files (own and of symbols), symbols, links, communities."""
    p = packet.join(nodes.select(F.col("id").alias("node"), "path"), "node")
    pick = lambda c, v: F.array_sort(F.collect_set(F.when(c, v)))
    return p.groupBy("query_id").agg(
        pick(F.col("type").isin(list(RECORD_TYPES)), F.struct("node", "label", "status")).alias("records"),
        pick(F.col("type").isin("File", "Symbol"), F.col("path")).alias("files"),
        pick(F.col("type") == "Symbol", F.col("label")).alias("symbols"),
        pick(F.col("via_type").isNotNull() & (F.col("via_type") != "CONTAINS"), F.struct("via_source", "via_type", "via_target")).alias("links"),
        pick(F.col("type") == "Community", F.col("label")).alias("communities"))


def resolve(index: Index, targets: DataFrame) -> DataFrame:
    """G05 with search as the last resort."""
    asked = targets.select("target").distinct()
    best = search.search(index.documents, asked.select(F.col("target").alias("query_id"), F.col("target").alias("query")), 1)
    return graph.resolve_targets(index.nodes, asked, best.select(F.col("query_id").alias("target"), "node_id"))


def impact(index: Index, targets: DataFrame) -> DataFrame:
    """Dependents of resolved targets (id), callers split by P15."""
    found = graph.impact(index.edges, index.nodes, targets)
    place = index.nodes.select(F.col("id").alias("dependent"), "path")
    caller = F.col("edge_type").isin("CALLS", "IMPORTS")
    return found.join(place, "dependent").select(
        "*", F.when(caller, F.when(is_test_path(F.col("path")), "test caller").otherwise("caller")).alias("role"))


def path(index: Index, source: str, target: str, max_hops: int = 8) -> DataFrame:
    """The hops of a shortest path; no row if there is none."""
    return graph.path_hops(index.edges, graph.shortest_path(index.edges, source, target, max_hops))


def calls(index: Index) -> DataFrame:
    """(symbol, target, line)."""
    schema = "array<struct<line:int,target:string>>"
    found = index.nodes.filter("type = 'Symbol'").select("id", F.explode(F.from_json(F.get_json_object("data", "$.calls"), schema)).alias("c"))
    return found.select(F.col("id").alias("symbol"), "c.target", "c.line")


def flow(index: Index, entries: DataFrame, max_depth: int = 3, max_steps: int = 15) -> DataFrame:
    """Call skeletons from symbols, classes or files (id)."""
    made = calls(index)
    last = lambda c: F.substring_index(F.substring_index(c, ":", -1), ".", -1)
    direct = index.edges.filter("type = 'CALLS'").select(F.col("source").alias("symbol"), last("target").alias("name"), "target", F.lit(0).alias("p"))
    symbols = index.nodes.filter("type = 'Symbol'").select(F.col("id").alias("target"), "source_path", last("id").alias("name"))
    homes = index.nodes.filter("type = 'Symbol'").select(F.col("id").alias("symbol"), "source_path")
    sibling = made.select("symbol", last("target").alias("name")).distinct().join(homes, "symbol").join(symbols, ["source_path", "name"]).select("symbol", "name", "target", F.lit(1).alias("p"))
    resolved = direct.unionByName(sibling).groupBy("symbol", "name").agg(F.min(F.struct("p", "target")).alias("b")).select("symbol", "name", "b.target")
    inside = index.nodes.filter("type = 'Symbol'").select("id", F.concat(F.lit("file:"), "path").alias("file"), F.concat(F.lit("symbol:"), "path", F.lit(":"), F.regexp_replace("label", r"\.[^.]+$", "")).alias("cls"))
    owned = inside.select(F.col("id").alias("symbol"), F.explode(F.array("file", "cls")).alias("owner")).filter("owner <> symbol")
    bare = entries.select("id").join(made.select(F.col("symbol").alias("id")), "id", "left_anti")
    best = graph.orchestrator(owned.join(bare.select(F.col("id").alias("owner")), "owner", "left_semi").join(made, "symbol", "left").select("owner", "symbol", "target"), FLOW_NOISE)
    start = entries.select("id").join(best, F.col("id") == F.col("owner"), "left").select(F.coalesce("symbol", "id").alias("id")).distinct()
    return graph.flow(made, resolved, start, FLOW_NOISE, max_depth, max_steps)


def explain(index: Index, targets: DataFrame, max_depth: int = 2, max_items: int = 20) -> DataFrame:
    """The neighbourhood of resolved targets (query_id, id), records
    with their prose."""
    walked = graph.traverse(index.edges, index.nodes, targets, max_depth, max_items)
    return walked.join(index.records.select(F.col("id").alias("node"), "status", "body"), "node", "left")


def directory(index: Index, prefix: str, limit: int = 8) -> DataFrame:
    """Files below a directory and records that claim it, lie in it or above it."""
    base = prefix.rstrip("/")
    files = index.nodes.filter((F.col("type") == "File") & F.col("path").startswith(base + "/")).orderBy(F.length("path"), "path").limit(limit).select("id", "type", "label")
    claims = lambda t: (t == base) | t.startswith(base + "/") | F.startswith(F.lit(base), F.concat(F.regexp_replace(t, "/+$", ""), F.lit("/")))
    claimed = index.records.filter(F.exists("targets", claims) | (F.size("targets") == 0)).select("id", F.initcap("type").alias("type"), F.col("title").alias("label"))
    return files.unionByName(claimed)


def learnings(index: Index, changed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Proposals by author and files that no governing record covers."""
    governing = index.nodes.filter(is_governing(F.col("type"), _status())).select("id")
    files = index.nodes.filter("type = 'File'").select("id", "path")
    open_files = derive.uncovered(files, index.edges, governing)
    if changed is not None:
        open_files = derive.changed_only(open_files, changed)
    drafts = index.records.filter(normal_status(F.col("status")) == "draft").select(
        "id", "title", agent_authored(F.col("generated.by"), F.col("id"), F.col("confidence")).alias("agent"))
    return {"proposals": drafts, "uncovered": open_files}


def validate(index: Index) -> DataFrame:
    """E12."""
    paths = index.sources.select("path")
    return derive.validate(index.records, paths, index.sources)


def doctor(index: Index, current: DataFrame) -> DataFrame:
    """(check, ok) rows; ready if all are."""
    spark = index.nodes.sparkSession
    checks = {
        "nodes": not index.nodes.isEmpty(),
        "sources": not index.sources.isEmpty(),
        "unique ids": index.nodes.groupBy("id").count().filter("count > 1").isEmpty(),
        "records parse": index.diagnostics.filter("code IN ('REC001', 'REC003')").isEmpty(),
        "records valid": validate(index).filter("severity = 'error'").isEmpty(),
        "fresh": derive.stale(index.sources, current).isEmpty(),
        "version": index.sources.agg(F.countDistinct("index_version")).head()[0] <= 1,
    }
    return spark.createDataFrame(list(checks.items()), "check string, ok boolean")


def overview(index: Index, top: int = 10) -> dict[str, DataFrame]:
    """E07."""
    return {
        "totals": report.graph_totals(index.nodes, index.edges, _status()),
        "nodes": graph.type_counts(index.nodes),
        "edges": graph.type_counts(index.edges),
        "hubs": graph.degree_top(index.edges, index.nodes, top),
    }


def callers(index: Index, symbols: DataFrame) -> DataFrame:
    """Production and test callers of symbols (id)."""
    into = index.edges.filter("type = 'CALLS'").join(symbols.select(F.col("id").alias("target")), "target", "left_semi")
    return into.join(index.nodes.select(F.col("id").alias("source"), "path"), "source").select("target", "source", is_test_path(F.col("path")).alias("test"))


def propose(index: Index, limit: int = 50) -> DataFrame:
    """Commented files no governing record covers: (path, headline, notes)."""
    said = index.facts.filter("fact = 'comment'").select("path", "line", F.col("kind").alias("tag"), F.col("message").alias("note"))
    bare = learnings(index)["uncovered"].select("path")
    return report.comments_by_file(said).join(bare, "path", "left_semi").orderBy("path").limit(limit)


def reflect(index: Index, summary: str, changed: DataFrame, limit: int = 3) -> dict[str, DataFrame]:
    """Symbols in changed files and earlier decisions about the like."""
    task = changed.agg(F.array_sort(F.collect_set("path")).alias("changed")).select(F.lit(0).alias("task_id"), F.lit(summary).alias("summary"), "changed")
    decisions = index.records.filter("type = 'decision'")
    symbols = index.nodes.filter("type = 'Symbol'").select("path", "label")
    return {"symbols": derive.changed_symbols(symbols, changed), "precedents": derive.precedents(decisions, task, limit)}


def neighbor_order(near: DataFrame) -> DataFrame:
    """Neighbours in the order of their types' priority, then id."""
    rank = F.coalesce(*[F.when(F.col("neighbor_type") == t, p) for t, p in TYPE_PRIORITY.items()], F.lit(10))
    return near.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(rank, "neighbor")))
