"""Graph operators.

Iterative operators are driver loops over bounded levels. A level joins the
frontier with the adjacency and is written to the session's checkpoint folder,
so lineage stays short and a lost executor costs one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import path_like
from ..schema import DEGREE_EDGES, DEPENDENCY_EDGES, EDGE_WEIGHTS, GOVERNING_BOOST, REVERSE_FACTOR, TYPE_PRIORITY
from .state import settle


def edge_weight(type_: Column) -> Column:
    chain = None
    for name, w in EDGE_WEIGHTS.items():
        chain = F.when(type_ == name, F.lit(w)) if chain is None else chain.when(type_ == name, F.lit(w))
    return chain


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge: (here, there, type, forward)."""
    forward = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), "type", F.lit(True).alias("forward"))
    backward = edges.select(F.col("target").alias("here"), F.col("source").alias("there"), "type", F.lit(False).alias("forward"))
    return forward.unionByName(backward)


#: A frontier of up to so many nodes goes to the edges; a larger one is joined with them.
_FEW = 10_000


def _around(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """The adjacency of a settled frontier's nodes (node). A small frontier picks
    its edges where they are read, before anything of them is exchanged."""
    ids = frontier.select("node").distinct()
    if frontier.limit(_FEW + 1).count() > _FEW:
        return adjacency(edges).join(ids.withColumnRenamed("node", "here"), "here", "left_semi")
    own = lambda end: edges.join(F.broadcast(ids.withColumnRenamed("node", end)), end, "left_semi")
    forward = own("source").select(F.col("source").alias("here"), F.col("target").alias("there"), "type", F.lit(True).alias("forward"))
    return forward.unionByName(own("target").select(F.col("target").alias("here"), F.col("source").alias("there"), "type", F.lit(False).alias("forward")))


def neighbors(edges: DataFrame, nodes: DataFrame, of: DataFrame) -> DataFrame:
    """The neighbours of the nodes (id): (id, neighbor, neighbor_type, edge_type, forward)."""
    near = adjacency(edges).join(of.select(F.col("id").alias("here")), "here")
    return near.join(nodes.select(F.col("id").alias("there"), F.col("type").alias("neighbor_type")), "there").select(
        F.col("here").alias("id"), F.col("there").alias("neighbor"), "neighbor_type", F.col("type").alias("edge_type"), "forward"
    )


def type_counts(table: DataFrame) -> DataFrame:
    """A01."""
    return table.groupBy("type").agg(F.count(F.lit(1)).alias("count"))


def degree_top(edges: DataFrame, nodes: DataFrame, top: int = 10, types: tuple[str, ...] = ("File", "Symbol"), edge_types=DEGREE_EDGES) -> DataFrame:
    """Nodes by degree over dependency edges whose ends exist; ties by id.
    Degrees are counted before the nodes are joined, so hubs are one row."""
    live = keep_endpoints(edges.filter(F.col("type").isin(list(edge_types))), nodes)
    ends = live.select(F.explode(F.array("source", "target")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    kept = nodes.filter(F.col("type").isin(list(types))).select("id", "type", "label")
    return degree.join(kept, "id").orderBy(F.desc("degree"), "id").limit(top)


def keep_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def impact(edges: DataFrame, nodes: DataFrame, targets: DataFrame, dependency=DEPENDENCY_EDGES) -> DataFrame:
    """(target, dependent, dependent_type, edge_type, surface).

    The surface is the target, what a record target governs, and the symbols
    these contain. Dependents reach into the surface over dependency edges
    from another source path and lie outside it.
    """
    start = targets.select(F.col("id").alias("target"), F.col("id").alias("node"))
    governed = edges.filter(F.col("type").isin("APPLIES_TO", "IMPLEMENTS")).select(F.col("source").alias("node"), F.col("target").alias("to"))
    reached = start.unionByName(start.join(governed, "node").select("target", F.col("to").alias("node")))
    inside = edges.filter(F.col("type") == "CONTAINS").select(F.col("source").alias("node"), F.col("target").alias("to"))
    surface = reached.unionByName(reached.join(inside, "node").select("target", F.col("to").alias("node"))).distinct()
    place = nodes.select("id", "type", F.col("source_path").alias("place"))
    surface = surface.join(place.select(F.col("id").alias("node"), F.col("place").alias("surface_place")), "node")
    into = edges.filter(F.col("type").isin(list(dependency))).select(
        F.col("target").alias("node"), F.col("source").alias("dependent"), F.col("type").alias("edge_type")
    )
    found = surface.join(into, "node").join(
        place.select(F.col("id").alias("dependent"), F.col("type").alias("dependent_type"), "place"), "dependent"
    )
    found = found.filter(~F.col("place").eqNullSafe(F.col("surface_place")))
    own = surface.select("target", F.col("node").alias("dependent"))
    return found.join(own, ["target", "dependent"], "left_anti").select(
        "target", "dependent", "dependent_type", "edge_type", F.col("node").alias("surface")
    ).distinct()


def bfs(edges: DataFrame, starts: DataFrame, max_hops: int = 8) -> DataFrame:
    """(start, node, distance, parent): undirected shortest distances over all
    edge types up to ``max_hops``; of equal parents the smallest id. Each level
    joins only the frontier and drops what is settled."""
    settled = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"))
    settled = frontier = settle(settled, "bfs")
    for hop in range(1, max_hops + 1):
        step = (
            _reached(edges, frontier)
            .groupBy("start", F.col("there").alias("node")).agg(F.min("here").alias("parent"))
            .join(settled.select("start", "node"), ["start", "node"], "left_anti")
            .select("start", "node", F.lit(hop).alias("distance"), "parent")
        )
        frontier = settle(step, "bfs")
        if frontier.isEmpty():
            break
        settled = settled.unionByName(frontier)
    return settled


def _reached(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """(start, here, there): one step from a settled frontier (start, node)."""
    few = frontier.limit(_FEW + 1).count() <= _FEW
    at = frontier.select("start", F.col("node").alias("here"))
    near = _around(edges, frontier) if few else adjacency(edges)
    return near.select("here", "there").join(F.broadcast(at) if few else at, "here")


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int = 8) -> list[str]:
    """Node ids from source to target, or []; of equal paths the one with
    the least node before the target, then before that one, and so on.

    Both ends search, the one with the smaller frontier next, until a node is
    met by both. On the nodes that lie on a shortest path, the least parents
    then lead from the target back to the source."""
    if source == target:
        return [source]
    spark = edges.sparkSession
    seen, levels = [], []
    for end in (source, target):
        seen.append(spark.createDataFrame([(end,)], "node string"))
        levels.append([seen[-1]])
    sizes = [1, 1]
    for _ in range(max_hops):
        side = min((0, 1), key=lambda i: (sizes[i], len(levels[i])))
        at = levels[side][-1].select("node").distinct().withColumn("start", F.lit(side))
        step = _reached(edges, at).select(F.col("there").alias("node"), F.col("here").alias("link")).distinct()
        step = settle(step.join(seen[side], "node", "left_anti"), "path")
        sizes[side] = step.select("node").distinct().count()
        if not sizes[side]:
            return []
        levels[side].append(step)
        seen[side] = seen[side].unionByName(step.select("node").distinct())
        met = step.select("node").distinct().join(levels[1 - side][-1].select("node").distinct(), "node", "left_semi")
        if not met.isEmpty():
            return _walk_back(levels, met, target)
    return []


def _walk_back(levels: list[list[DataFrame]], met: DataFrame, target: str) -> list[str]:
    """The path from levels (node, link) of both ends: a link is one step nearer to its end."""
    ahead, on = [], met
    for level in reversed(levels[1][1:]):  # from the nodes met to the target
        on = settle(level.join(on, "node", "left_semi").select(F.col("link").alias("node"), F.col("node").alias("link")).distinct(), "path")
        ahead.append(on)
        on = on.select("node").distinct()
    path = [target]
    for level in [*reversed(ahead), *reversed(levels[0][1:])]:
        path.append(level.filter(F.col("node") == path[-1]).agg(F.min("link")).head()[0])
    return path[::-1]


def path_hops(edges: DataFrame, path: list[str]) -> DataFrame:
    """The edge behind each hop of a path: (hop, here, there, type, forward, provenance, confidence)."""
    spark = edges.sparkSession
    hops = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:], strict=False))], "hop int, here string, there string")
    both = adjacency(edges)
    extra = edges.select(
        F.col("source"), F.col("target"), "type",
        *[F.col(c) if c in edges.columns else F.lit(None).cast("string").alias(c) for c in ("provenance", "confidence", "evidence")],
    )
    joined = hops.join(both, ["here", "there"])
    ends = (F.col("source") == F.when(F.col("forward"), F.col("here")).otherwise(F.col("there"))) & (
        F.col("target") == F.when(F.col("forward"), F.col("there")).otherwise(F.col("here"))
    )
    detailed = joined.join(extra.withColumnRenamed("type", "t"), ends & (F.col("t") == F.col("type")))
    best = Window.partitionBy("hop").orderBy(F.desc("forward"), "type")
    return detailed.withColumn("r", F.row_number().over(best)).filter("r = 1").select(
        "hop", "here", "there", "type", "forward", "provenance", "confidence", "evidence"
    ).orderBy("hop")


def weighted_reach(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 2) -> DataFrame:
    """G01 in its join form: (query_id, node, strength, distance): the largest
    product of step weights over walks of at most ``max_depth`` edges, and the
    fewest edges that reach it. Seeds are (query_id, id). A node first reached
    strongly at full depth may still be passed through by a weaker, shorter
    walk; ``traverse`` settles that exactly."""
    weighted = edges.filter(F.col("type").isin(list(EDGE_WEIGHTS)))
    known = nodes.select(F.col("id").alias("node"))
    weight = edge_weight(F.col("type")) * F.when(F.col("forward"), F.lit(1.0)).otherwise(F.lit(REVERSE_FACTOR))
    level = seeds.select("query_id", F.col("id").alias("node"), F.lit(1.0).alias("strength"), F.lit(0).alias("distance")).distinct()
    found = level = settle(level, "reach")
    for hop in range(1, max_depth + 1):
        step = _around(weighted, level).select(F.col("here").alias("node"), "there", weight.alias("w"))
        level = settle(
            level.join(step, "node")
            .groupBy("query_id", F.col("there").alias("node"))
            .agg(F.max(F.col("strength") * F.col("w")).alias("strength"))
            .withColumn("distance", F.lit(hop)),
            "reach",
        )
        level = level.join(known, "node", "left_semi") if hop == max_depth else settle(level.join(known, "node", "left_semi"), "reach")
        found = found.unionByName(level)
    return found.groupBy("query_id", "node").agg(
        F.max("strength").alias("strength"), F.max_by("distance", F.struct("strength", -F.col("distance"))).alias("distance")
    )


def _priority(type_: Column) -> Column:
    chain = F.lit(10)
    for name, p in TYPE_PRIORITY.items():
        chain = F.when(type_ == name, F.lit(p)).otherwise(chain)
    return chain


def traverse(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, max_depth: int = 2, max_items: int = 20) -> DataFrame:
    """G01 exactly: best-first by strength, ``max_items`` nodes settled a query:
    (query_id, node, type, label, score, distance, via_type, via_source, via_target).

    Neighbours are visited by edge weight, type priority, label and id. A node
    passes its neighbours on in that order of strength, and those before a
    settled one are settled themselves, so no more than the first ``max_items``
    distinct neighbours of a node can be settled from it. Levels of these lists
    are all that the walk reads, at any size of hub; it runs as one group a query.
    """
    import pandas as pd

    known = nodes.select(F.col("id").alias("there"), F.coalesce("label", F.lit("")).alias("name"), _priority(F.col("type")).alias("p"))
    near = adjacency(edges.filter(F.col("type").isin(list(EDGE_WEIGHTS)))).withColumn("w", edge_weight(F.col("type")))
    near = near.withColumn("step", F.col("w") * F.when(F.col("forward"), F.lit(1.0)).otherwise(F.lit(REVERSE_FACTOR)))
    level = local = settle(seeds.select("query_id", F.col("id").alias("node")).distinct(), "local")
    inner = None
    for _ in range(max_depth):
        own = near.join(level.select(F.col("node").alias("here")).distinct(), "here").join(known, "there")
        best = F.min(F.struct((-F.col("step")).alias("s"), (-F.col("w")).alias("w"), "p", "name", "there", "type", "forward")).alias("b")
        order = Window.partitionBy("here").orderBy("b.s", "b.w", "b.p", "b.name", "there")
        first = own.groupBy("here", "there").agg(best).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max_items)
        first = first.select(F.col("here").alias("node"), "there", "b.type", "b.forward")
        step = settle(level.join(first, "node").select("query_id", F.col("node").alias("source"), F.col("there").alias("target"), "type", "forward"), "steps")
        inner = step if inner is None else inner.unionByName(step)
        level = settle(
            step.select("query_id", F.col("target").alias("node")).distinct().join(local, ["query_id", "node"], "left_anti"), "level"
        )
        local = local.unionByName(level)
    if inner is None:
        inner = local.limit(0).select("query_id", F.col("node").alias("source"), F.col("node").alias("target"), F.col("node").alias("type"), F.lit(True).alias("forward"))
    status = F.get_json_object("data", "$.status") if "data" in nodes.columns else F.lit(None).cast("string")
    info = nodes.select(F.col("id").alias("node"), "type", "label", status.alias("status"))
    rows = (
        inner.select("query_id", F.lit("edge").alias("what"), "source", "target", "type", F.when(F.col("forward"), "forward").otherwise("backward").alias("label"))
        .unionByName(
            local.join(info, "node").select(
                "query_id", F.lit("node").alias("what"), F.col("node").alias("source"), F.col("status").alias("target"), "type", "label"
            )
        )
        .unionByName(
            seeds.select("query_id", F.lit("seed").alias("what"), F.col("id").alias("source"), F.lit(None).cast("string").alias("target"),
                         F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("label"))
        )
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Label setting: one tentative label a node, the strongest so far and
        the earliest of equal ones; the best open label is made final at most
        ``max_items`` times, and only final labels short of the depth go on."""
        known = pdf[pdf.what == "node"].drop_duplicates("source").set_index("source")
        links = pdf[pdf.what == "edge"].copy()
        ahead = links.label == "forward"
        links["weight"] = links.type.map(EDGE_WEIGHTS)
        links["factor"] = links.weight.where(ahead, links.weight * REVERSE_FACTOR)
        links["tail"], links["head"] = links.source.where(ahead, links.target), links.target.where(ahead, links.source)
        links = links[links.target.isin(known.index)]
        links["turn"] = known.type.reindex(links.target).map(TYPE_PRIORITY).fillna(10).to_numpy()
        links["name"] = known.label.reindex(links.target).fillna("").to_numpy()
        links = links.sort_values(["source", "weight", "turn", "name", "target", "type"], ascending=[True, False, True, True, True, True])
        outgoing = dict(list(links.groupby("source")))

        starts = [s for s in sorted(set(pdf[pdf.what == "seed"].source)) if s in known.index]
        labels = {s: (1.0, -i, 0, None, None, None) for i, s in enumerate(starts)}  # strength, age, depth, via
        final: list[tuple] = []
        closed: set[str] = set()
        age = len(starts)
        for _ in range(max_items):
            if not labels:
                break
            here = max(labels, key=lambda k: labels[k][:2])
            strength, _, depth, *via = labels.pop(here)
            closed.add(here)
            final.append((here, strength, depth, *via))
            if depth == max_depth or here not in outgoing:
                continue
            for link in outgoing[here].itertuples():
                reach = strength * link.factor
                if link.target not in closed and (link.target not in labels or labels[link.target][0] < reach):
                    labels[link.target] = (reach, -age, depth + 1, link.type, link.tail, link.head)
                age += 1
        out = pd.DataFrame(final, columns=["node", "strength", "distance", "via_type", "via_source", "via_target"])
        out = out.join(known[["type", "label", "target"]], on="node")
        boost = out.target.isin(["stable", "accepted", "implemented"]).map({True: GOVERNING_BOOST, False: 1.0}).astype(float)
        out["score"] = [round(x, 4) for x in out.strength * boost]
        out["query_id"] = pdf.query_id.iloc[0]
        out["name"] = out.label.fillna("")
        out = out.sort_values(["score", "type", "name", "node"], ascending=[False, True, True, True])
        return out[["query_id", "node", "type", "label", "score", "distance", "via_type", "via_source", "via_target"]]

    kind = dict(seeds.dtypes)["query_id"]
    return rows.groupBy("query_id").applyInPandas(
        walk,
        f"query_id {kind}, node string, type string, label string, score double, distance int,"
        " via_type string, via_source string, via_target string",
    )


def closure(pairs: DataFrame) -> DataFrame:
    """All (u, v) with v reachable from u over one or more pairs (u, v).
    What a round added is joined with everything found, so the length of the
    walks covered doubles each round."""
    found = fresh = settle(pairs.select("u", "v").distinct(), "closure")
    while True:
        step = fresh.select("u", F.col("v").alias("w")).join(found.select(F.col("u").alias("w"), "v"), "w").select("u", "v").distinct()
        fresh = settle(step.join(found, ["u", "v"], "left_anti"), "closure")
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)


def reaches_cycle(pairs: DataFrame) -> DataFrame:
    """Ids that lie on a cycle or can reach one."""
    all_ = closure(pairs)
    on = all_.filter("u = v").select(F.col("u").alias("v"))
    return all_.join(on, "v", "left_semi").select(F.col("u").alias("id")).distinct()


def resolve_targets(nodes: DataFrame, targets: DataFrame, fuzzy: DataFrame | None = None) -> DataFrame:
    """(target, id, how): exact id or path, symbol label, path suffix; then
    the best search hit (target, node_id) unless the target looks like a path."""
    asked = targets.select("target").distinct()
    pathish = path_like(F.col("target"))
    by_id = asked.join(nodes, asked["target"] == nodes["id"]).select("target", "id", F.lit(0).alias("p"), F.lit("exact").alias("how"), F.lit(0).alias("n"))
    by_path = asked.join(nodes, asked["target"] == nodes["path"]).select(
        "target", "id", F.when(F.col("type") == "File", 1).otherwise(2).alias("p"), F.lit("exact").alias("how"), F.length("id").alias("n"))
    label = asked.join(nodes.filter("type = 'Symbol'"), F.lower(asked["target"]) == F.lower(nodes["label"])).select(
        "target", "id", F.lit(3).alias("p"), F.lit("exact").alias("how"), F.length("id").alias("n"))
    tails = nodes.filter("type = 'File'").select("id", F.explode(_suffixes(F.col("path"))).alias("tail"), F.length("path").alias("n"))
    suffix = asked.filter(pathish).join(tails, asked["target"] == tails["tail"]).select(
        "target", "id", F.lit(4).alias("p"), F.lit("suffix").alias("how"), "n")
    found = by_id.unionByName(by_path).unionByName(label).unionByName(suffix)
    if fuzzy is not None:
        guess = asked.filter(~pathish).join(fuzzy, "target").select(
            "target", F.col("node_id").alias("id"), F.lit(5).alias("p"), F.lit("fuzzy").alias("how"), F.lit(0).alias("n"))
        found = found.unionByName(guess)
    best = found.groupBy("target").agg(F.min(F.struct("p", "n", "id", "how")).alias("b"))
    return asked.join(best, "target", "left").select("target", "b.id", F.coalesce("b.how", F.lit("missing")).alias("how"))


def _suffixes(path: Column) -> Column:
    """Every tail of a path that starts after a separator."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def ordered_calls(calls: DataFrame, noise: list[str], max_steps: int = 15) -> DataFrame:
    """(symbol, step, name, line): first call of each name, in line order,
    without noise. ``calls`` is (symbol, target, line)."""
    named = calls.withColumn("name", F.substring_index("target", ".", -1)).filter((F.col("name") != "") & ~F.col("name").isin(noise))
    first = named.groupBy("symbol", "name").agg(F.min("line").alias("line"))
    order = Window.partitionBy("symbol").orderBy("line", "name")
    return first.withColumn("step", F.row_number().over(order)).filter(F.col("step") <= max_steps).select("symbol", "step", "name", "line")


def orchestrator(calls: DataFrame, noise: list[str]) -> DataFrame:
    """Per owner the member with most meaningful calls, dunders left out;
    ties to the smallest name. ``calls`` is (owner, symbol, target)."""
    last = F.substring_index("symbol", ".", -1)
    real = calls.filter(~last.rlike("^__.*__$"))
    counted = real.groupBy("owner", "symbol").agg(
        F.count_if(F.col("target").isNotNull() & ~F.substring_index("target", ".", -1).isin(noise)).alias("n")
    )
    best = counted.groupBy("owner").agg(F.min(F.struct((-F.col("n")).alias("m"), "symbol")).alias("b"))
    return best.select("owner", "b.symbol", (-F.col("b.m")).alias("n"))


def flow(calls: DataFrame, resolved: DataFrame, entries: DataFrame, noise: list[str], max_depth: int = 3, max_steps: int = 15) -> DataFrame:
    """(entry, depth, path, symbol, step, name, line, resolved): flat rows
    of the call skeleton. ``resolved`` is (symbol, name, target). A symbol is
    expanded once an entry, at its first place in depth, then path order."""
    steps = settle(ordered_calls(calls, noise, max_steps).join(resolved, ["symbol", "name"], "left"), "steps")
    start = entries.select(F.col("id").alias("entry"), F.col("id").alias("symbol"), F.lit("").alias("prefix"))
    frontier = settle(start, "flow")
    expanded = frontier.select("entry", "symbol")
    out = None
    for depth in range(max_depth + 1):
        rows = frontier.join(steps, "symbol").select(
            "entry", F.lit(depth).alias("depth"), F.concat("prefix", F.format_string("%03d", "step")).alias("path"),
            "symbol", "step", "name", "line", F.col("target").alias("resolved"),
        )
        rows = settle(rows, "flow")
        out = rows if out is None else out.unionByName(rows)
        following = rows.filter("resolved IS NOT NULL").groupBy("entry", F.col("resolved").alias("symbol")).agg(F.min("path").alias("prefix"))
        following = settle(
            following.join(expanded, ["entry", "symbol"], "left_anti").select("entry", "symbol", F.concat("prefix", F.lit(".")).alias("prefix")),
            "flow",
        )
        if following.isEmpty():
            break
        expanded = expanded.unionByName(following.select("entry", "symbol"))
        frontier = following
    return out


def bounded_view(nodes: DataFrame, max_nodes: int = 600) -> DataFrame:
    """Records first, then communities, then the rest; ties by id."""
    records = ("Decision", "Constraint", "Architecture", "Incident", "Glossary")
    rank = F.when(F.col("type").isin(*records), 0).when(F.col("type") == "Community", 1).otherwise(2)
    return nodes.withColumn("priority", rank).orderBy("priority", "id").limit(max_nodes)
