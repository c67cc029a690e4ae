"""Operators against brute force where work must not grow with the square of a group."""

from __future__ import annotations

import random

from evidgraph.operators import derive, graph, resolve, search


def _children(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [plan.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [plan.plan()]
    return [plan.children().apply(i) for i in range(plan.children().size())]


def joined_rows(df) -> int:
    """The rows that the joins of a collected table made."""
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if "Join" in plan.nodeName():
            total += plan.metrics().apply("numOutputRows").value()
        todo += _children(plan)
    return total


def test_tightest_range_around_each_place(spark):
    rnd = random.Random(5)
    ranges = [(rnd.choice("ab"), i, s := rnd.randint(-300, 300), s + rnd.choice([-2, 0, 1, 5, 63, 64, 400])) for i in range(400)]
    ranges += [("a", 900, -5000, 70000), ("b", 901, 10, 10), ("b", 899, 10, 10)]
    points = [(rnd.choice("abc"), i % 300, rnd.randint(-400, 800)) for i in range(500)] + [("b", 7, 10), ("a", 8, None), (None, 9, 1)]
    df = resolve.tightest_enclosing(
        spark.createDataFrame(points, "rel string, point_id long, at long"), spark.createDataFrame(ranges, "rel string, id long, start long, stop long"))
    got = df.collect()
    want = []
    for rel, pid, at in points:
        around = [(e - s, s, i) for r, i, s, e in ranges if r == rel and at is not None and s <= at <= e]
        want.append((rel, pid, at, min(around)[2] if around else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_ranges_around_one_place_are_not_listed(spark):
    points = spark.range(2000).selectExpr("'a' AS rel", "id AS point_id", "500 + id % 50 AS at")
    ranges = spark.range(2000).selectExpr("'a' AS rel", "id", "id % 400 AS start", "600 + id % 400 AS stop")
    df = resolve.tightest_enclosing(points, ranges)
    assert {r.enclosing for r in df.collect()} == {0}  # all spans are 600; the first start, then the least id
    assert joined_rows(df) < 50_000


def test_overlapping_targets_against_brute_force(spark):
    """Short and long sets, hot targets and more equal sets than one row lists."""
    rnd = random.Random(3)
    rows = [(f"R{i:04d}", rnd.choice("de"), rnd.sample([f"t{k}" for k in range(14)], rnd.choice([0, 1, 2, 3, 5, 8, 9, 12]))) for i in range(220)]
    rows += [(f"S{i:04d}", "f", ["one"]) for i in range(1100)] + [("T1", "f", ["one", "two"]), ("T2", "f", ["one", "two", "three"]), ("T3", "f", ["two", "one", "one"])]
    want = set()
    for i, (a, ka, ta) in enumerate(rows):
        for b, kb, tb in rows[i + 1 :]:
            if ka == kb and (union := set(ta) | set(tb)) and len(set(ta) & set(tb)) / len(union) >= 0.5:
                want.add((min(a, b), max(a, b), len(set(ta) & set(tb))))
    df = derive.jaccard_pairs(spark.createDataFrame(rows, "id string, kind string, targets array<string>"))
    got = [(r.a, r.b, r.shared) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_pairs_are_made_from_few_joined_rows(spark):
    rows = [(f"R{i:05d}", "decision", "x", "stable", ["t"], [f"R{i - 1:05d}"] if i % 8 else []) for i in range(900)]
    df = derive.conflicts(spark.createDataFrame(rows, "id string, type string, title string, status string, targets array<string>, supersedes array<string>"))
    assert len(df.collect()) == 900 * 899 // 2 - 112 * 28 - 6  # all but those in a chain of eight, and of four at the end
    assert joined_rows(df) < 5000


def _settled(monkeypatch, kept):
    real = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name: kept.append(real(df, name)) or kept[-1])


def test_shortest_path_by_brute_force(spark):
    rnd = random.Random(9)
    pairs = [(f"n{rnd.randrange(40):02d}", f"n{rnd.randrange(40):02d}") for _ in range(55)]
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "source string, target string, type string").coalesce(1)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def brute(source, target):
        at, level = {source: 0}, {source}
        while level:
            level = {y for x in level for y in near.get(x, ())} - set(at)
            at |= {x: max(at.values()) + 1 for x in level}
        if target not in at or at[target] > 8:
            return []
        path = [target]
        while path[-1] != source:
            path.append(min(x for x in near[path[-1]] if at.get(x) == at[path[-1]] - 1))
        return path[::-1]

    for a, b in (("n00", "n39"), ("n05", "n31"), ("n12", "n07")):
        assert graph.shortest_path(edges, a, b) == brute(a, b)


def test_shortest_path_does_not_write_the_graph(spark, monkeypatch):
    kept = []
    _settled(monkeypatch, kept)
    edges = spark.sql("SELECT 'a' AS source, 'm' AS target, 'CALLS' AS type UNION ALL SELECT 'b', 'm', 'CALLS' UNION ALL SELECT 'm', concat('x', id), 'CALLS' FROM range(3000)")
    assert graph.shortest_path(edges, "a", "b") == ["a", "m", "b"]
    assert sum(x.count() for x in kept) < 100


def test_reach_writes_no_more_than_it_reaches(spark, monkeypatch):
    kept = []
    _settled(monkeypatch, kept)
    edges = spark.range(3000).selectExpr("concat('a', id) AS source", "concat('a', id + 1) AS target", "'CALLS' AS type")
    nodes = spark.range(3000).filter("id <> 8").selectExpr("concat('a', id) AS id", "'Symbol' AS type")
    got = graph.weighted_reach(edges, nodes, spark.createDataFrame([(1, "a7")], "query_id int, id string"), 2)
    assert {(r.node, round(r.strength, 6)) for r in got.collect()} == {("a7", 1.0), ("a6", 0.765), ("a5", 0.585225), ("a7", 1.0)}
    assert sum(x.count() for x in kept) < 50


def test_search_takes_its_edges_before_they_are_exchanged(spark, monkeypatch):
    plans, real = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, name))
    edges = spark.range(3000).selectExpr("concat('a', id) AS source", "concat('a', id + 1) AS target", "'CALLS' AS type").distinct()
    got = graph.bfs(edges, spark.createDataFrame([("a7",)], "id string"), 2)
    assert {(r.node, r.distance) for r in got.collect()} == {("a7", 0), ("a6", 1), ("a8", 1), ("a5", 2), ("a9", 2)}
    for p in plans[1:]:
        assert p.index("Aggregate [source") < p.index("Join LeftSemi, (source")


def test_search_deals_documents_to_more_tasks_as_they_grow(spark, monkeypatch):
    monkeypatch.setattr(search, "_HELD", 5)
    rows = [(f"d{i}", "label", f"apple number{i}", "p/q") for i in range(60)]
    docs = spark.createDataFrame(rows, "node_id string, label string, body string, path string")
    assert search.postings(docs).rdd.getNumPartitions() == 13
    found = search.flat_overlap(docs, spark.createDataFrame([(1, "apple number7")], "query_id int, query string"))
    assert [(r.node_id, r.score) for r in found.orderBy("rank").limit(2).collect()] == [("d7", 2), ("d0", 1)]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
