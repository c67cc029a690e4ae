"""The code-graph plans on small invented projects."""

from __future__ import annotations

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from evidgraph.operators import derive, graph
from evidgraph.plans import ask
from evidgraph.plans.index import Index, build
from evidgraph.sinks import export
from evidgraph.sources import evidence, files, records
from evidgraph.sources.files import Config
from evidgraph.streaming import watch

FILES = {
    "src/shop/base.py": "class Repository:\n    def load(self, key):\n        return self.fetch(key)\n\n    def fetch(self, key):\n        # WHY: callers expect a copy\n        return dict(key=key)\n",
    "src/shop/orders.py": (
        "from shop.base import Repository\nimport json\n\n\nclass OrderRepository(Repository):\n    def place(self, order):\n        self.check(order)\n"
        "        self.store.load(order)\n        return settings('payment_provider_key')\n\n    def __init__(self):\n        self.store = Repository()\n\n"
        "    def check(self, order):\n        return len(order)\n\n\ndef settings(name):\n    return json.loads(name)\n"),
    "src/shop/broken.py": "def oops(:\n",
    "config/app.json": json.dumps({"name": "x", "payment": {"payment_provider_key": 1, "list": [1, 2]}}),
    "web/api.ts": "import { send as post } from './client';\nexport class Api {\n  call() {\n    post(1);\n  }\n}\n",
    "web/client.ts": "export function send(x) {\n  // TODO: retry\n  return x;\n}\n",
    "node_modules/lib/index.js": "function hidden() {}\n",
    "tests/test_orders.py": "from shop.orders import OrderRepository\n\n\ndef test_place():\n    OrderRepository().place({})\n",
    "records/dec-1.md": "---\nid: DEC-1\ntype: decision\ntitle: Orders go through a repository\nstatus: accepted\ntargets: [src/shop/orders.py]\nconstraints: [CON-1]\nverified: {by: 'human:ada', at: 2024-01-01}\n---\n\n## Context\n\nOne place for storage.\n\n## Decision\n\nUse it.\n",
    "records/con-1.md": "---\nid: CON-1\ntype: constraint\ntitle: No direct storage\nstatus: stable\ntargets: [src/shop]\n---\nBody\n",
    "records/dec-2.md": "---\nid: DEC-2\ntype: decision\ntitle: Orders through a queue\nstatus: draft\ntargets: [src/shop/orders.py]\nsupersedes: [DEC-3]\n---\nText\n",
    "records/dec-3.md": "---\nid: DEC-3\ntype: decision\ntitle: Loop\nstatus: rejected\nsupersedes: [DEC-2]\ntargets: [gone.py]\n---\nText\n",
    "records/bad.md": "---\nid: '??'\ntype: decision\n---\n",
    "records/note.md": "just a note\n",
}


def _write(root, tree):
    for path, text in tree.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("project")
    _write(r, FILES)
    return str(r)


@pytest.fixture(scope="module")
def index(spark, root, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("snapshot"))
    build(spark, root).save(folder)
    return Index.load(spark, folder)


def _edges(index, *types):
    return {(r.source, r.target, r.type) for r in index.edges.filter(F.col("type").isin(*types)).collect()}


def test_symbols_and_resolution(index):
    ids = {r.id for r in index.nodes.collect()}
    assert {"file:src/shop/orders.py", "symbol:src/shop/orders.py:OrderRepository.place", "symbol:web/api.ts:Api.call", "config:config/app.json:payment.list[1]"} <= ids
    assert not any("node_modules" in i for i in ids)
    found = _edges(index, "CALLS", "INHERITS", "IMPORTS", "REFERENCES")
    place = "symbol:src/shop/orders.py:OrderRepository.place"
    assert ("symbol:src/shop/orders.py:OrderRepository", "symbol:src/shop/base.py:Repository", "INHERITS") in found
    assert (place, "symbol:src/shop/orders.py:OrderRepository.check", "CALLS") in found
    assert (place, "symbol:src/shop/base.py:Repository.load", "CALLS") in found  # by the attribute's type
    assert ("file:src/shop/orders.py", "file:src/shop/base.py", "IMPORTS") in found
    assert (place, "config:config/app.json:payment.payment_provider_key", "REFERENCES") in found
    typed = index.edges.filter((F.col("target") == "symbol:src/shop/base.py:Repository.load") & (F.col("type") == "CALLS")).head()
    assert (typed.provenance, typed.confidence) == ("INFERRED", 0.75)
    assert index.nodes.filter("id = 'module-ref:src/shop/orders.py:json'").count() == 1


def test_comments_records_and_diagnostics(index):
    notes = _edges(index, "ANNOTATES")
    assert ("rationale:src/shop/base.py:6", "symbol:src/shop/base.py:Repository.fetch", "ANNOTATES") in notes
    applies = _edges(index, "APPLIES_TO", "CONSTRAINED_BY", "SUPERSEDES")
    assert ("CON-1", "file:src/shop/base.py", "APPLIES_TO") in applies and ("DEC-1", "CON-1", "CONSTRAINED_BY") in applies
    codes = {r.code for r in index.diagnostics.collect()}
    assert {"PY001", "REC001"} <= codes
    communities = index.nodes.filter("type = 'Community'").count()
    assert communities >= 2


def test_validate(index):
    found = {(r.code, r.id) for r in ask.validate(index).collect()}
    assert ("LIFE002", "DEC-2,DEC-3") in found
    assert ("LINK001", "DEC-3") in found
    assert ("CONFLICT003", "DEC-1,DEC-2") in found
    assert ("TRUST001", "CON-1") in found and ("TRUST001", "DEC-1") not in found


def test_questions(spark, index):
    tasks = spark.createDataFrame([(1, "how are orders placed in the repository")], "query_id int, query string")
    packet = ask.context(index, tasks)
    rows = packet.collect()
    assert any(r.node == "DEC-1" and r.group == "governing" for r in rows)
    one = ask.compact(packet, index.nodes).head()
    assert "src/shop/orders.py" in one.files and one.records
    t = spark.createDataFrame([("src/shop/base.py",), ("OrderRepository.place",), ("base.py",), ("absent/file.py",)], "target string")
    how = {r.target: (r.id, r.how) for r in ask.resolve(index, t).collect()}
    assert how["src/shop/base.py"] == ("file:src/shop/base.py", "exact") and how["base.py"][1] == "suffix"
    assert how["OrderRepository.place"][0].endswith("OrderRepository.place") and how["absent/file.py"][1] == "missing"
    hit = {r.dependent for r in ask.impact(index, spark.createDataFrame([("file:src/shop/base.py",)], "id string")).collect()}
    assert "symbol:src/shop/orders.py:OrderRepository" in hit and not any("base.py" in h for h in hit)
    hops = ask.path(index, "DEC-1", "file:src/shop/base.py").collect()
    assert 1 <= len(hops) <= 3
    steps = ask.flow(index, spark.createDataFrame([("file:src/shop/orders.py",)], "id string")).orderBy("path").collect()
    assert [s.name for s in steps if s.depth == 0] == ["check", "load", "settings"]
    assert any(s.depth == 1 and s.name == "fetch" for s in steps)
    assert ask.overview(index)["totals"].head().accepted == 2
    assert {r.id for r in ask.learnings(index)["proposals"].collect()} == {"DEC-2"}
    found = ask.reflect(index, "orders repository", spark.createDataFrame([("src/shop/orders.py",)], "path string"))
    assert [r.id for r in found["precedents"].collect()] == ["DEC-1"]
    assert ask.directory(index, "src/shop").filter("id = 'CON-1'").count() == 1
    told = ask.explain(index, spark.createDataFrame([(1, "file:src/shop/orders.py")], "query_id int, id string")).collect()
    assert any(r.node == "DEC-1" and r.body for r in told)
    assert ask.callers(index, spark.createDataFrame([("symbol:src/shop/base.py:Repository.load",)], "id string")).count() == 1
    assert ask.propose(index).count() >= 1
    state = {r.check: r.ok for r in ask.doctor(index, index.sources.select("path", "hash")).collect()}
    assert state["nodes"] and state["fresh"] and not state["records valid"]


def test_exports(index, tmp_path):
    export.write_graphml(index.nodes, index.edges, f"{tmp_path}/g.graphml")
    import xml.etree.ElementTree as ET

    tree = ET.parse(f"{tmp_path}/g.graphml")
    assert len(tree.findall(".//{*}node")) == index.nodes.count()
    export.write_svg(index.nodes, index.edges, f"{tmp_path}/g.svg")
    ET.parse(f"{tmp_path}/g.svg")
    export.write_html_map(index.nodes, index.edges, f"{tmp_path}/g.html")
    export.write_vault(index.nodes, index.edges, f"{tmp_path}/vault")
    assert len(os.listdir(f"{tmp_path}/vault")) == index.nodes.count()
    assert "## totals" in export.report_markdown(ask.overview(index))
    assert json.loads(export.envelope(error="missing", code="IDX001"))["ok"] is False


def test_incremental(spark, root, tmp_path):
    copy = f"{tmp_path}/p"
    _write(copy, FILES)
    folder = f"{tmp_path}/snap"
    first = watch.refresh(spark, copy, folder)
    assert set(first) == {"added"}
    assert set(watch.refresh(spark, copy, folder)) == {"same"}
    os.remove(f"{copy}/web/client.ts")
    _write(copy, {"src/shop/base.py": FILES["src/shop/base.py"] + "\n\ndef extra():\n    pass\n", "src/shop/new.py": "x = 1\n"})
    states = watch.refresh(spark, copy, folder)
    assert (states["added"], states["removed"], states["changed"]) == (1, 1, 1)
    ids = {r.id for r in watch.latest(spark, folder).nodes.collect()}
    assert "symbol:src/shop/base.py:extra" in ids and "file:web/client.ts" not in ids
    again = build(spark, copy)
    assert {r.id for r in again.nodes.collect()} == ids  # incremental equals from scratch


def test_watch_stream(spark, root, tmp_path):
    q = watch.watch(spark, root, f"{tmp_path}/s", f"{tmp_path}/c")
    q.awaitTermination(120)
    assert watch.latest(spark, f"{tmp_path}/s").nodes.count() > 5


def test_globs_and_ignored():
    c = Config(exclude=["**/gen/**", "*.min.js"])
    assert files.selected("a/b.py", c) and not files.selected("gen/b.py", c) and not files.selected("x/a.min.js", c)
    assert files.ignored_name(".venv3") and files.ignored_name("Build") and not files.ignored_name("building")
    with pytest.raises(ValueError):
        Config(records_dir="../x")


def test_record_round_trip(spark):
    text = FILES["records/dec-2.md"]
    done = records.accept(text, "human:bo", "2024-02-02")
    r = records.parse("p.md", done)
    assert r[3] == "stable" and r[12] == [("human:bo", "2024-02-02")]
    df = spark.createDataFrame([("\n## One\n\ntext\n\n## Two\n\n<!-- hint -->\n",)], "b string")
    assert df.select(records.sections(F.col("b")).alias("s")).head().s == {"one": "text", "two": ""}


def test_evidence_and_git(spark, root, tmp_path):
    found = evidence.evidence(files.scan(spark, root, Config(), all_suffixes=True), 6)
    rows = found.collect()
    assert len(rows) == 6 and len({r.kind for r in rows}) >= 4
    copy = f"{tmp_path}/g"
    _write(copy, {"a.txt": "1"})
    run = lambda *a: subprocess.run(["git", "-C", copy, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init")
    run("add", ".")
    run("commit", "-m", "first: one")
    _write(copy, {"b.txt": "2"})
    assert [r.subject for r in evidence.git_log(spark, copy).collect()] == ["first: one"]
    assert [r.path for r in evidence.git_changes(spark, copy).collect()] == ["b.txt"]
    diff = spark.createDataFrame([("+++ b/x/y.py",), ("+++ /dev/null",), ("-a",)], "value string")
    assert [r.path for r in evidence.diff_paths(diff).collect()] == ["x/y.py"]


def test_ring_scale(spark):
    """A ring of modules: distances and hubs on a graph with a known shape."""
    n = 60
    edges = spark.createDataFrame([(f"m{i:03d}", f"m{(i + 1) % n:03d}", "CALLS") for i in range(n)], "source string, target string, type string")
    got = {r.node: r.distance for r in graph.bfs(edges, spark.createDataFrame([("m000",)], "id string"), 5).collect()}
    assert len(got) == 11 and got["m005"] == 5 and got["m055"] == 5
    assert graph.shortest_path(edges, "m000", "m003") == ["m000", "m001", "m002", "m003"]
    assert graph.shortest_path(edges, "m000", "m030") == []
    pairs = edges.select(F.col("source").alias("u"), F.col("target").alias("v"))
    assert graph.reaches_cycle(pairs).count() == n
    empty = spark.createDataFrame([], "source string, target string, type string")
    assert graph.bfs(empty, spark.createDataFrame([("x",)], "id string")).count() == 1


def test_singletons_join_strongest(spark):
    groups = spark.createDataFrame([("a/1", "a"), ("a/2", "a"), ("b/1", "b"), ("b/2", "b"), ("c/1", "c"), ("d/1", "d")], "path string, scope string")
    weights = spark.createDataFrame([("b/1", "c/1", 2), ("a/1", "c/1", 1)], "a string, b string, weight long")
    got = {r.path: r.scope for r in derive.merge_singletons(groups, weights).collect()}
    assert got["c/1"] == "b" and got["d/1"] == "d"


def test_traverse_large_hub(spark):
    """A hub with more equal neighbours than any fixed neighbourhood holds: records with late ids come first."""
    from evidgraph.operators import graph

    nodes = [("hub", "File", "hub", None)] + [(f"a{i:04d}", "Symbol", f"a{i:04d}", None) for i in range(1500)]
    nodes += [(f"z{i}", "Decision", f"z{9 - i}", None) for i in range(5)]
    edges = [("hub", n[0], "CONTAINS") for n in nodes[1:]]
    got = graph.traverse(
        spark.createDataFrame(edges, "source string, target string, type string"),
        spark.createDataFrame(nodes, "id string, type string, label string, data string"),
        spark.createDataFrame([(1, "hub")], "query_id int, id string"), max_items=8,
    ).collect()
    assert {r.node for r in got} == {"hub", "z0", "z1", "z2", "z3", "z4", "a0000", "a0001"}


def test_tokens_of_all_scripts(spark):
    from evidgraph.functions.text import tokens

    df = spark.createDataFrame([("Été señal Größe Ça_va x2", 1), ("e\u0301te\u0301 Привет 東京", 2), (None, 3)], "t string, i int")
    got = {r.i: r.w for r in df.select("i", tokens(F.col("t")).alias("w")).collect()}
    assert got == {1: ["ete", "senal", "große", "ca", "va", "x2"], 2: ["ete", "привет", "東京"], 3: None}


def test_literal_fallback(spark):
    from evidgraph.operators import search

    docs = spark.createDataFrame([("a", "C++ notes", "x"), ("b", "y", "uses c++ here"), ("c", "cpp", "")], "node_id string, label string, body string")
    asked = spark.createDataFrame([(1, "C++"), (2, "notes"), (3, " ")], "query_id int, query string")
    assert sorted(r.node_id for r in search.containing(docs, asked.withColumn("query", F.when(F.col("query") == "C++", "++").otherwise(F.col("query")))).collect()) == ["a", "b"]


def test_targets_outside_the_project(spark):
    rec = spark.createDataFrame([("D-1", ["src/../../etc", "/abs", "src/../src/a.py", "src"], [], [])],
                                "id string, targets array<string>, constraints array<string>, supersedes array<string>")
    known = spark.createDataFrame([("src/a.py",)], "path string")
    got = sorted((r.code, r.reference) for r in derive.broken_references(rec, known).collect())
    assert got == [("LINK001", "src/../src/a.py"), ("LINK003", "/abs"), ("LINK003", "src/../../etc")]


def test_strongest_edge_is_kept(spark):
    from evidgraph.operators.resolve import strongest

    rows = [("a", "b", "INFERRED", 0.75), ("a", "b", "EXTRACTED", 0.75), ("a", "b", "AMBIGUOUS", 0.5), ("a", "c", "INFERRED", 0.8)]
    df = spark.createDataFrame(rows, "source string, target string, provenance string, confidence double")
    got = sorted(tuple(r) for r in strongest(df, ["source", "target"]).collect())
    assert got == [("a", "b", "EXTRACTED", 0.75), ("a", "c", "INFERRED", 0.8)]


def test_resolution_leaves_the_caller_out(spark):
    from evidgraph.operators.resolve import resolve_by_name

    symbols = spark.createDataFrame([("s1", "f", "x"), ("s2", "f", "y"), ("s3", "f", "y"), ("s4", "g", "x")], "id string, label string, stem string")
    calls = spark.createDataFrame([("s1", "f", None), ("s9", "f", "y"), ("s4", "g", None), ("s2", "f", None), ("s8", "h", None)], "source string, name string, alias_stem string")
    got = {(r.source, r.name): (r.target, r.candidates, r.confidence, r.provenance) for r in resolve_by_name(calls, symbols).collect()}
    assert got == {
        ("s1", "f"): ("s2", 2, 0.5, "INFERRED"), ("s9", "f"): ("s2", 1, 1.0, "EXTRACTED"), ("s4", "g"): ("s4", 1, 0.9, "INFERRED"), ("s2", "f"): ("s1", 2, 0.5, "INFERRED")}


def test_overlap_of_hot_and_equal_targets(spark):
    rows = [(f"R{i:02d}", "d", ["hot"] + ([f"own{i}"] if i % 3 else [])) for i in range(12)] + [("Z", "other", ["hot"]), ("Y", "d", [])]
    df = spark.createDataFrame(rows, "id string, kind string, targets array<string>")
    want = set()
    for i, (a, ka, ta) in enumerate(rows):
        for b, kb, tb in rows[i + 1 :]:
            shared, union = len(set(ta) & set(tb)), len(set(ta) | set(tb))
            if ka == kb and union and shared / union >= 0.5:
                want.add((min(a, b), max(a, b), shared))
    assert {(r.a, r.b, r.shared) for r in derive.jaccard_pairs(df).collect()} == want


def test_traverse_against_brute_force(spark):
    """Walks over random graphs against a search of all simple orders by hand."""
    import random

    from evidgraph.schema import EDGE_WEIGHTS, TYPE_PRIORITY

    rng = random.Random(4)
    kinds, uses = list(TYPE_PRIORITY), list(EDGE_WEIGHTS)
    nodes = [(f"n{i:02d}", rng.choice(kinds), f"l{i % 7}") for i in range(30)]
    edges = list({(rng.choice(nodes)[0], rng.choice(nodes)[0], rng.choice(uses)) for _ in range(70)})
    df = graph.traverse(spark.createDataFrame(edges, "source string, target string, type string"), spark.createDataFrame(nodes, "id string, type string, label string"),
                        spark.createDataFrame([(q, f"n{q:02d}") for q in range(6)], "query_id int, id string"), 2, 8)
    got: dict = {}
    for r in df.collect():
        got.setdefault(r.query_id, {})[r.node] = (r.score, r.distance)
    info = {n: (TYPE_PRIORITY.get(t, 10), label) for n, t, label in nodes}
    for q in range(6):
        opened, settled, age = [(-1.0, 0, f"n{q:02d}", 0)], {}, 1
        while opened and len(settled) < 8:
            opened.sort()
            s, _, here, depth = opened.pop(0)
            if here in settled:
                continue
            settled[here] = (round(-s, 4), depth)
            if depth == 2:
                continue
            out = [(y, EDGE_WEIGHTS[t], EDGE_WEIGHTS[t], t) for x, y, t in edges if x == here] + [(x, EDGE_WEIGHTS[t] * graph.REVERSE_FACTOR, EDGE_WEIGHTS[t], t) for x, y, t in edges if y == here]
            for there, f, w, t in sorted(out, key=lambda e: (-e[2], *info[e[0]], e[0], e[3])):
                opened.append((s * f, age, there, depth + 1))
                age += 1
        assert got[q] == settled


def test_tools_answer_in_envelopes(spark, index, root, tmp_path):
    from evidgraph.plans import serve

    folder = str(tmp_path / "snap")
    index.save(folder)
    ask_ = lambda *a, **k: json.loads(serve.call(spark, *a, **k))
    found = ask_(folder, "context", {"task": "how are orders placed"}, root=root)
    assert found["ok"] and found["items"] and "stale_sources" not in found
    with open(f"{root}/src/shop/extra.py", "w") as f:
        f.write("x = 1\n")
    os.utime(f"{root}/src/shop/base.py")
    with open(f"{root}/src/shop/base.py", "a") as f:
        f.write("# changed\n")
    try:
        late = ask_(folder, "impact", {"target": "src/shop/base.py"}, root=root)
        assert late["stale_sources"] == ["src/shop/base.py"] and len(late["warnings"]) == 1 and late["dependents"]
    finally:
        os.remove(f"{root}/src/shop/extra.py")
        _write(root, {"src/shop/base.py": FILES["src/shop/base.py"]})
    assert ask_(folder, "path", {"source": "src/shop/orders.py", "target": "src/shop/base.py"})["hops"]
    assert ask_(str(tmp_path / "none"), "flow", {"target": "x"})["error"]["code"] == "IDX001"
    assert ask_(folder, "flow", {})["error"]["code"] == ask_(folder, "sing", {})["error"]["code"] == "ARG001"
    assert [json.loads(x)["ok"] for x in serve.serve(spark, folder, ["{", json.dumps({"tool": "explain", "arguments": {"target": "DEC-1"}})])] == [False, True]
    assert [t["name"] for t in serve.describe()] == ["context", "explain", "impact", "path", "flow"]
