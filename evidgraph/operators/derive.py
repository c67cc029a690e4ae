"""Derived tables: coverage, communities, conflicts, validation, precedents,
sampling (A04-A10, A15-A17, J11-J23, O06, O07, U01-U05, V01-V11, G10)."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import evidence_path, normal_status, scope
from ..functions.text import signature
from .graph import closure, reaches_cycle
from .state import settle


def covered(files: DataFrame, edges: DataFrame, governing: DataFrame) -> DataFrame:
    """Files (id) with an incoming edge from a governing record (id)."""
    claims = edges.join(governing.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    return files.join(claims, "id", "left_semi")


def uncovered(files: DataFrame, edges: DataFrame, governing: DataFrame) -> DataFrame:
    """J11."""
    claims = edges.join(governing.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id"))
    return files.join(claims, "id", "left_anti")


def changed_only(files: DataFrame, changed: DataFrame) -> DataFrame:
    """J12."""
    return files.join(changed.select("path"), "path", "left_semi")


def snapshot_diff(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state) with state added, removed, changed or same,
    from two tables (path, hash). Pseudo-sources (@...) are left out. One full
    outer join answers all three."""
    old = indexed.filter(~F.col("path").startswith("@")).select("path", F.col("hash").alias("old"))
    new = current.select("path", F.col("hash").alias("new"))
    state = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(F.col("old") == F.col("new"), "same").otherwise("changed")
    )
    return old.join(new, "path", "full_outer").select("path", state.alias("state"))


def stale(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed paths that changed or went."""
    return snapshot_diff(indexed, current).filter(F.col("state").isin("changed", "removed")).select("path")


def changed_symbols(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(path, labels): indexed symbols of each changed file, in label order."""
    return symbols.join(changed.select("path"), "path", "left_semi").groupBy("path").agg(
        F.array_sort(F.collect_list("label")).alias("labels"))


def file_pair_weights(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(a, b, weight): edges between distinct files; placed is (id, path)."""
    s = placed.select(F.col("id").alias("source"), F.col("path").alias("ps"))
    t = placed.select(F.col("id").alias("target"), F.col("path").alias("pt"))
    both = edges.select("source", "target").join(s, "source").join(t, "target").filter("ps <> pt")
    return both.groupBy(F.least("ps", "pt").alias("a"), F.greatest("ps", "pt").alias("b")).agg(F.count(F.lit(1)).alias("weight"))


def scope_groups(files: DataFrame) -> DataFrame:
    """(scope, path)."""
    return files.select(scope(F.col("path")).alias("scope"), "path").distinct()


def merge_singletons(groups: DataFrame, weights: DataFrame) -> DataFrame:
    """G10's second pass: (path, scope) after singleton scopes, in order, joined
    the existing scope that they are most strongly connected to (ties to the
    larger name). Only scopes are looked at, on the aggregated scope graph; the
    pass depends on order and runs as one group over that small table."""
    import pandas as pd

    sized = groups.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only"))
    lone = sized.filter("n = 1")
    g = groups.select(F.col("path").alias("p"), F.col("scope").alias("other"))
    both = weights.select("a", "b", "weight").unionByName(weights.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    links = both.join(lone.select(F.col("only").alias("a"), "scope"), "a").join(g, F.col("b") == F.col("p")).filter("scope <> other")
    links = links.groupBy("scope", "other").agg(F.sum("weight").alias("weight"))
    table = sized.select(F.lit(0).alias("one"), "scope", F.lit(None).cast("string").alias("other"), F.col("n").alias("weight")).unionByName(
        links.select(F.lit(0).alias("one"), "scope", "other", "weight"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size = {r.scope: int(r.weight) for r in pdf[pdf.other.isna()].itertuples()}
        near: dict[str, list] = {}
        for r in pdf[pdf.other.notna()].itertuples():
            near.setdefault(r.scope, []).append((int(r.weight), r.other))
        moved = {}
        for s in sorted(size):
            if size.get(s) != 1:
                continue
            options = [x for x in near.get(s, []) if x[1] in size and x[1] != s]
            if options:
                to = max(options)[1]
                size[to] += size.pop(s)
                moved[s] = to
        out = []
        for s in [*size, *moved]:
            at = s
            while at in moved:
                at = moved[at]
            out.append((s, at))
        return pd.DataFrame(out, columns=["scope", "final"])

    final = table.groupBy("one").applyInPandas(run, "scope string, final string")
    return groups.join(final, "scope").select("path", F.col("final").alias("scope"))


def communities(files: DataFrame, edges: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, label, scope, members, files)."""
    groups = merge_singletons(scope_groups(files), file_pair_weights(edges, placed))
    return community_table(groups)


def community_table(groups: DataFrame) -> DataFrame:
    roots = groups.withColumn("root", F.substring_index("path", "/", 1)).groupBy("scope", "root").agg(F.count(F.lit(1)).alias("n"))
    label = roots.groupBy("scope").agg(F.min(F.struct((-F.col("n")).alias("m"), "root")).alias("b")).select("scope", F.col("b.root").alias("label"))
    members = groups.groupBy("scope").agg(F.array_sort(F.collect_set("path")).alias("members"))
    return members.join(label, "scope").select(
        F.concat(F.lit("community:"), signature(F.col("members"))).alias("id"), "label", "scope", "members", F.size("members").alias("files"))


def community_order(table: DataFrame) -> DataFrame:
    """Communities by size, the larger first, then by their first member."""
    return table.orderBy(F.desc("files"), F.element_at("members", 1))


def community_rollup(membership: DataFrame, placed: DataFrame, claims: DataFrame) -> DataFrame:
    """(community, files, symbols, records, status). membership is
    (path, community); placed is (id, path); claims is (record, file)."""
    nodes = placed.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    base = membership.join(nodes, "path", "left").groupBy("community").agg(
        F.count(F.lit(1)).alias("files"), F.greatest(F.sum(F.coalesce("n", F.lit(0)) - 1), F.lit(0)).alias("symbols"))
    linked = membership.join(claims.select(F.col("file").alias("path"), "record"), "path").groupBy("community").agg(F.countDistinct("record").alias("records"))
    return base.join(linked, "community", "left").select(
        "community", "files", "symbols", F.coalesce("records", F.lit(0)).cast("long").alias("records"),
        F.when(F.coalesce("records", F.lit(0)) > 0, "recorded").otherwise("missing").alias("status"))


def coverage_totals(rollup: DataFrame) -> DataFrame:
    """A09."""
    return rollup.agg(
        F.sum("files").alias("assigned"), F.count(F.lit(1)).alias("communities"),
        F.count_if(F.col("status") == "recorded").alias("with_records"), F.count_if(F.col("status") == "missing").alias("without_records"))


def cross_community(edges: DataFrame, placed: DataFrame, membership: DataFrame, limit: int = 200) -> DataFrame:
    """A10: edges whose ends lie in different communities, the first ``limit``."""
    home = placed.join(membership, "path").select("id", "community")
    s = home.select(F.col("id").alias("source"), F.col("community").alias("from_community"))
    t = home.select(F.col("id").alias("target"), F.col("community").alias("to_community"))
    found = edges.select("source", "target", "type").join(s, "source").join(t, "target").filter("from_community <> to_community")
    return found.orderBy("source", "target", "type").limit(limit)


def project_digest(sources: DataFrame) -> DataFrame:
    """The digest over the sorted path:hash lines. Lines are short (a path
    and a digest); this is one row over the manifest, as A11 defines it."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", "hash"))), lambda x: F.concat_ws(":", x["path"], x["hash"]))
    return sources.agg(F.sha2(F.array_join(lines, "\0").cast("binary"), 256).alias("digest"))


#: Sets of up to so many targets meet on all targets that they need to share.
_SHORT = 8
#: Members of a set are listed in rows of so many.
_LISTED = 512


def _alike(records: DataFrame, threshold: float) -> DataFrame:
    """(p, q, shared, overlap) of records (id, kind, targets and others): p and q
    are structs of the id and the others, in either order of ids.

    Records with equal targets are one set. Sets of n and m targets overlap
    enough with s = ceil((n + m) * threshold / (1 + threshold)) shared ones.
    Short sets meet on each choice of s targets, so whatever meets overlaps
    enough; a longer set meets others on one of its rarest
    n - ceil(threshold * n) + 1 targets, and the overlap is counted then. A pair
    is kept at the first choice of what it shares. Members travel with their
    sets: pairs are the result and are not exchanged.
    """
    spark = records.sparkSession
    others = [c for c in records.columns if c not in ("id", "kind", "targets")]
    one = records.select("kind", F.array_sort(F.array_distinct("targets")).alias("x"), F.struct("id", *others).alias("member")).filter(F.size("x") > 0)
    place = F.row_number().over(Window.partitionBy("kind", "x").orderBy("member.id"))
    listed = one.withColumn("block", F.floor((place - 1) / _LISTED))
    sets = settle(listed.groupBy("kind", "x", "block").agg(F.collect_list("member").alias("members")).withColumn("n", F.size("x")), "sets")
    sizes = sorted(r["n"] for r in sets.select("n").distinct().collect())
    if sizes and sizes[-1] > _SHORT:  # rarest first
        flat = sets.select("kind", "x", F.explode(F.array_distinct("x")).alias("t")).distinct()
        often = flat.groupBy("kind", "t").agg(F.count(F.lit(1)).alias("times"))
        order = flat.join(often, ["kind", "t"]).groupBy("kind", "x").agg(F.array_sort(F.collect_list(F.struct("times", "t"))).alias("o"))
        sets = settle(sets.join(order, ["kind", "x"]).withColumn("x", F.transform("o", lambda e: e["t"])).drop("o"), "sets")
    rows = []
    for n in (n for n in sizes if n <= _SHORT):
        for m in (m for m in sizes if m <= _SHORT and min(n, m) >= max(n, m) * threshold - 1e-9):
            need = max(math.ceil((n + m) * threshold / (1 + threshold) - 1e-9), 1)
            rows.append((n, min(n, m), max(n, m), need, [list(c) for c in itertools.combinations(range(n), need)]))
    plan = F.broadcast(spark.createDataFrame(rows, "n int, low int, high int, need int, choices array<array<int>>"))
    key = lambda chosen: F.xxhash64("kind", "low", "high", chosen)
    keys = F.array_distinct(F.transform("choices", lambda c: key(F.transform(c, lambda i: F.get("x", i)))))
    short = sets.join(plan, "n").select("kind", "x", "block", "members", "n", "low", "high", "need", F.explode(keys).alias("key"))
    found = _met(short.filter("n = low"), short.filter("n = high").select("kind", "low", "high", "key", "x", "block", "members"), ["key", "kind", "low", "high"]).filter(
        (F.size("both") >= F.col("need")) & (F.col("key") == key(F.slice("both", F.lit(1), F.col("need")))) & ((F.col("low") < F.col("high")) | F.col("first"))
    ).select("both", "x", "y", "same", "members", "members2")
    if sizes and sizes[-1] > _SHORT:
        prefix = F.slice("x", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
        rare = sets.select("kind", "x", "block", "members", "n", F.explode(prefix).alias("t"))
        long = _met(rare.filter(F.col("n") > _SHORT), rare.select("kind", "t", "x", "block", "members", F.col("n").alias("m")), ["kind", "t"]).filter(
            (F.col("t") == F.get("both", F.lit(0))) & ((F.col("m") <= _SHORT) | F.col("first")))
        found = found.unionByName(long.select("both", "x", "y", "same", "members", "members2"))
    shared = F.size("both").cast("long")
    found = found.select("same", "members", "members2", shared.alias("shared"), (shared / (F.size("x") + F.size("y") - shared)).alias("overlap"))
    pairs = found.filter(F.col("overlap") >= threshold).select("same", "shared", "overlap", "members2", F.explode("members").alias("p"))
    pairs = pairs.select("same", "shared", "overlap", "p", F.explode("members2").alias("q"))
    return pairs.filter(F.when(F.col("same"), F.col("p.id") < F.col("q.id")).otherwise(F.col("p.id") != F.col("q.id"))).select("p", "q", "shared", "overlap")


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of sets that meet, with ``both``, what they share; ``first``: that
    this is the one of the two orders of a pair to keep; ``same``: that a row met itself."""
    right = right.withColumnsRenamed({"x": "y", "block": "block2", "members": "members2"})
    same = F.col("x") == F.col("y")
    met = left.join(right, on).withColumn("both", F.array_intersect("x", "y"))
    met = met.withColumn("first", (F.col("x") < F.col("y")) | (same & (F.col("block") <= F.col("block2"))))
    return met.withColumn("same", same & (F.col("block") == F.col("block2")))


def jaccard_pairs(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, shared, overlap): pairs of equal ``kind`` whose distinct
    ``targets`` overlap by ``threshold``."""
    pairs = _alike(records.select("id", "kind", "targets"), threshold)
    return pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"), "shared", "overlap")


def conflicts(records: DataFrame) -> DataFrame:
    """(code, a, b, overlap): stable-stable pairs CONFLICT002,
    stable-draft pairs CONFLICT003, unless supersession links them either way.
    Statuses and the links between records alike are listed with the records, so
    that what is as large as the result is neither joined nor exchanged."""
    threshold = 0.5
    records = settle(records.select("id", F.lower("type").alias("kind"), "targets", normal_status(F.col("status")).alias("status"), "supersedes"), "records")
    usable = records.filter(F.col("kind").isin("decision", "constraint") & F.col("status").isin("stable", "draft")).drop("supersedes")
    linked = closure(records.select(F.col("id").alias("u"), F.explode("supersedes").alias("v")))
    linked = linked.select(F.least("u", "v").alias("id"), F.greatest("u", "v").alias("b")).distinct()
    end = usable.select(F.col("id").alias("b"), "kind", F.array_distinct("targets").alias("y"))
    near = linked.join(usable.select("id", "kind", F.array_distinct("targets").alias("x")), "id").join(end, ["b", "kind"])
    shared = F.size(F.array_intersect("x", "y"))
    near = near.filter(shared >= (F.size("x") + F.size("y") - shared) * threshold - 1e-9)
    usable = usable.join(near.groupBy("id").agg(F.collect_set("b").alias("linked")), "id", "left")
    pairs = _alike(usable.withColumn("stable", F.col("status") == "stable").drop("status"), threshold)
    ahead = F.col("p.id") < F.col("q.id")
    pairs = pairs.select(
        F.when(ahead, F.col("p.id")).otherwise(F.col("q.id")).alias("a"), F.when(ahead, F.col("q.id")).otherwise(F.col("p.id")).alias("b"), "overlap",
        F.when(ahead, F.col("p.linked")).otherwise(F.col("q.linked")).alias("linked"), F.col("p.stable").alias("sp"), F.col("q.stable").alias("sq"))
    pairs = pairs.filter((F.col("sp") | F.col("sq")) & ~F.coalesce(F.array_contains("linked", F.col("b")), F.lit(False)))
    code = F.when(F.col("sp") & F.col("sq"), "CONFLICT002").otherwise("CONFLICT003")
    return pairs.select(code.alias("code"), "a", "b", "overlap")


def duplicate_ids(records: DataFrame) -> DataFrame:
    """A15."""
    return records.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_titles(records: DataFrame) -> DataFrame:
    """Active constraints with the same title in any case: (title, ids)."""
    live = records.filter((F.lower("type") == "constraint") & (normal_status(F.col("status")) == "stable"))
    return live.groupBy(F.lower("title").alias("title")).agg(F.array_sort(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)


def broken_references(records: DataFrame, files: DataFrame) -> DataFrame:
    """(code, id, reference): targets that match no file or directory
    (LINK001), record references that match no record (LINK002), targets that
    lead out of the project (LINK003), which are not looked up."""
    from .resolve import ancestors

    known = files.select(F.explode(ancestors(F.col("path"))).alias("reference")).distinct()
    targets = records.select("id", F.explode("targets").alias("reference"))
    targets = targets.withColumn("reference", F.regexp_replace("reference", "/+$", ""))
    depth = F.aggregate(
        F.filter(F.split("reference", "/"), lambda p: ~p.isin("", ".")), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, p: F.struct(
            (acc["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"),
            F.least(acc["low"], acc["at"] + F.when(p == "..", -1).otherwise(1)).alias("low"),
        ),
    )
    leaves = F.startswith("reference", F.lit("/")) | (depth["low"] < 0)
    outside = targets.filter(leaves).select(F.lit("LINK003").alias("code"), "id", "reference")
    targets = targets.filter(~leaves)
    first = targets.join(known, "reference", "left_anti").select(F.lit("LINK001").alias("code"), "id", "reference")
    refs = records.select("id", F.explode(F.concat("constraints", "supersedes")).alias("reference"))
    ids = records.select(F.col("id").alias("reference")).distinct()
    return outside.unionByName(first).unionByName(refs.join(ids, "reference", "left_anti").select(F.lit("LINK002").alias("code"), "id", "reference"))


def validate(records: DataFrame, files: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """(code, severity, id, detail) of V01-V07."""
    def rows(df: DataFrame, code, severity: str, detail) -> DataFrame:
        return df.select((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"), F.col("id"), detail.cast("string").alias("detail"))

    found = rows(duplicate_ids(records), "REC002", "error", F.col("n"))
    found = found.unionByName(rows(broken_references(records, files), F.col("code"), "error", F.col("reference")))
    replaced = records.select(F.col("id").alias("u"), F.explode("supersedes").alias("v"))
    found = found.unionByName(rows(replaced.filter("u = v").select(F.col("u").alias("id")).distinct(), "LIFE001", "error", F.lit("supersedes itself")))
    cyclic = reaches_cycle(replaced).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("id")).filter("id <> ''")
    found = found.unionByName(rows(cyclic, "LIFE002", "error", F.lit("supersession cycle")))
    stable = records.withColumn("status", normal_status(F.col("status"))).filter("status = 'stable'")
    human = F.exists("verified", lambda v: v["by"].startswith("human:"))
    trusted = F.when(F.lower("type") == "architecture", F.size("verified") > 0).otherwise(human)
    found = found.unionByName(rows(stable.filter(~F.coalesce(trusted, F.lit(False))), "TRUST001", "warning", F.lit("no verifier")))
    named = stable.filter(F.size("targets") == 0).select("id", F.explode_outer(F.transform("evidence", lambda e: evidence_path(e["source"]))).alias("path"))
    proven = named.join(files.select("path"), "path", "left_semi").select("id")
    found = found.unionByName(rows(named.select("id").distinct().join(proven, "id", "left_anti"), "TRUST002", "warning", F.lit("no target and no evidence")))
    titles = duplicate_titles(records).select(F.array_join("ids", ",").alias("id"), "title")
    found = found.unionByName(rows(titles, "CONFLICT001", "warning", F.col("title")))
    clash = conflicts(records).select(F.concat_ws(",", "a", "b").alias("id"), "code", "overlap")
    found = found.unionByName(rows(clash, F.col("code"), "warning", F.round("overlap", 4)))
    if indexed is not None:
        moved = records.join(indexed.select("path", "hash"), "path").filter(F.col("source_hash") != F.col("hash"))
        found = found.unionByName(rows(moved, "STALE001", "warning", F.col("path")))
    return found


def precedents(decisions: DataFrame, tasks: DataFrame, top: int = 3) -> DataFrame:
    """(task_id, id, score, rank): reviewed decisions ranked for a task
    (task_id, summary, changed): 2 for each changed target, 1 for one above or
    below a change, 1 for each shared title token of three or more characters."""
    d = decisions.filter(normal_status(F.col("status")) != "draft")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{3,})"), F.lit(1)))
    from .resolve import ancestors

    claims = d.select("id", F.explode(F.array_distinct(F.transform("targets", lambda t: F.regexp_replace(t, "/+$", "")))).alias("t"))
    changes = tasks.select("task_id", F.explode(F.array_distinct("changed")).alias("c"))
    same = changes.join(claims, F.col("c") == F.col("t")).select("task_id", "id", "t", F.lit(2.0).alias("s"))
    above = changes.select("task_id", "c", F.explode(ancestors(F.col("c"))).alias("t")).filter("c <> t").join(claims, "t").select("task_id", "id", "t", F.lit(1.0).alias("s"))
    below = claims.select("id", "t", F.explode(ancestors(F.col("t"))).alias("c")).filter("c <> t").join(changes, "c").select("task_id", "id", "t", F.lit(1.0).alias("s"))
    target = same.unionByName(above).unionByName(below).groupBy("task_id", "id", "t").agg(F.max("s").alias("s")).groupBy("task_id", "id").agg(F.sum("s").alias("s"))
    asked = tasks.select("task_id", F.explode(words(F.col("summary"))).alias("w"))
    shared = d.select("id", F.explode(words(F.col("title"))).alias("w")).join(asked, "w").groupBy("task_id", "id").agg(F.count(F.lit(1)).cast("double").alias("s"))
    scored = target.unionByName(shared).groupBy("task_id", "id").agg(F.sum("s").alias("score"))
    order = Window.partitionBy("task_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def stratified(evidence: DataFrame, budget: int) -> DataFrame:
    """``budget`` rows of (kind, pos): every kind its share
    first, in kind order, then round-robin. Adds evd_id and n_total."""
    totals = evidence.agg(F.countDistinct("kind").alias("k"), F.count(F.lit(1)).alias("n_total"))  # one row
    ranked = evidence.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("pos"))).crossJoin(F.broadcast(totals))
    quota = F.greatest(F.floor(F.lit(budget) / F.col("k")), F.lit(1))
    picked = ranked.withColumn("late", F.col("rn") > quota)
    picked = picked.filter(F.col("rn") <= budget).orderBy("late", F.when(F.col("late"), F.col("rn")).otherwise(0), "kind", "rn").limit(budget)
    number = F.row_number().over(Window.orderBy("late", F.when(F.col("late"), F.col("rn")).otherwise(0), "kind", "rn"))
    return picked.withColumn("evd_id", F.format_string("EVD-%04d", number)).drop("k", "late", "rn")
