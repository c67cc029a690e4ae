"""Cross-file resolution as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Configuration keys too general to refer to.
GENERIC_KEYS = (
    "allowedhosts description enabled environment identifier location metadata name properties resourcegroup settings type value version"
).split()


def relative_module(current: Column, module: Column, level: Column, is_package: Column) -> Column:
    """The absolute module of an import with ``level`` leading dots. A
    package's own level counts from the package itself."""
    parts = F.split(current, "\\.")
    keep = F.size(parts) - level + F.when(is_package, 1).otherwise(0)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), ".")
    joined = F.when((base != "") & (module != ""), F.concat_ws(".", base, module)).otherwise(F.concat(base, module))
    return F.when(level == 0, module).otherwise(joined)


def strongest(edges: DataFrame, key: list[str]) -> DataFrame:
    """One row for each ``key``: the most confident one; on a tie the extracted
    one, then the least in the order of the other columns. Runs agree."""
    rest = [c for c in edges.columns if c not in key]
    first = [(-F.col("confidence")).alias("_confidence")] if "confidence" in rest else []
    if "provenance" in rest:
        first.append((F.col("provenance") != "EXTRACTED").alias("_guess"))
    best = edges.groupBy(*key).agg(F.min(F.struct(*first, *rest)).alias("x"))
    return best.select(*[F.col(c) if c in key else F.col(f"x.{c}").alias(c) for c in edges.columns])


def first_match(candidates: list[DataFrame], key: list[str]) -> DataFrame:
    """J03's coalescing: of ranked candidate tables (key, target, provenance,
    confidence) the row of the first that has one. One union and one
    aggregation, where a chain of left joins would shuffle for each."""
    ranked = None
    for rank, c in enumerate(candidates):
        part = c.select(*key, F.struct(F.lit(rank).alias("rank"), "target", "provenance", "confidence").alias("x"))
        ranked = part if ranked is None else ranked.unionByName(part)
    best = ranked.groupBy(*key).agg(F.min("x").alias("x"))
    return best.select(*key, "x.target", "x.provenance", "x.confidence")


def resolve_python(symbols: DataFrame, uses: DataFrame, imports: DataFrame, bindings: DataFrame) -> DataFrame:
    """Edges of Python projects.

    symbols: (id, rel, qualname, module); uses: (source, rel, qualname, use,
    target, receiver, line) with use in CALLS, INHERITS, REFERENCES; imports:
    (rel, alias, module, name); bindings: (rel, qualname, attribute, type_name):
    what a class's attributes are known to be. Output: (source, target, type,
    evidence, provenance, confidence), without self-edges, one row for each
    (source, target, type, evidence).
    """
    key = ["source", "rel", "use", "name", "line"]
    u = uses.withColumn("last", F.substring_index("target", ".", -1)).withColumn("head", F.substring_index("target", ".", 1))
    u = u.withColumnRenamed("target", "name").withColumn("owner", F.regexp_replace("qualname", r"(^|\.)[^.]+$", ""))
    s = symbols.select(F.col("id").alias("target"), F.col("rel").alias("srel"), F.col("qualname").alias("sq"), F.col("module").alias("smodule"))
    certain = (F.lit("EXTRACTED").alias("provenance"), F.lit(1.0).alias("confidence"))
    likely = (F.lit("INFERRED").alias("provenance"), F.lit(0.75).alias("confidence"))

    own = u.filter(F.col("name").startswith("self.") & (F.size(F.split("name", "\\.")) == 2)).join(
        s, (F.col("rel") == F.col("srel")) & (F.concat_ws(".", "owner", "last") == F.col("sq"))
    ).select(*key, "target", *certain)
    known = imports.select(F.col("rel").alias("irel"), F.col("alias"), F.col("module").alias("imodule"), F.col("name").alias("iname"))
    typed = u.filter(F.col("receiver").isNotNull())
    typed_local = typed.join(s, (F.col("rel") == F.col("srel")) & (F.concat_ws(".", "receiver", "last") == F.col("sq"))).select(*key, "target", *likely)
    typed_import = (
        typed.join(known, (F.col("rel") == F.col("irel")) & (F.col("receiver") == F.col("alias")))
        .join(s, (F.col("imodule") == F.col("smodule")) & (F.concat_ws(".", F.coalesce("iname", "receiver"), "last") == F.col("sq")))
        .select(*key, "target", *likely)
    )
    exact = u.join(s, (F.col("rel") == F.col("srel")) & (F.col("name") == F.col("sq"))).select(*key, "receiver", "target")
    tail = u.join(s.withColumn("slast", F.substring_index("sq", ".", -1)), (F.col("rel") == F.col("srel")) & (F.col("last") == F.col("slast"))).groupBy(
        *key, "receiver").agg(F.min(F.struct("sq", "target")).alias("b")).select(*key, "receiver", F.col("b.target").alias("target"))
    aliased = u.join(known, (F.col("rel") == F.col("irel")) & (F.col("head") == F.col("alias")))
    by_name = aliased.filter(F.col("iname").isNotNull()).join(
        s, (F.col("imodule") == F.col("smodule")) & (F.col("sq") == F.concat_ws(".", "iname", F.when(F.col("name") != F.col("head"), F.expr("substr(name, length(head) + 2)"))))
    ).select(*key, "receiver", "target")
    by_module = aliased.filter(F.col("iname").isNull()).join(
        s, (F.col("imodule") == F.col("smodule")) & (F.col("sq") == F.expr("substr(name, length(head) + 2)"))
    ).select(*key, "receiver", "target")

    # a call whose receiver type is known stays inferred even when a later rule resolves it
    def graded(df: DataFrame) -> DataFrame:
        guess = F.col("receiver").isNotNull() & (F.col("use") == "CALLS")
        return df.select(*key, "target", F.when(guess, "INFERRED").otherwise("EXTRACTED").alias("provenance"), F.when(guess, 0.75).otherwise(1.0).alias("confidence"))

    found = first_match([own, typed_local, typed_import, graded(exact), graded(tail), graded(by_name), graded(by_module)], key)
    soft = F.col("use") == "REFERENCES"
    edges = found.filter(F.col("source") != F.col("target")).select(
        "source", "target", F.col("use").alias("type"), F.concat_ws(":", "rel", "line").alias("evidence"),
        F.when(soft, "INFERRED").otherwise(F.col("provenance")).alias("provenance"),
        F.when(soft, 0.8).otherwise(F.col("confidence")).alias("confidence"),
    )
    modules = symbols.select(F.col("module").alias("imodule"), F.col("rel").alias("trel")).distinct()
    files = imports.select("rel", F.col("module").alias("imodule")).join(modules, "imodule").filter("rel <> trel").select(
        F.concat(F.lit("file:"), "rel").alias("source"), F.concat(F.lit("file:"), "trel").alias("target"), F.lit("IMPORTS").alias("type"),
        F.col("imodule").alias("evidence"), F.lit("EXTRACTED").alias("provenance"), F.lit(1.0).alias("confidence"),
    )
    return strongest(edges.unionByName(files), ["source", "target", "type", "evidence"])


def resolve_by_name(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """J05 + A22: (source, name, target, candidates, confidence, provenance).

    calls: (source, name, alias_stem); symbols: (id, label, stem). An alias
    stem that names the file settles it; else all symbols of that label but
    the caller itself (unless alone) compete: the smallest id is taken, 0.9 if
    unique, else 1/n.
    """
    unique = symbols.select("id", "label", "stem").distinct()
    labels = _label_summary(unique)
    at_stem = unique.groupBy(F.col("label").alias("name"), F.col("stem").alias("alias_stem")).agg(F.min("id").alias("target"))
    one = calls.select("source", "name", "alias_stem").distinct()
    settled = one.join(at_stem, ["name", "alias_stem"]).groupBy("source", "name").agg(F.min("target").alias("exact"))
    asked = one.select("source", "name").distinct().join(settled, ["source", "name"], "left").join(labels, "name")
    mine = unique.select(F.col("label").alias("name"), F.col("id").alias("source"), F.lit(True).alias("own")).distinct()
    asked = asked.join(mine, ["name", "source"], "left")
    left_out = F.col("own").isNotNull() & (F.col("n") > 1)
    rivals = (F.col("n") - left_out.cast("long")).alias("rivals")
    best = F.when(left_out & (F.col("least") == F.col("source")), F.col("second")).otherwise(F.col("least"))
    out = asked.select("source", "name", "exact", best.alias("best"), rivals)
    found = F.col("exact").isNotNull()
    return out.select(
        "source", "name", F.coalesce("exact", "best").alias("target"),
        F.when(found, F.lit(1).cast("long")).otherwise(F.col("rivals")).alias("candidates"),
        F.when(found, 1.0).when(F.col("rivals") == 1, 0.9).otherwise(F.round(1 / F.col("rivals"), 2)).alias("confidence"),
        F.when(found, "EXTRACTED").otherwise("INFERRED").alias("provenance"),
    )


def _label_summary(symbols: DataFrame) -> DataFrame:
    """(name, n, least, second): how many symbols have a label, and the two
    smallest ids, so that a caller can be left out without listing them."""
    ids = symbols.select(F.col("label").alias("name"), "id").distinct()
    least = ids.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    return least.join(
        ids.join(least.select("name", "least"), "name").filter("id > least").groupBy("name").agg(F.min("id").alias("second")), "name", "left")


def normal_key(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.substring_index(value, ".", -1)), "[^a-z0-9]", "")


def config_references(references: DataFrame, keys: DataFrame, max_targets: int = 5, min_length: int = 10) -> DataFrame:
    """(source, target, evidence, confidence): symbols that mention a
    distinctive configuration key. Keys with more than ``max_targets`` homes
    are dropped before the join, which also bounds its skew."""
    k = keys.select(F.col("id").alias("target"), normal_key(F.col("key_path")).alias("k")).distinct()
    k = k.filter((F.length("k") >= min_length) & ~F.col("k").isin(GENERIC_KEYS))
    rare = k.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_targets).select("k")
    used = references.select("source", F.col("target").alias("evidence"), normal_key(F.col("target")).alias("k"))
    found = used.join(k.join(rare, "k"), "k")
    return found.groupBy("source", "target").agg(F.min("evidence").alias("evidence")).withColumn("confidence", F.lit(0.65))


def tightest_enclosing(points: DataFrame, ranges: DataFrame, key: str = "rel") -> DataFrame:
    """Each point (key, point_id, at) with the id of the shortest range
    (key, id, start, stop) around it, the first by start on a tie; null if none.

    A range is the union of aligned blocks of 2^k places, two a level at most. A
    block keeps its best range and a place reads the one block a level that holds
    it, so work grows with ranges and places, not with the ranges around a place."""
    valid = ranges.filter(F.col("stop") >= F.col("start")).groupBy(key, "start", "stop").agg(F.min("id").alias("id"))
    top = F.floor(F.log2(F.col("stop") - F.col("start") + 1)).cast("int") + 1  # one more level than needed: log2 rounds
    low, high = F.expr("-shiftright(-CAST(start AS BIGINT), level)"), F.expr("shiftright(CAST(stop AS BIGINT) + 1, level)")  # whole blocks [low, high) inside
    levels = valid.select(key, "start", "stop", "id", F.explode(F.sequence(F.lit(0), top)).alias("level")).select(
        key, "start", "stop", "id", "level", low.alias("low"), high.alias("high")).filter("low < high")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    ends = F.filter(F.array(F.when(odd("low"), F.col("low")), F.when(odd("high"), F.col("high") - 1)), lambda x: x.isNotNull())
    best = F.min(F.struct((F.col("stop") - F.col("start")).alias("span"), "start", "id")).alias("b")
    blocks = levels.withColumn("block", F.explode(ends)).groupBy(key, "level", "block").agg(best)
    highest = valid.agg(F.max(top).alias("highest"))  # one row
    places = points.select(key, "at").distinct().crossJoin(F.broadcast(highest))
    asked = places.select(key, "at", F.explode(F.sequence(F.lit(0), "highest")).alias("level")).withColumn("block", F.expr("shiftright(CAST(at AS BIGINT), level)"))
    around = asked.join(blocks, [key, "level", "block"]).groupBy(key, "at").agg(F.min("b").alias("b"))
    return points.join(around, [key, "at"], "left").select(key, "point_id", "at", F.col("b.id").alias("enclosing"))


def ancestors(path: Column) -> Column:
    """The path and every directory above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def expand_targets(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(record, target, file): a file target is itself, a directory all
    files beneath, anything else the literal. Files list their ancestors, so
    the prefix test is an equi-join."""
    wanted = claims.select("record", F.regexp_replace("target", "/+$", "").alias("target"))
    tree = files.select(F.col("path").alias("file"), F.explode(ancestors(F.col("path"))).alias("target"))
    return wanted.join(tree, "target", "left").select("record", "target", F.coalesce("file", "target").alias("file"))


def record_edges(records: DataFrame, files: DataFrame) -> DataFrame:
    """J08 + J09: APPLIES_TO, CONSTRAINED_BY and SUPERSEDES edges of records."""
    claims = records.select(F.col("id").alias("record"), F.explode("targets").alias("target"))
    base = lambda t: (F.lit(t).alias("type"), F.lit("record").alias("origin"), F.lit("EXTRACTED").alias("provenance"), F.lit(1.0).alias("confidence"))
    applies = expand_targets(claims, files).select(
        F.col("record").alias("source"), F.concat(F.lit("file:"), "file").alias("target"), *base("APPLIES_TO"), F.col("target").alias("evidence"))
    refs = None
    for column, type_ in (("constraints", "CONSTRAINED_BY"), ("supersedes", "SUPERSEDES")):
        part = records.select(F.col("id").alias("source"), F.explode(column).alias("target"), *base(type_), F.lit(column).alias("evidence"))
        refs = part if refs is None else refs.unionByName(part)
    return strongest(applies.unionByName(refs), ["source", "target", "type", "evidence"])
