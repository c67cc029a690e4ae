"""The ingest plan: files to node, edge, document, source and diagnostic
tables, stored as one snapshot.

Extraction is incremental: facts are kept by path and content hash, and only
files whose (hash, version) is new are parsed. Everything that depends on more
than one file is derived anew from the facts each time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import module_name
from ..functions.text import searchable_text
from ..operators import derive, resolve
from ..operators.state import settle
from ..schema import INDEX_VERSION, SOURCES
from ..sources import code, comments, config_keys, files, records
from ..sources.files import Config

_EDGE = ("source", "target", "type", "origin", "evidence", "provenance", "confidence", "source_path")


@dataclass
class Index:
    """The tables of one snapshot."""

    nodes: DataFrame
    edges: DataFrame
    documents: DataFrame
    sources: DataFrame
    records: DataFrame
    facts: DataFrame
    diagnostics: DataFrame

    TABLES = ("nodes", "edges", "documents", "sources", "records", "facts", "diagnostics")

    def save(self, folder: str) -> None:
        """Each table below ``folder``; readers see a table only when its
        writer has committed. Write to a new folder for each snapshot."""
        for t in self.TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{folder}/{t}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        return cls(*[spark.read.parquet(f"{folder}/{t}") for t in cls.TABLES])


def _edges(df: DataFrame, type_: str | None = None, origin: str = "code", provenance: str = "EXTRACTED", confidence: float = 1.0) -> DataFrame:
    given = {"type": F.lit(type_), "origin": F.lit(origin), "provenance": F.lit(provenance), "confidence": F.lit(confidence),
             "evidence": F.lit(None).cast("string"), "source_path": F.lit(None).cast("string")}
    return df.select(*[(F.col(c) if c in df.columns else given[c]).alias(c) for c in _EDGE])


def _nodes(df: DataFrame) -> DataFrame:
    data = F.col("data") if "data" in df.columns else F.lit(None).cast("string")
    return df.select("id", "type", "label", "path", F.col("path").alias("source_path"), data.alias("data"))


def build(spark: SparkSession, root: str, config: Config | None = None, previous: Index | None = None) -> Index:
    config = config or Config()
    every = settle(files.scan(spark, root, config, all_suffixes=True), "scan")  # each file is read once
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    scanned = every.filter(suffix.isin(config.suffixes))
    in_records = F.col("path").startswith(config.records_dir.rstrip("/") + "/")
    docs = every.filter(in_records)
    scanned = scanned.filter(~in_records)
    sources = scanned.select("path", "hash", F.lit("code").alias("kind"), F.lit(INDEX_VERSION).alias("index_version")).unionByName(
        docs.filter(F.col("path").endswith(".md")).select("path", "hash", F.lit("record").alias("kind"), F.lit(INDEX_VERSION).alias("index_version")))

    fresh = scanned
    kept = None
    if previous is not None:
        same = sources.join(previous.sources.select("path", "hash", "index_version"), ["path", "hash", "index_version"], "left_semi").select("path")
        fresh = scanned.join(same, "path", "left_anti")
        kept = previous.facts.join(same, "path", "left_semi")
    facts = _facts(fresh)
    if kept is not None:
        facts = kept.unionByName(facts)
    facts = settle(facts, "facts")
    scanned = settle(scanned.select("path", "hash"), "sources")
    recs, bad = records.records(docs)
    recs, bad = settle(recs, "records"), settle(bad, "record-errors")
    code_nodes, code_edges = _code_graph(scanned, facts, config)
    config_nodes, config_edges = _config_graph(facts)
    why_nodes, why_edges = _rationale(facts)
    record_nodes = _nodes(recs.select(
        "id", F.initcap("type").alias("type"), F.col("title").alias("label"), "path",
        F.to_json(F.struct("status", "date", "targets", "constraints", "supersedes", "confidence", "evidence", "open_questions", "generated", "verified")).alias("data")))
    file_paths = scanned.select("path")
    record_edges = _edges(resolve.record_edges(recs, file_paths), origin="record")
    references = facts.filter("fact = 'reference'").select(F.concat(F.lit("symbol:"), "path", F.lit(":"), "qualname").alias("source"), "target")
    keys = config_nodes.select("id", F.regexp_extract("id", r"^config:[^:]*:(.*)$", 1).alias("key_path"))
    config_refs = _edges(resolve.config_references(references, keys), "REFERENCES", "config", "INFERRED", 0.65)
    nodes = settle(code_nodes.unionByName(config_nodes).unionByName(why_nodes).unionByName(record_nodes), "nodes")
    edges = code_edges.unionByName(config_edges).unionByName(why_edges).unionByName(record_edges).unionByName(config_refs)
    edges = settle(edges, "edges")
    placed = nodes.filter("type IN ('File', 'Symbol', 'ConfigKey')").select("id", "path")
    community = settle(derive.communities(file_paths, edges, placed), "communities")
    members = community.select("id", F.explode("members").alias("path"))
    nodes = nodes.unionByName(_nodes(community.select("id", F.lit("Community").alias("type"), "label", F.lit("@communities").alias("path"),
                                                      F.to_json(F.struct("files", "scope")).alias("data"))))
    edges = edges.unionByName(_edges(members.select(F.concat(F.lit("file:"), "path").alias("source"), F.col("id").alias("target"), F.col("id").alias("evidence")),
                                     "MEMBER_OF", "structural-community", "INFERRED", 0.8))
    edges = resolve.strongest(edges, ["source", "target", "type", "evidence"])
    body = recs.select("id", "body")
    documents = nodes.join(body, "id", "left").select(
        F.col("id").alias("node_id"), searchable_text(F.col("label")).alias("label"),
        F.coalesce("body", searchable_text(F.coalesce(F.get_json_object("data", "$.note"), F.get_json_object("data", "$.module"), F.lit("")))).alias("body"), "path")
    found = facts.filter("fact = 'diagnostic'").select(F.col("kind").alias("code"), F.lit("warning").alias("severity"), "message", "path")
    unread = every.filter(~in_records & ~suffix.isin(config.suffixes)).select(
        F.lit("LANG001").alias("code"), F.lit("warning").alias("severity"), F.concat(F.lit("no extractor for "), suffix).alias("message"), "path")
    diagnostics = bad.unionByName(found).unionByName(unread)
    return Index(nodes, edges, documents, sources, recs, facts, diagnostics)


def _facts(fresh: DataFrame) -> DataFrame:
    """Everything that one file says by itself, in one typed table."""
    facts = code.code_facts(fresh)
    configs = config_keys.config_keys(fresh.filter(F.col("path").rlike(r"\.(json|ya?ml)$")).select("path", "content"))
    keys = configs.select(
        "path", F.when(F.col("code").isNull(), "config").otherwise("diagnostic").alias("fact"), F.col("key_path").alias("qualname"),
        F.coalesce("code", "value_type").alias("kind"), "message")
    said = comments.tagged_lines(fresh.filter(~F.col("path").rlike(r"\.(json|md)$")).select("path", "content")).select(
        "path", F.lit("comment").alias("fact"), F.col("tag").alias("kind"), F.col("line").cast("int").alias("line"), F.col("note").alias("message"))
    return facts.unionByName(keys, allowMissingColumns=True).unionByName(said, allowMissingColumns=True)


def _code_graph(scanned: DataFrame, facts: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    sid = F.concat(F.lit("symbol:"), "path", F.lit(":"), "qualname")
    fid = F.concat(F.lit("file:"), "path")
    module = module_name(F.col("path"), config.source_roots)
    symbols = facts.filter("fact = 'symbol'").select(sid.alias("id"), "path", "qualname", "kind", "line", "end_line", module.alias("module"))
    symbols = settle(resolve.strongest(symbols, ["id"]), "symbols")
    calls = facts.filter("fact = 'call'").groupBy(sid.alias("id")).agg(F.array_sort(F.collect_list(F.struct("line", "target"))).alias("calls"))
    file_nodes = _nodes(scanned.select(fid.alias("id"), F.lit("File").alias("type"), F.substring_index("path", "/", -1).alias("label"), "path",
                                       F.to_json(F.struct(module.alias("module"))).alias("data")))
    symbol_nodes = _nodes(symbols.join(calls, "id", "left").select(
        "id", F.lit("Symbol").alias("type"), F.col("qualname").alias("label"), "path", F.to_json(F.struct("kind", "line", "end_line", "module", "calls")).alias("data")))
    owner = F.regexp_replace("qualname", r"(^|\.)[^.]+$", "")
    contains = _edges(symbols.select(
        F.when(owner == "", fid).otherwise(F.concat(F.lit("symbol:"), "path", F.lit(":"), owner)).alias("source"), F.col("id").alias("target"), F.col("path").alias("evidence")), "CONTAINS")

    python = F.col("path").endswith(".py")
    imports = facts.filter(F.col("fact").eqNullSafe("import"))
    py_imports = imports.filter(python).select(
        F.col("path").alias("rel"), "alias", "name",
        resolve.relative_module(module, F.col("target"), F.col("level"), F.col("path").endswith("__init__.py")).alias("module"))
    # 'from package import module' names a module, not a symbol of one
    modules = symbols.select("module").union(scanned.filter(python).select(module)).distinct().withColumnRenamed("module", "full")
    split = py_imports.withColumn("full", F.concat_ws(".", "module", "name")).join(modules, "full", "left_semi")
    whole = split.select("rel", "alias", F.lit(None).cast("string").alias("name"), F.col("full").alias("module"))
    py_imports = py_imports.join(split.select("rel", "alias"), ["rel", "alias"], "left_anti").select("rel", "alias", "name", "module").unionByName(whole)
    known = symbols.select("id", F.col("path").alias("rel"), "qualname", "module")
    use = F.when(F.col("fact") == "call", "CALLS").when(F.col("fact") == "base", "INHERITS").when(F.col("fact") == "reference", "REFERENCES")
    uses = facts.filter(python & F.col("fact").isin("call", "base", "reference")).select(
        sid.alias("source"), F.col("path").alias("rel"), "qualname", use.alias("use"), "target", "receiver", "line")
    resolved = resolve.resolve_python(known, uses, py_imports, known)
    external = imports.filter(python).select("path", F.col("target").alias("m")).distinct()
    external = external.join(modules, F.col("m") == F.col("full"), "left_anti")
    module_id = F.concat(F.lit("module-ref:"), "path", F.lit(":"), "m")
    module_nodes = _nodes(external.select(module_id.alias("id"), F.lit("Module").alias("type"), F.col("m").alias("label"), "path", F.to_json(F.struct(F.lit(True).alias("external"))).alias("data")))
    module_edges = _edges(external.select(fid.alias("source"), module_id.alias("target"), F.col("m").alias("evidence")), "IMPORTS")

    from ..functions.predicates import relative_stem

    stems = F.regexp_replace("path", r"\.[^./]+$", "")
    alias = imports.filter(~python).select("path", F.col("alias").alias("head"), relative_stem(F.col("target"), F.col("path")).alias("alias_stem"))
    other = facts.filter(~python & F.col("fact").isin("call", "base")).select(sid.alias("source"), "path", use.alias("use"), F.substring_index("target", ".", 1).alias("head"), F.substring_index("target", ".", -1).alias("name"))
    named = other.join(alias, ["path", "head"], "left")
    labels = symbols.filter(~F.col("path").endswith(".py")).select("id", F.substring_index("qualname", ".", -1).alias("label"), stems.alias("stem"))
    by_name = None
    for kind in ("CALLS", "INHERITS"):
        part = resolve.resolve_by_name(named.filter(F.col("use") == kind).select("source", "name", "alias_stem").distinct(), labels)
        part = _edges(part.select("source", "target", F.lit(kind).alias("type"), F.col("name").alias("evidence"), "provenance", "confidence"))
        by_name = part if by_name is None else by_name.unionByName(part)
    edges = contains.unionByName(_edges(resolved)).unionByName(module_edges).unionByName(by_name)
    return file_nodes.unionByName(symbol_nodes).unionByName(module_nodes), edges


def _config_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = facts.filter("fact = 'config'").select("path", "qualname", "kind", F.concat(F.lit("config:"), "path", F.lit(":"), "qualname").alias("id"))
    nodes = _nodes(keys.select("id", F.lit("ConfigKey").alias("type"), F.col("qualname").alias("label"), "path", F.to_json(F.struct(F.col("kind").alias("value_type"))).alias("data")))
    parent = F.regexp_replace("qualname", r"(\.[^.\[\]]+|\[\d+\])$", "")
    up = F.when(parent == F.col("qualname"), F.concat(F.lit("file:"), "path")).otherwise(F.concat(F.lit("config:"), "path", F.lit(":"), parent))
    return nodes, _edges(keys.select(up.alias("source"), F.col("id").alias("target"), F.col("qualname").alias("evidence")), "CONTAINS", "config")


def _rationale(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    said = facts.filter("fact = 'comment'").select(
        F.col("path").alias("rel"), F.concat(F.lit("rationale:"), "path", F.lit(":"), "line").alias("point_id"), F.col("line").alias("at"), F.col("kind").alias("tag"), F.col("message").alias("note"))
    said = said.dropDuplicates(["point_id"])
    ranges = facts.filter("fact = 'symbol'").select(
        F.col("path").alias("rel"), F.concat(F.lit("symbol:"), "path", F.lit(":"), "qualname").alias("id"), F.col("line").alias("start"), F.col("end_line").alias("stop"))
    home = resolve.tightest_enclosing(said.select("rel", "point_id", "at"), ranges)
    nodes = _nodes(said.select(F.col("point_id").alias("id"), F.lit("Rationale").alias("type"), F.concat("tag", F.lit(": "), F.substring("note", 1, 80)).alias("label"),
                               F.col("rel").alias("path"), F.to_json(F.struct("tag", "note", F.col("at").alias("line"))).alias("data")))
    target = F.coalesce("enclosing", F.concat(F.lit("file:"), "rel"))
    return nodes, _edges(home.select(F.col("point_id").alias("source"), target.alias("target"), F.col("at").cast("string").alias("evidence")), "ANNOTATES", "comment")


def empty_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SOURCES)
