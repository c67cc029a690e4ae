"""Evidence for a first look at a project, and changes."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import file_kinds
from ..functions.text import one_line
from ..operators.derive import stratified

# Words that mark a comment as a reason.
REASON = r"(?i)\b(because|decision|intent|must|reason|trade-?off|why|workaround)\b"
_COMMENT = r"^\s*(?:#|//|/\*|\*|<!--)\s*(.+?)(?:\s*-->|\s*\*/)?\s*$"
SUMMARIES = {
    "test": "A test: what it asserts says how the code is meant to behave.",
    "dependency": "Lists the libraries and versions that the project needs.",
    "configuration": "Settings or automation: the values in force are here.",
    "source": "Source code: its symbols and links are in the graph.",
}


def summary(kind: Column, path: Column, content: Column) -> Column:
    """The first four headings of documentation, fixed text otherwise."""
    heads = F.slice(F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: x.startswith("#")), 1, 4)
    titles = one_line(F.array_join(F.transform(heads, lambda h: F.trim(F.regexp_replace(h, "^[# ]+", ""))), "; "))
    out = F.when((kind == "documentation") & (F.size(heads) > 0), titles)
    for k, text in SUMMARIES.items():
        out = out.when(kind == k, text)
    return out.otherwise(F.concat(F.lit("Found in "), F.substring_index(path, "/", -1), F.lit(".")))


def unread(files: DataFrame, max_bytes: int = 1_000_000) -> DataFrame:
    """(code, severity, path, message): files whose text ``evidence`` leaves out."""
    return files.filter(F.col("length") > max_bytes).select(
        F.lit("EVD001").alias("code"), F.lit("warning").alias("severity"), "path",
        F.concat(F.lit("text not read: over "), F.lit(max_bytes), F.lit(" bytes")).alias("message"))


def evidence(files: DataFrame, budget: int = 500, max_bytes: int = 1_000_000) -> DataFrame:
    """S12 + O07: (evd_id, kind, locator, summary, n_total) of files (path,
    content, length): every kind a file shows, and its comments with a reason.
    The text of larger files is left out; ``unread`` names them."""
    small = files.withColumn("content", F.when(F.col("length") <= max_bytes, F.col("content")))
    kinds = small.select("path", "content", F.explode(file_kinds(F.col("path"))).alias("kind"))
    rows = kinds.select("kind", F.col("path").alias("locator"), summary(F.col("kind"), F.col("path"), F.col("content")).alias("summary"))
    lines = small.select("path", F.posexplode(F.split("content", "\n")).alias("i", "line"))
    said = lines.filter(F.col("line").rlike(_COMMENT) & F.col("line").rlike(REASON)).select(
        F.lit("comment").alias("kind"), F.concat_ws(":", "path", F.col("i") + 1).alias("locator"), one_line(F.regexp_extract("line", _COMMENT, 1)).alias("summary"))
    every = rows.unionByName(said).withColumn("pos", F.struct("locator", "summary"))
    return stratified(every, budget).drop("pos")


def areas(counts: DataFrame) -> DataFrame:
    """One row with the areas worth a look, from (kind, count)."""
    row = counts.agg(F.map_from_entries(F.collect_list(F.struct("kind", "count"))).alias("m"))
    has = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)) > 0
    rules = [("source", "module boundaries"), ("test", "tested behavior"), ("configuration", "deployment and automation"), ("dependency", "external dependencies"), ("comment", "stated reasons")]
    return row.select(F.array_compact(F.array(*[F.when(has(k), text) for k, text in rules])).alias("areas"))


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=10, check=True).stdout


def git_log(spark: SparkSession, root: str, limit: int = 50) -> DataFrame:
    """(hash, subject), newest first; the history of one repository is
    bounded by ``limit`` and read by the driver."""
    lines = _git(root, "log", f"--max-count={int(limit)}", "--format=%H%x09%s").splitlines()
    return spark.createDataFrame([tuple(x.split("\t", 1)) for x in lines if "\t" in x], "hash string, subject string")


def git_changes(spark: SparkSession, root: str) -> DataFrame:
    """(path) of files that differ from the last commit."""
    parts = _git(root, "status", "--porcelain", "-z", "--untracked-files=all").split("\0")
    return spark.createDataFrame([(p[3:],) for p in parts if len(p) > 3], "path string").distinct()


def diff_paths(lines: DataFrame) -> DataFrame:
    """Paths of a unified diff (value)."""
    path = F.regexp_extract("value", r"^\+\+\+ b/(.+?)\s*$", 1)
    return lines.select(path.alias("path")).filter("path <> '' AND path <> '/dev/null'").distinct()


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    schema = "command string, target string, at string, actor string, kind string, found boolean, files long, records long, hops long, counts map<string,long>"
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return raw.withColumn("logged_at", F.try_to_timestamp("at").cast("timestamp_ntz"))
