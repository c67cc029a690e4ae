"""Read-only questions by name, as a tool server would route them.

Each call opens the stored snapshot, answers one question and returns one JSON
envelope; a missing or unreadable snapshot, a name that is no tool or a missing
argument become an error in the same form, never an exception.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive
from ..sinks.export import envelope
from ..streaming.watch import current_sources
from . import ask
from .index import Index

#: How many changed paths a warning names.
STALE_SAMPLE = 5


def _rows(df: DataFrame) -> list[dict]:
    """The rows of a bounded answer."""
    return [json.loads(x) for x in df.toJSON().collect()]


def _target(index: Index, spark: SparkSession, text: str) -> DataFrame:
    found = ask.resolve(index, spark.createDataFrame([(text,)], "target string"))
    return found.select(F.lit(1).alias("query_id"), F.col("id"))


def _context(index: Index, spark: SparkSession, task: str) -> dict:
    return {"items": _rows(ask.context(index, spark.createDataFrame([(1, task)], "query_id int, query string")).drop("query_id"))}


def _explain(index: Index, spark: SparkSession, target: str) -> dict:
    return {"items": _rows(ask.explain(index, _target(index, spark, target)).drop("query_id"))}


def _impact(index: Index, spark: SparkSession, target: str) -> dict:
    return {"dependents": _rows(ask.impact(index, _target(index, spark, target).select("id")))}


def _path(index: Index, spark: SparkSession, source: str, target: str) -> dict:
    ends = [_target(index, spark, x).select("id").head() for x in (source, target)]
    return {"hops": _rows(ask.path(index, ends[0].id, ends[1].id)) if all(ends) else []}


def _flow(index: Index, spark: SparkSession, target: str) -> dict:
    return {"steps": _rows(ask.flow(index, _target(index, spark, target).select("id")))}


TOOLS: dict[str, tuple[Callable[..., dict], tuple[str, ...]]] = {
    "context": (_context, ("task",)),
    "explain": (_explain, ("target",)),
    "impact": (_impact, ("target",)),
    "path": (_path, ("source", "target")),
    "flow": (_flow, ("target",)),
}


def describe() -> list[dict]:
    """Name and arguments of every tool."""
    return [{"name": name, "arguments": list(arguments)} for name, (_, arguments) in TOOLS.items()]


def staleness(index: Index, current: DataFrame | None) -> dict:
    """What an answer adds when files changed after they were indexed; the
    list of changed paths is whole, the warning names the first of them."""
    if current is None:
        return {}
    changed = [r.path for r in derive.stale(index.sources, current).orderBy("path").collect()]
    if not changed:
        return {}
    named = ", ".join(changed[:STALE_SAMPLE]) + (", ..." if len(changed) > STALE_SAMPLE else "")
    return {"stale_sources": changed, "warnings": [f"{len(changed)} sources changed after indexing: {named}"]}


def call(spark: SparkSession, snapshot: str, name: str, arguments: dict[str, Any], root: str | None = None) -> str:
    """The envelope of one call. IDX001: no snapshot; IDX003: a snapshot that
    cannot be read; ARG001: no such tool or a missing argument. With ``root``
    the answer says what changed there since indexing."""
    if name not in TOOLS:
        return envelope(error=f"no tool {name}", code="ARG001")
    tool, wanted = TOOLS[name]
    missing = [a for a in wanted if not isinstance(arguments.get(a), str) or not arguments[a].strip()]
    if missing:
        return envelope(error=f"missing argument: {', '.join(missing)}", code="ARG001")
    try:
        index = Index.load(spark, snapshot)
    except PySparkException as e:
        code = "IDX001" if e.getCondition() == "PATH_NOT_FOUND" else "IDX003"
        return envelope(error=str(e).splitlines()[0], code=code)
    answer = tool(index, spark, *[arguments[a] for a in wanted])
    current = current_sources(spark, root) if root is not None else None
    return envelope({"ok": True, **answer, **staleness(index, current)})


def serve(spark: SparkSession, snapshot: str, requests: Iterable[str], root: str | None = None) -> Iterable[str]:
    """One envelope for each line {"tool": ..., "arguments": {...}}."""
    for line in requests:
        try:
            asked = json.loads(line)
            name, arguments = asked["tool"], dict(asked.get("arguments") or {})
        except (ValueError, TypeError, KeyError):
            yield envelope(error="not a request", code="ARG001")
            continue
        yield call(spark, snapshot, name, arguments, root)
