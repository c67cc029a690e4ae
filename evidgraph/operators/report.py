"""Usage, sessions, evaluation and graph reports (A03, A12-A14, A17-A20, A23,
A24, J21, O12, O13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_governing, is_proposed


def graph_totals(nodes: DataFrame, edges: DataFrame, status: Column) -> DataFrame:
    """One row: nodes, edges, accepted, proposed."""
    n = nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(is_governing(F.col("type"), status)).alias("accepted"),
        F.count_if(is_proposed(F.col("type"), status)).alias("proposed"))
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))  # one row by one row


def hit(found: Column, files: Column, records: Column, counts: Column | None = None) -> Column:
    """True, false or null (not scored)."""
    out = F.when(found.isNotNull(), found).when(
        files.isNotNull() | records.isNotNull(), (F.coalesce(files, F.lit(0)) > 0) | (F.coalesce(records, F.lit(0)) > 0))
    if counts is not None:
        out = out.when(counts.isNotNull(), F.exists(F.map_values(counts), lambda v: v > 0))
    return out


def usage_rollup(log: DataFrame, now: Column) -> DataFrame:
    """One row over (command, kind, logged_at, hit)."""
    within = lambda days: F.count_if(F.col("logged_at") >= now - F.make_dt_interval(F.lit(days)))
    return log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "process").alias("agent"),
        F.min("logged_at").alias("first_at"), F.max("logged_at").alias("last_at"), within(7).alias("last_7d"), within(30).alias("last_30d"),
        F.count("hit").alias("scored"), F.round(F.avg(F.col("hit").cast("int")), 2).alias("hit_rate"))


def usage_by(log: DataFrame, column: str) -> DataFrame:
    return log.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


def verdict(total: Column, agent: Column, last_days: Column, hit_rate: Column) -> Column:
    """A24."""
    who = F.when(agent > 0, F.format_string("%d of %d came from an agent", agent, total)).otherwise("all recorded queries look manual")
    days = F.regexp_replace(F.round(last_days, 1).cast("string"), r"\.0$", "")
    fresh = (
        F.when(last_days.isNull(), "timing unknown (log predates timestamps)")
        .when(last_days <= 1, "last used within a day")
        .when(last_days <= 7, F.concat(F.lit("last used "), days, F.lit(" days ago")))
        .otherwise(F.concat(F.lit("last used "), days, F.lit(" days ago: usage may have gone dark")))
    )
    landed = F.coalesce(F.format_string("; %d%% of scored queries landed", F.floor(hit_rate * 100)), F.lit(""))
    text = F.concat(F.format_string("%d graph queries (", total), who, F.lit("); "), fresh, F.when(hit_rate.isNotNull(), landed).otherwise(""), F.lit("."))
    return F.when(total == 0, "No graph queries recorded yet.").otherwise(text)


def tail(log: DataFrame, keep: int = 5000) -> DataFrame:
    """The last ``keep`` rows by time, then id: a distributed top-k."""
    return log.orderBy(F.desc("logged_at"), F.desc("id")).limit(keep)


def latest_session(turns: DataFrame, sessions: DataFrame, tag: str) -> DataFrame:
    """The newest session with a turn that holds ``tag``."""
    hits = turns.filter(F.contains("message", F.lit(tag))).join(sessions, "session_id")
    return hits.agg(F.max_by("session_id", F.struct("turn_at", "session_id")).alias("session_id"))


def session_metrics(turns: DataFrame) -> DataFrame:
    """Per session the number of turns, their words and turns by role."""
    words = F.size(F.filter(F.split("message", "[ \n\t]+"), lambda w: w != ""))
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.coalesce(F.sum(words), F.lit(0)).alias("words"),
        F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"))


def percent_delta(before: Column, after: Column) -> Column:
    """Null on a zero base."""
    return F.when(before != 0, F.round((after - before) / before * 100, 1))


def recall_precision(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Per case of (case_id, item) tables: expected items found, recall
    reached, and items not asked for."""
    cases = expected.select("case_id").distinct()
    hit_ = expected.distinct().join(got.distinct().withColumn("there", F.lit(1)), ["case_id", "item"], "left").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("expected"), F.count("there").alias("found"))
    extra = got.distinct().join(expected.distinct(), ["case_id", "item"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("irrelevant"))
    return cases.join(hit_, "case_id").join(extra, "case_id", "left").select(
        "case_id", "expected", "found", (F.col("found") == F.col("expected")).alias("recalled"), F.coalesce("irrelevant", F.lit(0)).cast("long").alias("irrelevant"))


def comments_by_file(comments: DataFrame) -> DataFrame:
    """(path, headline, notes): comments in line order."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "tag", "note")))
    return comments.groupBy("path").agg(ordered.alias("notes")).select("path", F.substring(F.col("notes")[0]["note"], 1, 72).alias("headline"), "notes")


def newest(table: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return table.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
