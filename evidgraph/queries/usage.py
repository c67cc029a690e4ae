"""A13, A14, A18-A20, A24, J21, O12, O13 as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import report as r
from ..operators.search import flat_overlap
from . import views as v
from .views import ctes, plain, view


def _log(spark, d):
    log = view(spark, d, v.LOG)
    return log.withColumn("hit", r.hit(F.col("found"), F.col("files"), F.lit(None).cast("long")))


def _rolled(spark, d):
    log = _log(spark, d)
    now = log.agg(F.max("logged_at")).head()[0]
    return r.usage_rollup(log, F.lit(now).cast("timestamp_ntz")), now


def usage_rollup(spark, d):
    return _rolled(spark, d)[0]


def usage_by_command(spark, d):
    return r.usage_by(_log(spark, d), "command")


def hit_rate(spark, d):
    """A14 by command: scored and landed queries."""
    return _log(spark, d).groupBy("command").agg(F.count("hit").alias("scored"), F.count_if("hit").alias("landed"), F.round(F.avg(F.col("hit").cast("int")), 2).alias("rate"))


def usage_verdict(spark, d):
    rolled, now = _rolled(spark, d)
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_at").cast("timestamp"))) / 86_400_000_000
    return rolled.select(r.verdict(F.col("total"), F.col("agent"), age, F.col("hit_rate")).alias("verdict"))


def recent_n(spark, d):
    return r.tail(_log(spark, d).select("id", "command", "logged_at", "kind"), 10)


def tail_trim(spark, d):
    return r.tail(_log(spark, d).select("id", "logged_at"), 5000).select("id")


def session_metrics(spark, d):
    return r.session_metrics(view(spark, d, v.TURNS))


def latest_session(spark, d):
    turns = view(spark, d, v.TURNS)
    return r.latest_session(turns, turns.select("session_id").distinct(), "the")


def percent_delta(spark, d):
    """Each session's words against the session before it."""
    from pyspark.sql import Window

    m = r.session_metrics(view(spark, d, v.TURNS)).withColumn("bucket", F.col("session_id") % 16)
    before = F.lag("words").over(Window.partitionBy("bucket").orderBy("session_id"))
    return m.select("session_id", r.percent_delta(before, F.col("words")).alias("delta"))


def recall_precision(spark, d):
    """Documents that hold a benchmark item against the flat search."""
    expected = _expected(spark, d)
    got = flat_overlap(view(spark, d, v.CORPUS), view(spark, d, v.TASKS)).select(F.col("query_id").alias("case_id"), F.col("node_id").alias("item"))
    return r.recall_precision(expected, got)


def _expected(spark, d):
    """Documents with twelve words in a row of an item, by an equi-join on
    twelve-word windows of both."""
    words = lambda c: F.split(F.trim(c), "\\s+")

    def windows(key: str, sql: str):
        x = view(spark, d, sql).select(key, words(F.col("text")).alias("x"))
        starts = F.sequence(F.lit(1), F.greatest(F.size("x") - 11, F.lit(1)))
        return x.select(key, F.explode(F.transform(starts, lambda i: F.array_join(F.slice("x", i, 12), " "))).alias("w"))

    items = windows("case_id", "SELECT item_id AS case_id, text FROM {benchmark}").distinct()
    found = windows("doc_id", "SELECT doc_id, text FROM {documents}")
    return found.join(items, "w").select("case_id", F.concat(F.lit("doc:"), "doc_id").alias("item")).distinct()


QUERIES = {f.__name__: f for f in (usage_rollup, usage_by_command, hit_rate, usage_verdict, recent_n, tail_trim, session_metrics, latest_session, percent_delta, recall_precision)}

_L = f"WITH log AS (SELECT *, coalesce(found, CASE WHEN files IS NOT NULL THEN files > 0 END) AS hit FROM ({plain(v.LOG)}))"
_W = r"len(list_filter(regexp_split_to_array(message, '[ \n\t]+'), lambda w: w <> ''))"
_M = f"""t AS ({plain(v.TURNS)}), m AS (SELECT session_id, count(*) AS turns, coalesce(sum({_W}), 0)::BIGINT AS words, count(*) FILTER (WHERE role = 'user') AS user_turns,
count(*) FILTER (WHERE role = 'assistant') AS assistant_turns FROM t GROUP BY session_id)"""
_U = f"""{_L}, u AS (SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'process') AS agent, min(logged_at) AS first_at, max(logged_at) AS last_at,
  count(*) FILTER (WHERE logged_at >= (SELECT max(logged_at) FROM log) - INTERVAL 7 DAY) AS last_7d, count(*) FILTER (WHERE logged_at >= (SELECT max(logged_at) FROM log) - INTERVAL 30 DAY) AS last_30d,
  count(hit) AS scored, round(avg(hit::INT), 2) AS hit_rate FROM log)"""
ORACLES = {
    "usage_rollup": f"{_U} SELECT * FROM u",
    "usage_by_command": f"{_L} SELECT command, count(*) AS count FROM log GROUP BY command",
    "hit_rate": f"{_L} SELECT command, count(hit) AS scored, count(*) FILTER (WHERE hit) AS landed, round(avg(hit::INT), 2) AS rate FROM log GROUP BY command",
    "usage_verdict": f"{_U} SELECT total || ' graph queries (' || agent || ' of ' || total || ' came from an agent); last used within a day; ' || floor(hit_rate * 100)::INT || '% of scored queries landed.' AS verdict FROM u",
    "recent_n": f"{_L} SELECT id, command, logged_at, kind FROM log ORDER BY logged_at DESC, id DESC LIMIT 10",
    "tail_trim": f"{_L} SELECT id FROM log ORDER BY logged_at DESC, id DESC LIMIT 5000",
    "session_metrics": f"WITH {_M} SELECT * FROM m",
    "latest_session": f"WITH t AS ({plain(v.TURNS)}) SELECT session_id FROM t WHERE contains(message, 'the') ORDER BY turn_at DESC, session_id DESC LIMIT 1",
    "percent_delta": f"WITH {_M}, b AS (SELECT session_id, words, lag(words) OVER (PARTITION BY session_id % 16 ORDER BY session_id) AS p FROM m) SELECT session_id, CASE WHEN p <> 0 THEN round((words - p)::DOUBLE / p * 100, 1) END AS delta FROM b",
    "recall_precision": rf"""WITH {ctes(corpus=v.CORPUS, tasks=v.TASKS)},
b AS (SELECT DISTINCT node_id, t FROM (SELECT node_id, unnest(regexp_extract_all(lower(strip_accents(label || ' ' || body || ' ' || path)), '[\pL\pN]+')) AS t FROM corpus) WHERE len(t) > 2),
q AS (SELECT DISTINCT query_id, t FROM (SELECT query_id, unnest(regexp_extract_all(lower(strip_accents(query)), '[\pL\pN]+')) AS t FROM tasks) WHERE len(t) > 2),
s AS (SELECT query_id, node_id, count(*) AS score FROM b JOIN q USING (t) GROUP BY ALL),
got AS (SELECT query_id AS c, node_id AS i FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 8),
ix AS (SELECT item_id AS c, regexp_split_to_array(trim(text), '\s+') AS x FROM benchmark),
it AS (SELECT DISTINCT c, array_to_string(x[i:i + 11], ' ') AS w FROM (SELECT c, x, unnest(range(1, greatest(len(x) - 11, 1) + 1)) AS i FROM ix)),
x AS (SELECT doc_id, regexp_split_to_array(trim(text), '\s+') AS x FROM documents),
dw AS (SELECT DISTINCT doc_id, array_to_string(x[i:i + 11], ' ') AS w FROM (SELECT doc_id, x, unnest(range(1, greatest(len(x) - 11, 1) + 1)) AS i FROM x)),
e AS (SELECT DISTINCT c, 'doc:' || doc_id AS i FROM dw JOIN it USING (w)),
h AS (SELECT e.c, count(*) AS expected, count(got.i) AS found FROM e LEFT JOIN got ON got.c = e.c AND got.i = e.i GROUP BY e.c),
n AS (SELECT got.c, count(*) AS irrelevant FROM got WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.c = got.c AND e.i = got.i) GROUP BY got.c)
SELECT h.c AS case_id, expected, found, found = expected AS recalled, coalesce(irrelevant, 0)::BIGINT AS irrelevant FROM h LEFT JOIN n ON n.c = h.c""",
}
