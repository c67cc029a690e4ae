"""Views that both engines read, as SQL over the driver's tables in braces."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The star schema as a property graph.
NODES = """
SELECT 'region:' || r_regionkey AS id, 'Community' AS type, r_name AS label, r_name AS path, r_name AS source_path FROM {region}
UNION ALL SELECT 'nation:' || n_nationkey, 'File', n_name, r_name || '/' || n_name, r_name || '/' || n_name
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'customer:' || c_custkey, 'Symbol', c_name, r_name || '/' || n_name, r_name || '/' || n_name
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier:' || s_suppkey, 'Symbol', s_name, r_name || '/' || n_name, r_name || '/' || n_name
  FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'part:' || p_partkey, 'Symbol', p_name, 'parts/' || p_brand, 'parts/' || p_brand FROM {part}
UNION ALL SELECT 'order:' || o_orderkey, 'Symbol', 'order.' || o_orderkey, 'orders/' || o_orderpriority, 'orders/' || o_orderpriority FROM {orders}
"""
EDGES = """
SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'MEMBER_OF' AS type FROM {nation}
UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'CONTAINS' FROM {customer}
UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'CONTAINS' FROM {supplier}
UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'REFERENCES' FROM {orders}
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'CALLS' FROM {lineitem}
UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'IMPORTS' FROM {lineitem}
"""
#: Documents as a search corpus, benchmark items as the tasks.
CORPUS = "SELECT 'doc:' || doc_id AS node_id, source || ' ' || lang AS label, text AS body, lang || '/' || source AS path FROM {documents}"
TASKS = "SELECT item_id AS query_id, text AS query FROM {benchmark}"
PARTS = "SELECT 'part:' || p_partkey AS node_id, p_name AS label, p_type AS body, 'parts/' || p_brand AS path FROM {part}"
#: A short task list over parts: one for each type and size.
PART_TASKS = "SELECT DISTINCT p_size AS query_id, 'explain ' || min(p_name) || ' using ' || min(p_type) AS query FROM {part} GROUP BY p_size"
#: Events as a usage log.
LOG = """
SELECT event_id AS id, event_type AS command, ts AS logged_at, CASE WHEN user_id % 3 = 0 THEN 'human' ELSE 'process' END AS kind,
       CASE WHEN event_type = 'error' THEN FALSE WHEN event_type IN ('purchase', 'signup') THEN TRUE END AS found,
       CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS files FROM {events}
"""
#: Conversations as sessions.
TURNS = "SELECT conv_id AS session_id, turn AS turn_at, role, text AS message FROM {conversations}"
#: Customers as records: what they ordered are their targets.
RECORDS = """
SELECT 'REC-' || o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'decision' ELSE 'constraint' END AS type, o_orderpriority AS title,
       CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'stable' ELSE 'proposed' END AS status, 'part/' || (l_partkey % 97) AS target
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
"""
#: The documents as an indexed snapshot and a later one: some gone, some changed, some new.
INDEXED = "SELECT 'd/' || doc_id AS path, md5(text) AS hash FROM {documents} WHERE doc_id % 11 <> 5"
CURRENT = "SELECT 'd/' || doc_id AS path, md5(CASE WHEN doc_id % 7 = 3 THEN text || '!' ELSE text END) AS hash FROM {documents} WHERE doc_id % 13 <> 6"


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view as a DataFrame."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    return spark.sql(text, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def plain(text: str) -> str:
    """A view as SQL for an engine that has the tables registered."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def ctes(**views: str) -> str:
    return ", ".join(f"{name} AS ({plain(text)})" for name, text in views.items())
