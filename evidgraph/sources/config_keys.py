"""Configuration keys, never values, from JSON and YAML."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MAX_BYTES, MAX_KEYS = 2_000_000, 5_000


def flatten_json(sources: DataFrame, max_depth: int = 16) -> DataFrame:
    """(source, key_path, value_type) of JSON texts (source, content), with
    VARIANT functions only: one level an iteration, until no container is left.
    value_type is mapping, sequence-item or value."""
    level = sources.select("source", F.lit("").alias("key_path"), F.try_parse_json("content").alias("v")).filter("v IS NOT NULL")
    out = None
    for _ in range(max_depth):
        level.createOrReplaceTempView("__variant_level")
        spark = level.sparkSession
        step = spark.sql(
            "SELECT source, CASE WHEN e.key IS NULL THEN concat(key_path, '[', e.pos, ']') WHEN key_path = '' THEN e.key ELSE concat(key_path, '.', e.key) END AS key_path,"
            " e.value AS v, e.key IS NULL AS item, schema_of_variant(e.value) AS s FROM __variant_level, LATERAL variant_explode(v) AS e"
        )
        kind = F.when(F.col("s").startswith("OBJECT"), "mapping").when(F.col("item"), "sequence-item").otherwise("value")
        rows = step.select("source", "key_path", kind.alias("value_type"))
        out = rows if out is None else out.unionByName(rows)
        level = step.filter("s LIKE 'OBJECT%' OR s LIKE 'ARRAY%'").select("source", "key_path", "v")
        if max_depth > 1 and level.limit(1).isEmpty():
            break
    return out


@udtf(returnType="key_path string, value_type string, code string, message string")
class ConfigKeys:
    """One file's keys depth-first in sorted order, or a diagnostic row."""

    def eval(self, path: str, content: str):
        if content is None:
            return
        if len(content.encode()) > MAX_BYTES:
            yield None, None, "CFG002", f"{path} is larger than {MAX_BYTES} bytes"
            return
        try:
            if path.endswith(".json"):
                value = json.loads(content)
            else:
                import yaml

                value = yaml.safe_load(content)
        except Exception as e:  # any parser error is a finding about the file
            yield None, None, "CFG001", str(e).splitlines()[0][:200]
            return
        n = 0
        stack = [("", value, False)]
        while stack:
            prefix, v, item = stack.pop()
            if prefix:
                if n == MAX_KEYS:
                    yield None, None, "CFG003", f"{path} has more than {MAX_KEYS} keys"
                    return
                n += 1
                yield prefix, "mapping" if isinstance(v, dict) else "sequence-item" if item else "value", None, None
            if isinstance(v, dict):
                for k in sorted(map(str, v), reverse=True):
                    child = next(x for key, x in v.items() if str(key) == k)
                    stack.append((f"{prefix}.{k}" if prefix else k, child, False))
            elif isinstance(v, list):
                for i in range(len(v) - 1, -1, -1):
                    stack.append((f"{prefix}[{i}]", v[i], True))


def config_keys(files: DataFrame) -> DataFrame:
    """(path, key_path, value_type, code, message) of files (path, content)."""
    spark = files.sparkSession
    spark.udtf.register("evid_config_keys", ConfigKeys)
    files.createOrReplaceTempView("__config_files")
    return spark.sql("SELECT f.path, k.* FROM __config_files f, LATERAL evid_config_keys(f.path, f.content) k")
