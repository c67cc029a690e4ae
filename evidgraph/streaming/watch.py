"""E19, 2.12: refresh on change, and a stream over the usage log.

The file source of a stream only reports new files, so each micro-batch is a
trigger: the plan compares the whole tree with the manifest and re-extracts
what differs; edits and deletions come out of that comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.derive import snapshot_diff
from ..plans.index import Index, build
from ..sources import files
from ..sources.files import Config


def current_sources(spark: SparkSession, root: str, config: Config | None = None) -> DataFrame:
    """(path, hash) of what an index of the tree would hold now."""
    config = config or Config()
    every = files.scan(spark, root, config, all_suffixes=True)
    in_records = F.col("path").startswith(config.records_dir.rstrip("/") + "/")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return every.filter((in_records & (suffix == ".md")) | (~in_records & suffix.isin(config.suffixes))).select("path", "hash")


def refresh(spark: SparkSession, root: str, folder: str, config: Config | None = None) -> dict[str, int]:
    """One incremental run: reads the newest snapshot below ``folder``, writes
    the next one beside it if anything changed. Returns counts by state."""
    config = config or Config()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(conf)
    fs.mkdirs(top)
    done = [s.getPath().getName() for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_COMPLETE"))]
    last = max((int(n[1:]) for n in done if n[1:].isdigit()), default=0)
    previous = Index.load(spark, f"{folder}/s{last:06d}") if last else None
    current = current_sources(spark, root, config)
    indexed = previous.sources if previous else spark.createDataFrame([], "path string, hash string")
    states = {r["state"]: r["count"] for r in snapshot_diff(indexed, current).groupBy("state").count().collect()}
    if previous is None or set(states) - {"same"}:
        to = f"{folder}/s{last + 1:06d}"
        build(spark, root, config, previous).save(to)
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{to}/_COMPLETE")).close()
    return states


def latest(spark: SparkSession, folder: str) -> Index:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [s.getPath() for s in fs.listStatus(top) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_COMPLETE"))]
    return Index.load(spark, max(p.toString() for p in done))


def watch(spark: SparkSession, root: str, folder: str, checkpoint: str, config: Config | None = None, once: bool = True, interval: str = "2 seconds") -> StreamingQuery:
    """Refresh whenever files arrive; ``once`` handles what is there and ends."""
    seen = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option(
        "recursiveFileLookup", "true").load(root).select("path")

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh(spark, root, folder, config)

    writer = seen.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the usage log by command and day as lines arrive; days close
    two days late."""
    schema = "command string, target string, at string, actor string, kind string, found boolean"
    log = spark.readStream.schema(schema).json(folder).withColumn("logged_at", F.try_to_timestamp("at"))
    return log.withWatermark("logged_at", "2 days").groupBy(F.window("logged_at", "1 day"), "command").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("found").alias("found"))
