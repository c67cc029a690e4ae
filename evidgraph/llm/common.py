"""Shared helpers: scratch tables in the cluster's shared folder, word counts."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that the contracts name.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: One ASCII white-space run, as a Java pattern.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_fallback: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or one
    made here if the session names none (local sessions only)."""
    global _fallback
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _fallback is None:
        _fallback = "file://" + tempfile.mkdtemp(prefix="evidgraph-")
    return _fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/evidgraph-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path).getParent()
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(top)
    fs.deleteOnExit(top)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and survives lost executors; a later join sees a plain scan
    on this side, so adaptive execution may split skewed partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def settled_bytes(df: DataFrame) -> int:
    """Bytes on disk of a settled table."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove settled tables that nothing reads any more, and let the driver
    drop the shuffle files of finished queries."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast path; byte-wise
    replacement of single letters is far quicker than ``translate``."""
    replaced = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(x.lower())), UPPER, col)
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(replaced)


def count_words(col: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; null and blank text have none."""
    bare = F.btrim(col, F.lit(ASCII_SPACE))
    return (
        F.when(F.coalesce(bare, F.lit("")) == "", F.lit(0))
        .otherwise(F.size(F.split(bare, SPACE_RUN)))
        .cast("long")
    )


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
