"""Tables written to the folder that driver and executors share, and read back.

Staging ends a lineage: what several consumers read is computed once, and lost executors
lose nothing. The folder is spark.checkpoint.dir; only a local master may do without.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local master may fall back on a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _LOCAL[app]


def stage(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df as one side of a join of two tables that both grow with the input: sorted on both sides, never broadcast.

    Estimates come from the size of compressed files and leave out what an explosion adds, so
    the planner would take millions of rows for a few MB and send them through the driver.
    """
    return df.hint("merge")


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores where it is too small to be read by as many tasks; larger tables stay as they are read.

    For work that is heavy for each row, such as parsing. Only a table below one file split
    for each core is exchanged, so what moves is bounded by the cluster and not by the data.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < cores * split else df


def unstage(df: DataFrame) -> None:
    """Delete the files behind a table that stage() returned and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
