"""Session-level helpers: settings, table access, intermediate tables, spreading."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Settings every session of the engine should have; none depends on the machine.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    spark = b.config("spark.sql.shuffle.partitions", str(partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tz(c: str):
    """A timestamp column whether stored with or without a time zone (session zone is UTC)."""
    return F.col(c).cast("timestamp")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors see: ``spark.checkpoint.dir`` of the session.

    Only where neither it nor a directory set on the context exists, and the
    session is local (tests), a temporary one is made; on a cluster this raises.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if not held.isEmpty():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "threadloom-checkpoints")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def drop_at_end(spark: SparkSession, folder: str) -> None:
    """Have the file system drop a folder when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)


def drop(spark: SparkSession, folder: str) -> None:
    """Drop a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the shared folder, which is dropped when the application ends."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    drop_at_end(spark, at)
    return spark.read.schema(df.schema).parquet(at)


def estimated_bytes(df: DataFrame) -> int | None:
    """The planner's estimate of a table's size, None where it has none; no job is run."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else None


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a table over at least as many tasks as there are cores.

    A parquet file of one row group is one task however many cores wait; work
    that costs far more than moving the rows is spread first.  Input that
    already has that many partitions is left alone.
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df if have >= want else df.repartition(want)


def small_or_shuffled(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """A table with a broadcast hint if its rows take few bytes; a larger one is left to a shuffled join.

    The rows are counted up to the bound only.  A string counts by its mean
    length in the rows counted.
    """
    width = sum(8 if not isinstance(f.dataType, StringType) else 24 for f in df.schema)
    most_rows = most_bytes // max(width, 1)
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    seen = df.limit(most_rows + 1).agg(F.count("*").alias("n"), *(F.sum(F.octet_length(c)).alias(f"_{i}") for i, c in enumerate(texts))).first()
    size = seen["n"] * width + sum(seen[f"_{i}"] or 0 for i in range(len(texts)))
    return F.broadcast(df) if seen["n"] <= most_rows and size <= most_bytes else df
