"""What arrives as a stream, in available-now batches: counts of comments by day, objects into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.gates import MIN_WORDS, exclusion_reason, word_count
from threadloom.runtime import tz
from threadloom.sources.collections import ingest


def comment_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def arrivals(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Kept and dropped comments by day of arrival; later rows than the watermark are left out."""
    kept = exclusion_reason().isNull() & (word_count(F.col("body")) >= MIN_WORDS)
    d = stream.select(tz("ingested_at").alias("at"), kept.alias("kept")).withWatermark("at", late)
    return d.groupBy(F.window("at", "1 day")).agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_dropped"))


def run_available(df: DataFrame, name: str, checkpoint: str) -> None:
    q = df.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def index_stream(stream: DataFrame, path: str, checkpoint: str, **kw) -> None:
    """Bring what has arrived of a stream of objects into a collection, batch by batch; a batch that runs again changes nothing.

    Objects that cannot be embedded are appended to ``path`` + ``.failed``.
    """

    def batch(df: DataFrame, number: int) -> None:
        failed = ingest(df.dropDuplicates(["chunk_id"]), path, **kw)
        failed.select("chunk_id", "error").write.mode("append").parquet(f"{path}.failed")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
