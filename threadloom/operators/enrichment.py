"""Summaries of posts: the run that can be taken up again, and their join to chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.providers import ask
from threadloom.operators.answers import pending
from threadloom.operators.chunking import latest_by
from threadloom.operators.gates import post_exclusion_reason
from threadloom.sources.ndjson import append_values, load_values
from threadloom.runtime import stored


def indexed_posts(posts: DataFrame) -> DataFrame:
    """(id, title, selftext) of the posts that are kept; a post delivered again counts once, as it came last."""
    kept = posts.where(post_exclusion_reason().isNull() & F.col("id").isNotNull())
    return latest_by(kept.select("id", "title", "selftext", "ingested_at"), "id").select("id", "title", "selftext")


def with_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks with the summary of their thread's post; null where there is none.  ``summaries``: (key, value), key the bare post id."""
    s = summaries.where("value is not null").groupBy("key").agg(F.max("value").alias("value"))
    bare = F.regexp_replace(F.coalesce("link_id", F.lit("")), "^t3_", "")
    d = chunks.drop("post_summary").withColumn("_bare", bare)
    return d.join(s, F.col("_bare") == F.col("key"), "left").drop("_bare", "key").withColumnRenamed("value", "post_summary")


def join_counters(chunks: DataFrame) -> DataFrame:
    """(total_chunks, with_summary, missing_lookup) of chunks that were joined."""
    has = F.col("post_summary").isNotNull()
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_if(has).alias("with_summary"), F.count_if(~has).alias("missing_lookup"))


def enrichment_counters(posts: DataFrame, done: DataFrame) -> DataFrame:
    """(indexed, already_cached, successes, failures) of the posts' keys in a checkpoint (key, value)."""
    j = posts.select(F.col("id").alias("key")).join(done.select("key", "value", F.lit(True).alias("tried")), "key", "left")
    return j.agg(F.count("*").alias("indexed"), F.count_if(F.col("value").isNotNull()).alias("already_cached"), F.count_if(F.col("tried") & F.col("value").isNull()).alias("failures"), F.count_if(F.col("tried").isNull()).alias("untried"))


def enrich(spark: SparkSession, posts: DataFrame, path: str, call: Callable[[str | None, str | None], str | None], *, threads: int = 20, tries: int = 3, wait: Callable[[int], float] = lambda n: 2.0 * 2**n) -> DataFrame:
    """Summaries of all posts, asked for only where the checkpoint at ``path`` has none; (key, value).

    A failure is written as null and asked for again by the next run.
    """
    todo = pending(posts.select(F.col("id").alias("key")), load_values(spark, path)).join(posts.withColumnRenamed("id", "key"), "key")
    # the replies are written as they were given, once; a plan that asks again could give others
    replies = stored(ask(todo, "key", ["title", "selftext"], call, threads=threads, tries=tries, wait=wait))
    append_values(replies, path)
    return load_values(spark, path)
