"""Indexed collections: definition, ingest with vectors in micro-batches, clones, embedding matrices."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.providers import hashed_embedding, in_order, with_attempts
from threadloom.runtime import stored
from threadloom.sources.ndjson import path_exists

COLLECTION = "chunk_id string, chunk_type string, text string, post_title string, post_summary string, comment_score long, post_score long, num_comments long, upvote_ratio double, agreement_count int, thanks_count int, link_id string, nest_level int, parent_first_sentence string, stickied boolean, created_utc long, vector array<double>"


def create_collection(spark: SparkSession, path: str, *, schema: str = COLLECTION, recreate: bool = False) -> bool:
    """An empty collection; True if it was made, False if it was there already and is kept."""
    if path_exists(spark, path) and not recreate:
        return False
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return True


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table beside the one at ``path``, which it may read, and then put it in its place."""
    spark = df.sparkSession
    new = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(new)
    old, made = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, new))
    system = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(old, True)
    if not system.rename(made, old):
        raise OSError(f"{new} could not be renamed to {path}")


def select_sources(chunks: DataFrame, *, comments: bool = True, posts: bool = True, limit: int | None = None) -> DataFrame:
    """Chunks of the kinds that are switched on; ``limit`` (for smoke runs) keeps that many, by id."""
    kinds = [k for k, on in (("comment", comments), ("post", posts)) if on]
    d = chunks.where(F.col("chunk_type").isin(*kinds)) if kinds else chunks.limit(0)
    return d.orderBy("chunk_id").limit(limit) if limit is not None else d


def embed_objects(objects: DataFrame, provider: Callable[[list], object] = hashed_embedding, *, text: str = "text", batch: int = 200, call: int = 64, tries: int = 5, wait: float = 2.0) -> DataFrame:
    """(chunk_id, vector, error): vectors in micro-batches of ``batch`` objects, ``call`` texts a call; a batch that fails keeps its rows, with the error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), batch):
                part = f.iloc[lo : lo + batch]
                try:
                    vs: list = []
                    for i in range(0, len(part), call):
                        texts = part["t"].iloc[i : i + call].tolist()
                        vs += with_attempts(lambda texts=texts: in_order(texts, list(provider(texts))), tries, lambda n: wait * (n + 1))
                    errors = [None] * len(part)
                except Exception as e:
                    vs, errors = [None] * len(part), [f"{type(e).__name__}: {e}"] * len(part)
                yield pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy(), "vector": vs, "error": errors})

    return objects.select("chunk_id", F.coalesce(F.col(text), F.lit("")).alias("t")).mapInPandas(run, "chunk_id string, vector array<double>, error string")


def ingest(objects: DataFrame, path: str, provider: Callable[[list], object] = hashed_embedding, **kw) -> DataFrame:
    """Bring objects (one row per chunk_id) into a collection and give (chunk_id, error) of those that failed.

    Objects that are there already are replaced; ingesting twice changes nothing.
    """
    spark = objects.sparkSession
    done = stored(embed_objects(objects, provider, **kw))
    new = objects.join(done.where("error is null").select("chunk_id", "vector"), "chunk_id")
    if path_exists(spark, path):
        old = spark.read.parquet(path)
        new = old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new, allowMissingColumns=True)
    replace_table(new, path)
    return done.where("error is not null").select("chunk_id", "error")


def ingest_counts(objects: DataFrame, failed: DataFrame) -> DataFrame:
    """(seen, ingested, failed) of an ingest."""
    return objects.agg(F.count("*").alias("seen")).crossJoin(failed.agg(F.count("*").alias("failed"))).select("seen", (F.col("seen") - F.col("failed")).alias("ingested"), "failed")


def clone_collection(spark: SparkSession, src: str, dst: str, export: str | None = None) -> int:
    """Copy a collection, vectors and all, to a new place; refuses an existing one and checks the count.

    The source is read once; ``export`` also writes the copy as line-JSON.
    """
    if path_exists(spark, dst):
        raise FileExistsError(f"{dst} exists")
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    d = spark.read.parquet(src)
    d.mapInArrow(counted, d.schema).write.mode("errorifexists").parquet(dst)
    copy = spark.read.parquet(dst)
    n = copy.count()
    if n > rows.value:  # a task that ran again counts its rows again, never fewer
        raise RuntimeError(f"{rows.value} rows read, {n} written")
    if export:
        copy.write.mode("errorifexists").json(export)
    return n


def vectors_of(vectors: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """(key, v) of the ids asked for; an id without vector, or with two, raises when the rows are read."""
    j = ids.select(key).distinct().join(vectors.groupBy(key).agg(F.count("*").alias("n"), F.first("v").alias("v")), key, "left")
    sure = F.when(F.coalesce("n", F.lit(0)) == 1, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not one vector of "), F.col(key).cast("string"))).cast(j.schema["v"].dataType))
    return j.select(key, sure.alias("v"))


def write_embeddings(vectors: DataFrame, path: str, model_id: str, policy: str, kind: str) -> None:
    """Vectors (id, v) of one model, policy and kind (chunks, queries), as single-precision rows in a partition of their own."""
    d = vectors.select(F.col("id").cast("string").alias("id"), F.col("v").cast("array<float>").alias("v"), F.lit(model_id).alias("model_id"), F.lit(policy).alias("policy"), F.lit(kind).alias("kind"))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model_id", "policy", "kind").parquet(path)


def embedding_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(model_id, policy, kind, n, dims) of what was written."""
    return spark.read.parquet(path).groupBy("model_id", "policy", "kind").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"))
