"""Lookups that have to be complete, and the evaluation corpus."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators.chunking import compose
from threadloom.operators.retrieval import link_cap, positives, seeded, stratified_sample, stratum

#: Most of an evaluation corpus that may be positives.
POSITIVE_FRACTION = 0.25


def missing_keys(needed: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Needed keys that a table lacks, once each; null keys are not asked for."""
    return needed.where(F.col(key).isNotNull()).select(key).distinct().join(df.select(key), key, "left_anti")


def lookup(needed: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` (key unique) of the needed keys; one that is missing raises when the rows are read.

    Null keys are not asked for, repeated ones count once.
    """
    asked = needed.where(F.col(key).isNotNull()).select(key).distinct()
    rest = [c for c in df.columns if c != key]
    found = asked.join(df.select(key, F.struct(*rest, F.lit(True).alias("_")).alias("r")), key, "left")
    sure = F.when(F.col("r").isNull(), F.raise_error(F.concat(F.lit(f"{key} not found: "), F.col(key).cast("string"))).cast(found.schema["r"].dataType)).otherwise(F.col("r"))
    return found.select(key, sure.alias("r")).select(key, *(F.col("r")[c].alias(c) for c in rest))


def positive_cap(total: int, cap: int, fraction: float = POSITIVE_FRACTION) -> int:
    """How many positives a corpus of ``total`` rows may have: the cap, or the fraction of the total if that is less, at least one."""
    return min(cap, max(1, int(total * fraction)))


def eval_corpus(chunks: DataFrame, found: DataFrame, *, total: int, cap: int = 500, per_link: int = 0, seed: int = 42) -> DataFrame:
    """The evaluation corpus: best candidates of all queries and a stratified sample of other chunks, shuffled.

    ``chunks``: one row per chunk_id; ``found``: candidates as (query_id,
    chunk_id, link, score, rank).  Result: the chunks' columns with ``ordinal``
    from 0 and ``is_positive``.  A positive that is no chunk raises, and so does
    a pool with too few rows.  ``total`` bounds the rows of the last window.
    """
    pos = positives(link_cap(found, per_link), positive_cap(total, cap)).select("chunk_id")
    best = lookup(pos, chunks, "chunk_id").withColumn("is_positive", F.lit(True))
    pool = chunks.join(pos, "chunk_id", "left_anti").withColumn("stratum", stratum())
    need = pos.agg((F.lit(total) - F.count("*")).alias("need"))
    rest = stratified_sample(pool, need, seed).drop("stratum").withColumn("is_positive", F.lit(False))
    every = best.select(*chunks.columns, "is_positive").unionByName(rest.select(*chunks.columns, "is_positive"))
    return every.withColumn("ordinal", F.row_number().over(Window.orderBy(seeded("chunk_id", seed), "chunk_id")) - 1)


def corpus_meta(corpus: DataFrame, found: DataFrame, *, total: int, cap: int, seed: int) -> DataFrame:
    """One row: sizes, parameters, and the candidates of each query (not deduplicated across queries)."""
    by_query = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c")).select("query_id", F.transform("c", lambda x: x["chunk_id"]).alias("ids"))
    ids = by_query.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_id", "ids")))).alias("query_candidates"))
    sizes = corpus.agg(F.count_if("is_positive").alias("positives"), F.count_if(~F.col("is_positive")).alias("distractors"), F.count("*").alias("rows"))
    return sizes.crossJoin(ids).select(F.lit(total).alias("target_total"), F.lit(cap).alias("positive_cap"), F.lit(POSITIVE_FRACTION).alias("positive_fraction"), F.lit(seed).alias("seed"), "positives", "distractors", "rows", "query_candidates")


def write_eval_corpus(corpus: DataFrame, meta: DataFrame, folder: str) -> None:
    """Three sinks: the corpus in its order, its description, and the candidates of each query."""
    corpus.orderBy("ordinal").write.mode("overwrite").json(f"{folder}/corpus")
    meta.drop("query_candidates").write.mode("overwrite").json(f"{folder}/meta")
    meta.select(F.explode("query_candidates").alias("query_id", "chunk_ids")).write.mode("overwrite").json(f"{folder}/positives")


def load_eval_corpus(spark: SparkSession, folder: str, *, strict: bool = True, policy: str = "baseline_full") -> DataFrame:
    """A corpus that was written, in its order, with the text that is embedded.

    A row without chunk_id raises, or is left out if not ``strict``.
    """
    d = spark.read.json(f"{folder}/corpus")
    for c in ("chunk_id", "post_title", "post_summary", "text", "chunk_type"):
        if c not in d.columns:  # a column null throughout is not in the lines
            d = d.withColumn(c, F.lit(None).cast("string"))
    for c in ("nest_level", "ordinal"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("long"))
    if strict:
        d = d.withColumn("chunk_id", F.when(F.col("chunk_id").isNull(), F.raise_error(F.lit("a row has no chunk_id"))).otherwise(F.col("chunk_id")))
    else:
        d = d.where("chunk_id is not null")
    return d.withColumn("input", compose(policy)).orderBy("ordinal")


def qa_sample(df: DataFrame, key: str, n: int, *, first: int = 5000, seed: int = 42) -> DataFrame:
    """``n`` of the first ``first`` rows by key, in a seeded order; both are parameters of the report."""
    head = df.where(F.col(key).isNotNull()).orderBy(key).limit(first)
    return head.orderBy(seeded(key, seed), key).limit(n)


def unexpected_fields(found: DataFrame, expected: list[str]) -> DataFrame:
    """Field names that are there but not expected."""
    spark = found.sparkSession
    listed = functools.reduce(DataFrame.unionByName, (spark.range(1).select(F.lit(e).alias("field")) for e in expected)) if expected else found.limit(0)
    return found.select("field").subtract(listed.select("field"))
