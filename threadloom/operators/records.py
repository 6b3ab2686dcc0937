"""Derived record fields, index properties, judge aggregates and report deltas."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import blank_to_null, month
from threadloom.operators.answers import clamp_score, strip_fences
from threadloom.operators.retrieval import stratum


def chunk_profile(chunks: DataFrame) -> DataFrame:
    """Kind, vote, root thread, year, month, stratum and UTC time of each chunk."""
    post = F.col("chunk_type") == "post"
    vote = F.when(post, F.coalesce("post_score", F.lit(0))).otherwise(F.coalesce("comment_score", F.lit(0)))
    root = F.coalesce("link_id", F.when(post, F.concat(F.lit("t3_"), F.split("chunk_id", "_")[1])), "chunk_id")
    at = F.timestamp_seconds("created_utc")
    return chunks.select("chunk_id", vote.alias("vote"), root.alias("root_id"), F.coalesce(F.year(at).cast("string"), F.lit("unknown")).alias("year"), month(F.col("created_utc")).alias("month"), stratum().alias("stratum"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created_iso"))


def index_properties(chunks: DataFrame, sentence: Column | None = None) -> DataFrame:
    """Typed properties of an index row: defaults for counts, nothing for the other kind's fields, the parent's sentence from depth 3 on."""
    post = F.col("chunk_type") == "post"
    zero = lambda c: F.coalesce(c, F.lit(0))
    above = F.when(~post & (F.col("nest_level") >= 3), sentence) if sentence is not None else F.lit(None).cast("string")
    return chunks.select(
        "chunk_id", "chunk_type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("post_title", F.lit("")).alias("post_title"), blank_to_null(F.col("post_summary")).alias("post_summary"),
        F.when(~post, zero("comment_score")).alias("comment_score"), F.when(post, zero("post_score")).alias("post_score"), F.when(post, zero("num_comments")).alias("num_comments"), F.when(post, F.col("upvote_ratio")).alias("upvote_ratio"),
        zero("agreement_count").alias("agreement_count"), zero("thanks_count").alias("thanks_count"), F.when(~post, F.col("link_id")).alias("link_id"), F.when(~post, F.col("nest_level")).alias("nest_level"), above.alias("parent_first_sentence"), F.coalesce("stickied", F.lit(False)).alias("stickied"), zero("created_utc").alias("created_utc"),
    )


def judge_means(scores: DataFrame) -> DataFrame:
    """(model, criterion, mean_all, mean_valid, n_failed): failures count as 0 in the one mean and not at all in the other.

    ``scores``: (model, criterion, raw).
    """
    s = scores.withColumn("s", clamp_score(F.col("raw")))
    return s.groupBy("model", "criterion").agg(F.round(F.avg("s"), 6).alias("mean_all"), F.round(F.avg(F.when(F.col("s") > 0, F.col("s"))), 6).alias("mean_valid"), F.count_if(F.col("s") == 0).alias("n_failed"))


def model_means(scores: DataFrame) -> DataFrame:
    """(model, criterion, mean): means over scores of 1 to 5, one decimal, 0 if there is none; and under ``mean`` the mean of a model's criteria.

    ``scores``: (model, criterion, raw).
    """
    s = scores.withColumn("s", clamp_score(F.col("raw")))
    by = s.groupBy("model", "criterion").agg(F.coalesce(F.round(F.avg(F.when(F.col("s") > 0, F.col("s"))), 1), F.lit(0.0)).alias("mean"))
    return by.unionByName(by.groupBy("model").agg(F.round(F.avg("mean"), 1).alias("mean")).withColumn("criterion", F.lit("mean")))


def metric_deltas(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) of the metrics both reports have."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return a.join(b, key).withColumn("delta", F.round(F.col("after") - F.col("before"), 6))


def first_json_object(text: str | None) -> str | None:
    """The first balanced object of a text, braces inside strings not counted; null if there is none."""
    start, depth, quoted, escaped = -1, 0, False, False
    for i, c in enumerate(text or ""):
        if start < 0:
            if c == "{":
                start, depth = i, 1
        elif quoted:
            escaped, quoted = c == "\\" and not escaped, not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def parse_reply(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, parsed): the reply's JSON object as text, from the fenced, the raw or the first balanced candidate; null if none parses."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for bare, raw in zip(f["bare"], f["raw"], strict=True):
                for c in (bare, raw, first_json_object(raw)):
                    try:
                        v = json.loads(c)
                    except (TypeError, ValueError):
                        continue
                    if isinstance(v, dict):
                        out.append(json.dumps(v, sort_keys=True))
                        break
                else:
                    out.append(None)
            yield pd.DataFrame({key: f[key], "parsed": out})

    return df.select(key, strip_fences(F.col(reply)).alias("bare"), F.col(reply).alias("raw")).mapInPandas(run, f"{key} {kind}, parsed string")
