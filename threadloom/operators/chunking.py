"""Sliding-window chunks of comments and posts with their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import blank_to_null, first_sentence, tokens, ustrip, word_count
from threadloom.operators.gates import MIN_WORDS, exclusion_reason, post_exclusion_reason, social_signals

SIZE, OVERLAP = 300, 30


def windows(words: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of word windows: one up to ``size`` words, else a stride of size - overlap until all is covered."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda i: F.slice(words, i + 1, size))


def latest_by(df: DataFrame, key: str, at: str = "ingested_at") -> DataFrame:
    """One row per key, the one that arrived last; ties by all columns."""
    rest = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.max(F.struct(at, *[c for c in rest if c != at])).alias("r"))
    return one.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def _emit(df: DataFrame, prefix: str, text: str, common: list, extra: list) -> DataFrame:
    d = df.withColumn("w", tokens(F.col(text))).withColumn("parts", windows(F.col("w")))
    d = d.select("*", F.size("parts").alias("total_chunks"), F.posexplode("parts").alias("chunk_index", "part"))
    body = F.when(F.col("total_chunks") == 1, ustrip(F.col(text))).otherwise(F.array_join("part", " "))
    return d.select(F.concat(F.lit(prefix), "id", F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"), body.alias("text"), *common, *extra, "chunk_index", "total_chunks", F.size("part").alias("word_count"))


def comment_chunks(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Chunks of kept comments that pass the length gate, with post title and reply signals."""
    kept = comments.where(exclusion_reason().isNull() & (word_count(F.col("body")) >= MIN_WORDS))
    titles = posts.groupBy("id").agg(F.max_by("title", F.struct("ingested_at", "title")).alias("post_title")).withColumnRenamed("id", "pid")
    signals = social_signals(comments).select(F.substring("parent_id", 4, 1 << 30).alias("cid"), "parent_id", "agreement_count", "thanks_count").where("parent_id like 't1~_%' escape '~'").drop("parent_id")
    d = kept.withColumn("pid", F.regexp_replace("link_id", "^t3_", "")).join(titles, "pid", "left").join(signals, F.col("id") == F.col("cid"), "left")
    common = [F.coalesce("post_title", F.lit("")).alias("post_title"), F.coalesce("score", F.lit(0)).alias("comment_score"), F.coalesce("agreement_count", F.lit(0)).alias("agreement_count"), F.coalesce("thanks_count", F.lit(0)).alias("thanks_count")]
    return _emit(d, "t1_", "body", common, ["parent_id", "link_id", "nest_level", "is_submitter", "stickied", "created_utc"])


def post_chunks(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Chunks of kept posts with reply signals; no length gate."""
    kept = posts.where(post_exclusion_reason().isNull())
    signals = social_signals(comments).where("parent_id like 't3~_%' escape '~'").select(F.substring("parent_id", 4, 1 << 30).alias("pid"), "agreement_count", "thanks_count")
    d = kept.join(signals, kept.id == signals.pid, "left")
    common = [F.coalesce("title", F.lit("")).alias("post_title"), F.coalesce("score", F.lit(0)).alias("post_score"), F.coalesce("agreement_count", F.lit(0)).alias("agreement_count"), F.coalesce("thanks_count", F.lit(0)).alias("thanks_count")]
    return _emit(d, "t3_", "selftext", common, [F.coalesce("num_comments", F.lit(0)).alias("num_comments"), "upvote_ratio", "permalink", "link_flair_text", "stickied", "created_utc"])


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Indexed records, chunks, single and multiple, most and mean chunks a record."""
    first = F.col("chunk_index") == 0
    return chunks.agg(F.count_if(first).alias("n_records"), F.count("*").alias("n_chunks"), F.count_if(first & (F.col("total_chunks") == 1)).alias("n_single"), F.count_if(first & (F.col("total_chunks") > 1)).alias("n_multi"), F.max("total_chunks").alias("max_chunks"), F.round(F.count("*") / F.count_if(first), 3).alias("avg_chunks"))


def parent_sentences(comments: DataFrame) -> DataFrame:
    """(id, parent_first_sentence) of comments whose parent is a comment that exists; the parent's latest delivery counts."""
    one = latest_by(comments.select("id", "body", "parent_id", "ingested_at"), "id")
    parents = one.select(F.concat(F.lit("t1_"), "id").alias("pkey"), first_sentence(F.col("body")).alias("parent_first_sentence"))
    return one.select("id", "parent_id").join(parents, F.col("parent_id") == F.col("pkey")).select("id", "parent_first_sentence")


def compose(policy: str, kind: str = "chunk_type", depth: Column | None = None, sentence: Column | None = None) -> Column:
    """The text that is embedded; parts are joined by a blank line and empty ones dropped.

    Posts are title and body under every policy.  ``depth`` is the effective
    depth, ``sentence`` the parent's first sentence.
    """
    title, summary, body = blank_to_null(F.col("post_title")), blank_to_null(F.col("post_summary")), blank_to_null(F.col("text"))
    above = blank_to_null(sentence) if sentence is not None else F.lit(None).cast("string")
    d = depth if depth is not None else F.col("nest_level")
    j = lambda *c: F.concat_ws("\n\n", *c)
    full = j(title, summary, body)
    by = {
        "baseline_full": full,
        "no_enrich": j(body),
        "depth_v1": F.when(d >= 4, j(above, body)).when(d >= 2, j(title, body)).otherwise(full),
        "depth_v2": F.when(d >= 3, j(above, body)).when(d == 2, j(title, body)).otherwise(full),
        "depth_blend": F.when(d >= 3, j(title, above, body)).when(d == 2, j(title, body)).otherwise(full),
    }[policy]
    return F.when(F.col(kind) == "post", j(title, body)).otherwise(by)


POLICIES = ("baseline_full", "no_enrich", "depth_v1", "depth_v2", "depth_blend")


def effective_depth(reconstructed: Column, stored: Column) -> Column:
    return F.coalesce(reconstructed, stored.cast("string").try_cast("int"))


def depth_bucket(d: Column) -> Column:
    return F.when(d.isNull() | (d < 0), "unknown").when(d >= 4, "4+").otherwise(d.cast("string"))
