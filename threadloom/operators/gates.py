"""Exclusion reasons, length gate, reply signals and the profile of raw tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import blank_to_null, month, tokens, ustrip, without_punctuation, word_count

MIN_WORDS = 25
# fixed values: phrases, whole replies and openers that mark a reply as agreement or thanks
AGREEMENT_PHRASES = (
    "same here", "me too", "+1", "same for me", "can relate",
    "yes same", "yeah same", "yea same", "omg same", "omg yes",
    "so much this", "this exactly", "exactly this",
    "same 🙋", "same 😔", "same 😭", "same 😢",
    "me 🙋", "me 🙋‍♀️", "me 🙋‍♂️", "me 😔", "me 😭", "me 😢",
    "yes this", "yeah this", "yep this",
    "same tbh", "same lol", "same honestly",
    "following", "subscribed",
)
AGREEMENT_EXACT = (
    "same", "this", "agreed", "exactly", "yep", "yup",
    "absolutely", "definitely", "yes", "yeah", "yea",
    "indeed", "yessss", "true", "totally", "me",
)
AGREEMENT_OPENERS = ("yes", "yeah", "yea", "yep", "yup", "same", "true", "totally", "absolutely", "definitely", "agreed", "exactly")
THANKS_PHRASES = (
    "thank you", "thanks for", "really appreciate", "this helped",
    "so helpful", "very helpful", "this is helpful", "that's helpful",
    "thats helpful", "was helpful", "were helpful", "helped me",
    "helped a lot", "appreciate you", "appreciate the", "appreciate it",
    "appreciate that", "appreciate this", "thank u", "thanks so much",
    "thank you so much", "thanks a lot", "thanks a bunch",
    "grateful for", "grateful to", "so grateful",
)
THANKS_EXACT = ("ty", "tysm", "tyvm", "thank you", "thanks", "thx", "thnx", "thank you so much", "thanks so much")
THANKS_OPENERS = ("thank", "thanks", "grateful", "appreciate")


def _sentinel(text: Column, first: Column = F) -> Column:
    """Empty, deleted or removed, after what comes first."""
    b = ustrip(F.coalesce(text, F.lit("")))
    return first.when(b == "", "empty").when(b == "[deleted]", "deleted").when(b == "[removed]", "removed")


def exclusion_reason(body: str = "body") -> Column:
    """Why a comment is left out, first match wins; null keeps it."""
    return _sentinel(F.col(body)).when(F.col("distinguished") == "moderator", "moderator").when(F.coalesce("score", F.lit(0)) < 0, "negative_score")


def post_exclusion_reason() -> Column:
    """Why a post is left out; a null is_self counts as a text post."""
    return _sentinel(F.col("selftext"), F.when(~F.coalesce("is_self", F.lit(True)), "not_self")).when(F.col("distinguished") == "moderator", "moderator")


def _judged(t: Column, clean: Column, n: Column, first: Column, phrases, exact, openers, empty: bool) -> Column:
    """The rules in turn: nothing said, a phrase, nothing but punctuation, a whole reply, a short one with an opener."""
    spoken = "|".join(map(re.escape, phrases))
    return F.when(t == "", empty).when(t.rlike(spoken), True).when(clean == "", empty).when(clean.isin(*exact), True).otherwise((n <= 5) & first.isin(*openers))


def with_reply_flags(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``agrees`` and ``thanks``; each step is a projection of its own, so nothing is worked out twice."""
    d = df.withColumn("_t", F.lower(ustrip(F.coalesce(F.col(body), F.lit(""))))).withColumn("_clean", without_punctuation(F.col("_t"))).withColumn("_w", tokens(F.col("_clean")))
    own = (F.col("_t"), F.col("_clean"), F.size("_w"), F.get("_w", F.lit(0)))
    d = d.withColumn("agrees", _judged(*own, AGREEMENT_PHRASES, AGREEMENT_EXACT, AGREEMENT_OPENERS, True)).withColumn("thanks", _judged(*own, THANKS_PHRASES, THANKS_EXACT, THANKS_OPENERS, False))
    return d.drop("_t", "_clean", "_w")


def parent_type(c: str = "parent_id") -> Column:
    return F.when(F.col(c).startswith("t3_"), "t3").when(F.col(c).startswith("t1_"), "t1").otherwise("unknown")


def length_bucket(wc: Column) -> Column:
    return F.when(wc.between(0, 5), "0-5").when(wc.between(6, 15), "6-15").when(wc.between(16, 24), "16-24").otherwise("other")


def exclusion_histogram(df: DataFrame, reason: Column) -> DataFrame:
    """(reason, n), with a row ``all`` for the total."""
    r = F.coalesce(reason, F.lit("keep"))
    return df.select(r.alias("reason")).rollup("reason").agg(F.count("*").alias("n")).select(F.coalesce("reason", F.lit("all")).alias("reason"), "n")


def social_signals(comments: DataFrame) -> DataFrame:
    """(parent_id, agreement_count, thanks_count) over kept comments that fail the length gate."""
    short = comments.where(exclusion_reason().isNull() & (word_count(F.col("body")) < MIN_WORDS) & F.col("parent_id").isNotNull() & (F.col("parent_id") != ""))
    g = with_reply_flags(short.select("parent_id", "body")).groupBy("parent_id").agg(F.count_if("agrees").alias("agreement_count"), F.count_if("thanks").alias("thanks_count"))
    return g.where("agreement_count > 0 or thanks_count > 0")


def gate_metrics(comments: DataFrame) -> DataFrame:
    """One row of counts over all comments, without content exclusion."""
    wc, s = word_count(F.col("body")), F.coalesce("score", F.lit(0)) >= 0
    d = with_reply_flags(comments.select(wc.alias("wc"), s.alias("ok"), "body")).select("wc", "ok", F.col("agrees").alias("a"), F.col("thanks").alias("t"))
    failed = F.col("wc") < MIN_WORDS
    return d.agg(
        F.count("*").alias("n"), F.count_if("ok").alias("pass_score"), F.count_if(~failed).alias("pass_length"), F.count_if(F.col("ok") & ~failed).alias("pass_both"),
        F.count_if(failed & F.col("a")).alias("agreement"), F.count_if(failed & F.col("t")).alias("thanks"), F.count_if(failed & F.col("a") & F.col("t")).alias("both_signals"),
    )


def short_buckets(comments: DataFrame) -> DataFrame:
    """(bucket, parent_kind, n, agreement, thanks) of the comments that fail the length gate."""
    short = comments.select(word_count(F.col("body")).alias("wc"), parent_type().alias("parent_kind"), "body").where(F.col("wc") < MIN_WORDS)
    d = with_reply_flags(short).select("wc", "parent_kind", F.col("agrees").alias("a"), F.col("thanks").alias("t"))
    return d.groupBy(length_bucket(F.col("wc")).alias("bucket"), "parent_kind").agg(F.count("*").alias("n"), F.count_if("a").alias("agreement"), F.count_if("t").alias("thanks"))


def quantiles(df: DataFrame, value: Column) -> DataFrame:
    """Exact quantiles with linear interpolation, and the ends."""
    q = F.percentile("v", F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95))))
    g = df.select(value.alias("v")).agg(F.count("v").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), q.alias("q"))
    return g.select("n", "least", "most", *(F.round(F.col("q")[i], 6).alias(k) for i, k in enumerate(("p25", "p50", "p75", "p90", "p95"))))


def field_presence(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, present, sentinel, n): neither null nor blank; ``[deleted]``/``[removed]`` counted apart."""
    aggs = [F.count("*").alias("n")]
    for f in fields:
        s = F.col(f).cast("string")
        aggs += [F.count_if(blank_to_null(s).isNotNull()).alias(f"p_{f}"), F.count_if(ustrip(s).isin("[deleted]", "[removed]")).alias(f"d_{f}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"p_{f}").alias("present"), F.col(f"d_{f}").alias("sentinel")) for f in fields)))
    return one.select(rows.alias("r"), "n").select("r.field", "r.present", "r.sentinel", "n")


def thread_structure(comments: DataFrame) -> DataFrame:
    """Counts of parent kinds and of links that name a post."""
    p = parent_type()
    linked = F.coalesce(F.col("link_id").startswith("t3_"), F.lit(False))
    return comments.agg(F.count_if(p == "t3").alias("t3_parents"), F.count_if(p == "t1").alias("t1_parents"), F.count_if(p == "unknown").alias("unknown_parents"), F.count_if(linked).alias("t3_links"), F.count_if(~linked).alias("other_links"))


def month_counts(df: DataFrame) -> DataFrame:
    return df.select(month(F.col("created_utc")).alias("month")).where("month is not null").groupBy("month").agg(F.count("*").alias("n"))


def gap_flags(counts: DataFrame, drop: float = 0.5) -> DataFrame:
    """(month, n, previous, flagged): a month is flagged if it has lost more than ``drop`` against the last present one.

    The window runs over one row a month, which months bound.
    """
    d = counts.withColumn("previous", F.lag("n").over(Window.orderBy("month")))
    return d.select("month", "n", "previous", F.coalesce((F.col("previous") - F.col("n")) / F.col("previous") > drop, F.lit(False)).alias("flagged"))


def coverage(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Months of either table with both counts."""
    a, b = month_counts(posts).withColumnRenamed("n", "n_posts"), month_counts(comments).withColumnRenamed("n", "n_comments")
    return a.join(b, "month", "full").select("month", F.coalesce("n_posts", F.lit(0)).alias("n_posts"), F.coalesce("n_comments", F.lit(0)).alias("n_comments"))


def samples_per_class(df: DataFrame, cls: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each class in a stated order."""
    w = Window.partitionBy("class").orderBy(*order)
    return df.withColumn("class", cls).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
