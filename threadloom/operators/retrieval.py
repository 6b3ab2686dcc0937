"""Keyword and vector search, fusion, ranking signals, evaluation sets and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import ustrip

K1, B = 1.2, 0.75
#: Digits kept where scores are ordered: sums of doubles differ in the last ones by order of addition.
DIGITS = 9
# fixed values: title hints by category, and the weight sets of the ranking tournament
EMOTIONAL_TITLE = r"(?i)(miss\b|old\s+me\b|grief|who\s+i\s+was|forgotten|ruined\s+my|hate\s|sucks?\b|don'?t\s+believe|gaslight|alone\b|depress|anxiety\b|identity|not\s+the\s+same|lost\s+myself|no\s+respect\s+for)"
BENEFITS_TITLE = r"(?i)(disability|ssdi|ssa\b|denied\b|appeal\b|benefits\b|unable\s+to\s+work|monthly\s+check|long[-\s]?term\s+disability)"
#: rank position, score, comments, recency, agreement, thanks
WEIGHTS = {"A_rank_only": (1.0, 0.0, 0.0, 0.0, 0.0, 0.0), "B_rank_dominant": (1.0, 0.2, 0.1, 0.0, 0.02, 0.02), "C_community_dominant": (0.4, 0.4, 0.3, 0.0, 0.05, 0.05), "D_recency_treatment": (1.0, 0.2, 0.1, 0.15, 0.02, 0.02)}


def search_terms(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 75) -> DataFrame:
    """(query_id, id, score, rank): the k best of each query.

    ``docs``: (id, text), ids distinct; ``queries``: (query_id, query), a stated
    set that is small beside the documents.  Only postings of query terms are
    kept, so the shuffle holds (term, document, count) of those; what is small
    enough to be broadcast is left to the planner's measure of it.  Null texts
    have length 0 and match nothing; ties by id.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(search_terms(F.col("query")))).alias("term"))
    toks = docs.select("id", search_terms(F.col("text")).alias("w")).withColumn("len", F.size("w"))
    stats = toks.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    post = toks.select("id", "len", F.explode("w").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    s = post.join(df, "term").join(terms, "term").crossJoin(F.broadcast(stats))  # stats: one row
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = s.groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def l2_normalise(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """(query_id, id, score, rank) by cosine; the query set meets all rows in blocks of ``block`` queries.

    ``vectors``: (id, v); ``queries``: (query_id, v).  A query does not find
    itself.  Null vectors find and are found nothing; ties by id.  A block's
    matrix of queries goes to every task, which multiplies it with batches of
    rows and keeps the k best of each query; only those are shuffled.
    """
    kind, named = vectors.schema["id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {named}, id {kind}, score double"
    v = vectors.where("v is not null").select("id", "v")
    q = queries.where("v is not null").select("query_id", "v")
    blocks = max(1, -(-q.count() // block))
    out = None
    for i in range(blocks):
        part = q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas() if blocks > 1 else q.toPandas()
        found = v.mapInPandas(_nearest(part["query_id"].to_numpy(), unit_rows(part["v"]), k), schema)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def unit_rows(v: pd.Series) -> np.ndarray:
    """Rows of unit length in double; norms are floored at 1e-12."""
    m = np.array([np.asarray(x, np.float64) for x in v]) if len(v) else np.zeros((0, 1))
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)


def _nearest(ids: np.ndarray, matrix: np.ndarray, k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for f in frames:
            if not len(f) or not len(ids):
                continue
            score = np.round(matrix @ unit_rows(f["v"]).T, DIGITS)
            rows, own = f["id"].to_numpy(), []
            # the k best and all that tie with the last of them; the query itself may be one more
            most = min(k + 1, len(rows))
            least = -np.partition(-score, most - 1, axis=1)[:, most - 1 : most]
            at, col = np.nonzero(score >= least)
            own = pd.DataFrame({"query_id": ids[at], "id": rows[col], "score": score[at, col]})
            own = own[own["query_id"].astype(object) != own["id"].astype(object)]
            best = own if best is None else pd.concat([best, own], ignore_index=True)
            best = best.sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
        if best is not None:
            yield best

    return run


def fuse(keyword: DataFrame, vector: DataFrame, alpha: float = 0.8, k: int = 75) -> DataFrame:
    """Relative-score fusion of two result lists: min-max in each leg, weighted sum; all equal gives 1, a missing leg 0."""
    q = Window.partitionBy("query_id")

    def leg(df: DataFrame, name: str) -> DataFrame:
        lo, hi = F.min("score").over(q), F.max("score").over(q)
        return df.select("query_id", "id", F.when(hi == lo, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo)).alias(name))

    both = leg(keyword, "b").join(leg(vector, "v"), ["query_id", "id"], "full")
    s = both.select("query_id", "id", F.round(alpha * F.coalesce("v", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0)), DIGITS).alias("score"))
    w = q.orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dedup_texts(hits: DataFrame, k: int = 50) -> DataFrame:
    """The best of equal stripped texts per query, then the k best; (query_id, id, score, rank, text) in and out."""
    first = Window.partitionBy("query_id", F.md5(ustrip(F.coalesce("text", F.lit(""))))).orderBy("rank")
    again = Window.partitionBy("query_id").orderBy("rank")
    d = hits.withColumn("f", F.row_number().over(first)).where("f = 1").drop("f")
    return d.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def log_signal(c: Column, cap: float) -> Column:
    x = F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    return F.when(x <= 1, F.lit(0.0)).otherwise(F.least(F.ln(x) / F.ln(F.lit(cap)), F.lit(1.0)))


def recency(ts: Column, reference: Column) -> Column:
    age = F.greatest((reference - ts) / F.lit(86400.0), F.lit(0.0))
    return F.when(ts.isNull() | (reference <= 0), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -age / 730))


SIGNALS = ("position", "vote_signal", "volume_signal", "recency_signal", "agreed", "thanked")


def with_signals(hits: DataFrame, cap: int = 3) -> DataFrame:
    """Hits with their ranking signals, at most ``cap`` a thread; rows without a thread are never capped.

    ``hits``: (query_id, id, rank, link_id, comment_score, post_score,
    num_comments, created_utc, agreement_count, thanks_count).  Positions and
    the reference time come from all hits, before the cap.
    """
    q = Window.partitionBy("query_id")
    thread = Window.partitionBy("query_id", "link_id").orderBy("rank")
    d = hits.withColumn("total", F.count("*").over(q)).withColumn("reference", F.coalesce(F.max("created_utc").over(q), F.lit(0)))
    d = d.withColumn("in_thread", F.row_number().over(thread)).where(F.col("link_id").isNull() | (F.col("in_thread") <= cap))
    position = F.when(F.col("total") <= 1, F.lit(1.0)).otherwise((F.col("total") - F.col("rank")) / (F.col("total") - 1))
    present = lambda c: (F.coalesce(c, F.lit(0)) > 0).cast("double")
    signals = (position, log_signal(F.coalesce("comment_score", "post_score"), 1500.0), log_signal(F.col("num_comments"), 2000.0), recency(F.col("created_utc"), F.col("reference")), present("agreement_count"), present("thanks_count"))
    return d.select("query_id", "id", "rank", "link_id", *(c.alias(n) for c, n in zip(signals, SIGNALS, strict=True)))


def rank_results(hits: DataFrame, weights: tuple, cap: int = 3, final: int = 25) -> DataFrame:
    """Blend rank position with signals; the ``final`` best of each query, ties in the order of ``rank``."""
    return tournament(hits, {"": weights}, cap=cap, final=final).drop("config")


def tournament(hits: DataFrame, configs: dict[str, tuple] | None = None, *, only: dict[str, set[str]] | None = None, cap: int = 3, final: int = 25) -> DataFrame:
    """Every weight set over the same hits, which are made once; ``only`` limits a set to some queries."""
    sets = configs or WEIGHTS
    rows = [F.struct(F.lit(name).alias("config"), *(F.lit(float(w)).alias(f"w{i}") for i, w in enumerate(ws)), (F.array(*map(F.lit, sorted(only[name]))) if only and name in only else F.lit(None).cast("array<string>")).alias("queries")) for name, ws in sets.items()]
    d = with_signals(hits, cap).withColumn("s", F.explode(F.array(*rows)))
    d = d.where(F.col("s.queries").isNull() | F.array_contains("s.queries", F.col("query_id").cast("string")))
    blended = sum((F.col(f"s.w{i}") * F.col(c) for i, c in enumerate(SIGNALS)), F.lit(0.0))
    d = d.select("s.config", "query_id", "id", "rank", "link_id", F.round(blended, DIGITS).alias("final_score"))
    order = Window.partitionBy("config", "query_id").orderBy(F.desc("final_score"), "rank")
    return d.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= final)


def one_config(hits: DataFrame, name: str, query_ids: list[str]) -> DataFrame:
    """One weight set for some queries, with the movement against the hits' order."""
    some = hits.where(F.col("query_id").isin(*query_ids))
    ranked = tournament(some, {name: WEIGHTS[name]})
    return movement(some, ranked).join(ranked.select("query_id", "id", "config", "final_score"), ["query_id", "id"])


def result_fields(objects: DataFrame) -> DataFrame:
    """Stored objects as results: missing texts are empty, missing counts 0, missing flags false; addresses and times stay null."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return objects.select("chunk_id", text("text"), text("chunk_type"), text("post_title"), "post_summary", "permalink", "link_id", "comment_score", "post_score", number("num_comments"), number("agreement_count"), number("thanks_count"), number("nest_level"), F.coalesce("stickied", F.lit(False)).alias("stickied"), "created_utc")


def rerank(hits: DataFrame, score: Column | None, top: int = 50, budget_ok: Column | None = None) -> DataFrame:
    """The ``top`` hits of each query in the order of a scorer, ties in the order they had.

    Without a scorer, or where ``budget_ok`` is false for a row of the query (a
    scorer that took too long), the query keeps the order it had.
    """
    q = Window.partitionBy("query_id")
    d = hits.where(F.col("rank") <= top)
    s = score if score is not None else F.lit(None).cast("double")
    d = d.withColumn("rerank_score", F.round(s, DIGITS))
    kept = F.min(budget_ok if budget_ok is not None else F.lit(score is not None)).over(q)
    d = d.withColumn("reranked", kept & (F.count("rerank_score").over(q) == F.count("*").over(q)))
    order = q.orderBy(F.when(F.col("reranked"), -F.col("rerank_score")).otherwise(0.0), "rank")
    return d.withColumn("old_rank", F.col("rank")).withColumn("rank", F.row_number().over(order)).withColumn("rerank_score", F.when(F.col("reranked"), F.col("rerank_score")))


def retrieve(keyword: DataFrame, vector: DataFrame, objects: DataFrame, score: Column | None, weights: tuple, *, first: int = 75, distinct: int = 50, top: int = 50, final: int = 25, alpha: float = 0.8, queries: DataFrame | None = None) -> DataFrame:
    """Search, rerank and rank in one plan: both legs fused, equal texts once, the scorer's order, signals and thread cap.

    ``queries``: (query_id, query), for a scorer that looks at the query.
    """
    found = fuse(keyword, vector, alpha, first)
    hits = dedup_texts(found.join(objects, F.col("id") == F.col("chunk_id")), distinct)
    if queries is not None:
        hits = hits.join(queries.select("query_id", "query"), "query_id")
    ranked = rerank(hits, score, top)
    return rank_results(ranked, weights, final=final).join(ranked.select("query_id", "id", F.col("score").alias("hybrid_score"), "rerank_score"), ["query_id", "id"])


def apart_words(hay: Column) -> Column:
    """A lower-cased text with single spaces for all but ASCII letters and digits, and at both ends."""
    return F.concat(F.lit(" "), F.regexp_replace(hay, "[^a-z0-9]", " "), F.lit(" "))


def term_hits(terms: Column, hay: Column, apart: Column) -> Column:
    """How many of the terms occur in a lower-cased text; ``apart``: its :func:`apart_words`.

    A term with a space, or a longer word, may occur anywhere; one of up to
    four characters or in capitals has to stand apart from letters and digits.
    """

    def hit(t: Column) -> Column:
        s = F.trim(t)
        low = F.lower(s)
        strict = ~F.contains(s, F.lit(" ")) & ((F.length(s) <= 4) | ((F.upper(s) == s) & (F.lower(s) != s)))
        return (s != "") & F.when(strict, F.contains(apart, F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9]", " "), F.lit(" ")))).otherwise(F.contains(hay, low))

    return F.size(F.filter(F.coalesce(terms, F.array().cast("array<string>")), hit))


def candidates(chunks: DataFrame, queries: DataFrame, k: int = 25) -> DataFrame:
    """(query_id, chunk_id, link, hits, score, rank): term hits * 10000 + vote, the k best a query.

    A title that hints at the query's category counts as one hit.  The query
    set is broadcast: a few dozen rows by its definition.
    """
    hay = F.lower(F.concat_ws("\n", F.coalesce("post_title", F.lit("")), F.coalesce("post_summary", F.lit("")), F.coalesce("text", F.lit(""))))
    title = F.coalesce("post_title", F.lit(""))
    vote = F.when(F.col("chunk_type") == "comment", F.coalesce("comment_score", F.lit(0))).otherwise(F.coalesce("post_score", F.lit(0)))
    link = F.coalesce("link_id", F.when(F.col("chunk_type") == "post", F.concat(F.lit("t3_"), F.split("chunk_id", "_")[1])), "chunk_id")
    c = chunks.select("chunk_id", hay.alias("hay"), apart_words(hay).alias("apart"), vote.alias("vote"), link.alias("link"), title.rlike(EMOTIONAL_TITLE).alias("emo"), title.rlike(BENEFITS_TITLE).alias("ben"))
    s = c.crossJoin(F.broadcast(queries.select("query_id", "category", "expected_terms")))
    hinted = (F.col("category") == "emotional") & F.col("emo") | (F.col("category") == "benefits") & F.col("ben")
    s = s.withColumn("hits", term_hits(F.col("expected_terms"), F.col("hay"), F.col("apart"))).withColumn("hits", F.when((F.col("hits") == 0) & hinted, 1).otherwise(F.col("hits"))).where("hits > 0")
    s = s.select("query_id", "chunk_id", "link", "hits", (F.col("hits") * 10000 + F.col("vote")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def link_cap(found: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` candidates of one thread a query, after the top k; a cap of 0 or less is none."""
    if cap <= 0:
        return found
    w = Window.partitionBy("query_id", "link").orderBy("rank")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")


def positives(found: DataFrame, most: int) -> DataFrame:
    """Best score of each chunk over all queries, the ``most`` highest."""
    return found.groupBy("chunk_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(most)


def stratum() -> Column:
    vote = F.coalesce(F.nullif("comment_score", F.lit(0)), "post_score", F.lit(0))
    bucket = F.when(vote <= 0, "low").when(vote <= 10, "mid").otherwise("high")
    return F.concat_ws("|", "chunk_type", bucket, F.coalesce(F.year(F.timestamp_seconds("created_utc")).cast("string"), F.lit("unknown")))


def allocation(pool: DataFrame, need: Column | DataFrame) -> DataFrame:
    """(stratum, size, target): largest remainders, ties by key descending; a pool of fewer rows raises.

    ``need``: how many rows, as a constant or as one row (need).

    Strata are few (kinds x buckets x years), so the window over them is small.
    """
    s = pool.groupBy("stratum").agg(F.count("*").alias("size"))
    if isinstance(need, DataFrame):
        s, need = s.crossJoin(F.broadcast(need)), F.col("need")
    every = Window.partitionBy()
    d = s.withColumn("total", F.sum("size").over(every)).withColumn("raw", need * F.col("size") / F.col("total")).withColumn("floor", F.floor("raw"))
    d = d.withColumn("left", need - F.sum("floor").over(every)).withColumn("pos", F.row_number().over(every.orderBy(F.desc(F.round(F.col("raw") - F.col("floor"), 12)), F.desc("stratum"))))
    target = (F.col("floor") + (F.col("pos") <= F.col("left")).cast("long")).cast("long")
    short = F.raise_error(F.lit("the pool has fewer rows than are needed")).cast("long")
    return d.select("stratum", "size", F.when(F.col("total") < need, short).otherwise(target).alias("target"))


def seeded(key: str, seed: int) -> Column:
    """A pseudo-random order of rows that depends on their key and a seed alone."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_sample(pool: DataFrame, need: Column | DataFrame, seed: int = 42) -> DataFrame:
    """Rows of ``pool`` (with ``stratum`` and ``chunk_id``) by allocation, chosen in the order of a seeded hash."""
    w = Window.partitionBy("stratum").orderBy(seeded("chunk_id", seed), "chunk_id")
    a = allocation(pool, need).select("stratum", "target")
    return pool.withColumn("n", F.row_number().over(w)).join(F.broadcast(a), "stratum").where("n <= target").drop("n", "target")


def retrieval_metrics(judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, category, ndcg, mrr) of (query_id, category, rank, rel), rel 1 to 3.

    Linear gain; the ideal order is that of the retrieved list itself; the
    first rel of 2 or more counts for mrr.
    """
    d = judged.where(F.col("rank") <= k)
    best = Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank")
    d = d.withColumn("ideal", F.row_number().over(best))
    g = d.groupBy("query_id", "category").agg(F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("rel") / F.log2(F.col("ideal") + 1)).alias("idcg"), F.min(F.when(F.col("rel") >= 2, F.col("rank"))).alias("first"))
    return g.select("query_id", "category", F.round(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0), 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))


def by_category(metrics: DataFrame) -> DataFrame:
    """Means overall (category ``all``) and by category."""
    return metrics.rollup("category").agg(F.count("*").alias("n"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("mrr"), 6).alias("mrr")).select(F.coalesce(F.col("category").cast("string"), F.lit("all")).alias("category"), "n", "ndcg", "mrr")


def diversity(ranked: DataFrame, top: int = 10) -> DataFrame:
    """Distinct threads in the first ``top`` and in all results of each query."""
    t = F.coalesce("link_id", "id")
    return ranked.groupBy("query_id").agg(F.countDistinct(F.when(F.col("final_rank") <= top, t)).alias("threads_top"), F.countDistinct(t).alias("threads_all"))


def movement(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, id, old_rank, new_rank, moved); a missing rank is -1 and moves nothing."""
    a, b = before.select("query_id", "id", F.col("rank").alias("old_rank")), after.select("query_id", "id", F.col("final_rank").alias("new_rank"))
    j = a.join(b, ["query_id", "id"], "full").select("query_id", "id", F.coalesce("old_rank", F.lit(-1)).alias("old_rank"), F.coalesce("new_rank", F.lit(-1)).alias("new_rank"))
    return j.withColumn("moved", F.when((F.col("old_rank") > 0) & (F.col("new_rank") > 0), F.col("old_rank") - F.col("new_rank")).otherwise(0))
