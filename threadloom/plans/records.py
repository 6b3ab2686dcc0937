"""Queries of derived fields, index properties and judge aggregates, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import records as X
from threadloom.runtime import table


def _chunks(s, d):
    return table(s, d, "chunk_metadata").dropDuplicates(["chunk_id"])


def chunk_profile(s, d):
    return X.chunk_profile(_chunks(s, d))


def _scores(s, d):
    return table(s, d, "comments").select(F.coalesce("distinguished", F.lit("none")).alias("model"), F.when(F.col("is_submitter"), "grounded").otherwise("helpful").alias("criterion"), F.col("score").cast("double").alias("raw"))


def a13_judge_means(s, d):
    return X.judge_means(_scores(s, d))


def j18_judge_deltas(s, d):
    m = X.judge_means(_scores(s, d).withColumn("model", F.lit("all"))).select("criterion", "mean_valid")
    n = X.judge_means(_scores(s, d).where("model = 'none'").withColumn("model", F.lit("all"))).select("criterion", "mean_valid")
    return X.metric_deltas(m, n, "criterion", "mean_valid")


def u1_all_chunks(s, d):
    c = _chunks(s, d)
    a = c.where("chunk_type = 'comment'").select("chunk_id", "chunk_type", "comment_score", "link_id")
    b = c.where("chunk_type = 'post'").select("chunk_id", "chunk_type", "post_score")
    return a.unionByName(b, allowMissingColumns=True)


QUERIES = {f.__name__: f for f in (chunk_profile, a13_judge_means, j18_judge_deltas, u1_all_chunks)}
_CH = "with ch as (select distinct on (chunk_id) * from chunk_metadata) "
_MEANS = "x as (select coalesce(distinguished, 'none') as model, case when is_submitter then 'grounded' else 'helpful' end as criterion, case when score between 1 and 5 then score::int else 0 end as s from comments)"
SQL = {
    "chunk_profile": _CH + """select chunk_id, case when chunk_type = 'post' then coalesce(post_score, 0) else coalesce(comment_score, 0) end as vote,
 coalesce(link_id, case when chunk_type = 'post' then 't3_' || string_split(chunk_id, '_')[2] end, chunk_id) as root_id, coalesce(year(t)::varchar, 'unknown') as year, strftime(t, '%Y-%m') as month,
 chunk_type || '|' || case when v <= 0 then 'low' when v <= 10 then 'mid' else 'high' end || '|' || coalesce(year(t)::varchar, 'unknown') as stratum, strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') as created_iso
 from (select *, make_timestamp(created_utc * 1000000) as t, coalesce(nullif(comment_score, 0), post_score, 0) as v from ch)""",
    "a13_judge_means": f"with {_MEANS} select model, criterion, round(avg(s), 6) as mean_all, round(avg(case when s > 0 then s end), 6) as mean_valid, count(*) filter (where s = 0) as n_failed from x group by all",
    "j18_judge_deltas": f"with {_MEANS}, a as (select criterion, round(avg(case when s > 0 then s end), 6) as before from x group by 1), b as (select criterion, round(avg(case when s > 0 then s end), 6) as after from x where model = 'none' group by 1) select criterion, before, after, round(after - before, 6) as delta from a join b using (criterion)",
    "u1_all_chunks": _CH + "select chunk_id, chunk_type, case when chunk_type = 'comment' then comment_score end as comment_score, case when chunk_type = 'comment' then link_id end as link_id, case when chunk_type = 'post' then post_score end as post_score from ch",
}
