"""Queries of gates, profiles and chunking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import WS_SQL, shorten
from threadloom.operators import chunking as C
from threadloom.operators import gates as G
from threadloom.operators.hierarchy import resolve_hierarchy
from threadloom.runtime import spread, table


def _c(s, d):
    return table(s, d, "comments")


def _wide(s, d):
    """Comments over all cores: the reply rules and chunking cost far more than moving the rows."""
    return spread(_c(s, d))


def _p(s, d):
    return table(s, d, "posts")


def _m(s, d):
    return table(s, d, "chunk_metadata")


def f1_exclusion_reason(s: SparkSession, d: str) -> DataFrame:
    return G.exclusion_histogram(_c(s, d), G.exclusion_reason())


def f2_post_exclusion(s, d):
    return G.exclusion_histogram(_p(s, d), G.post_exclusion_reason())


def f5_f6_reply_classes(s, d):
    return G.with_reply_flags(_wide(s, d).select("body", G.parent_type().alias("parent_kind"))).groupBy("agrees", "thanks", "parent_kind").agg(F.count("*").alias("n"))


def a1_social_signals(s, d):
    return G.social_signals(_wide(s, d))


def a11_signal_parents(s, d):
    g = G.social_signals(_wide(s, d))
    return g.agg(F.count_if(F.col("agreement_count") >= 1).alias("agreed"), F.count_if(F.col("agreement_count") >= 2).alias("agreed_twice"), F.count_if(F.col("thanks_count") >= 1).alias("thanked"), F.count_if(F.col("thanks_count") >= 2).alias("thanked_twice"))


def a2_gate_metrics(s, d):
    return G.gate_metrics(_wide(s, d))


def a3_short_buckets(s, d):
    return G.short_buckets(_wide(s, d))


def a4_word_quantiles(s, d):
    return G.quantiles(_c(s, d), C.word_count(F.col("body")))


_FIELDS = ["id", "body", "author", "score", "created_utc", "parent_id", "link_id"]


def a5_field_presence(s, d):
    return G.field_presence(_c(s, d), _FIELDS)


def a6_thread_structure(s, d):
    return G.thread_structure(_c(s, d))


def a7_month_counts(s, d):
    return G.month_counts(_c(s, d))


def w1_gap_flags(s, d):
    return G.gap_flags(G.month_counts(_p(s, d)))


def j17_coverage(s, d):
    return G.coverage(_p(s, d), _c(s, d))


def w8_samples(s, d):
    reason = F.coalesce(G.exclusion_reason(), F.lit("keep"))
    one = _c(s, d).groupBy("id").agg(F.min_by("body", F.struct("ingested_at", "score")).alias("body"), F.min("distinguished").alias("distinguished"), F.min("score").alias("score"))
    return G.samples_per_class(one, reason, [F.col("id")], 5).select(F.col("class").alias("reason"), "rank", "id", shorten(F.col("body"), 80).alias("preview"))


def x2_comment_chunks(s, d):
    return C.comment_chunks(_wide(s, d), _p(s, d)).select("chunk_id", F.md5("text").alias("text_md5"), "post_title", "comment_score", "agreement_count", "thanks_count", "link_id", "chunk_index", "total_chunks", "word_count")


def x3_post_chunks(s, d):
    return C.post_chunks(_p(s, d), _wide(s, d)).select("chunk_id", F.md5("text").alias("text_md5"), "post_title", "post_score", "num_comments", "agreement_count", "thanks_count", "chunk_index", "total_chunks", "word_count")


def a9_chunk_stats(s, d):
    return C.chunk_stats(C.comment_chunks(_wide(s, d), _p(s, d)))


def j5_parent_sentences(s, d):
    return C.parent_sentences(_wide(s, d))


def a10_depth_histogram(s, d):
    r = resolve_hierarchy(_c(s, d))
    found = F.when(F.col("root_id").startswith("t3_") & (F.col("node_depth") > 0), F.col("node_depth"))
    return r.groupBy(C.depth_bucket(found).alias("bucket")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (f1_exclusion_reason, f2_post_exclusion, f5_f6_reply_classes, a1_social_signals, a11_signal_parents, a2_gate_metrics, a3_short_buckets, a4_word_quantiles, a5_field_presence, a6_thread_structure, a7_month_counts, w1_gap_flags, j17_coverage, w8_samples, x2_comment_chunks, x3_post_chunks, a9_chunk_stats, j5_parent_sentences, a10_depth_histogram)}


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{WS_SQL}+'), lambda x: x <> '')"


def _listed(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def _class(phrases, exact, openers, empty: str) -> str:
    return f"""case when t = '' then {empty} when list_bool_or(list_transform({_listed(phrases)}, lambda p: contains(t, p))) then true
      when clean = '' then {empty} when list_contains({_listed(exact)}, clean) then true
      else len(cw) <= 5 and list_contains({_listed(openers)}, cw[1]) end"""


_BASE = rf"""
with c0 as (select *, {_strip("coalesce(body, '')")} as b, len({_tokens("body")}) as wc from comments),
c1 as (select *, lower(b) as t, {_strip(f"regexp_replace(lower(b), '[^\\p{{L}}\\p{{N}}_{WS_SQL[1:-1]}]', '', 'g')")} as clean from c0),
c2 as (select *, {_tokens("clean")} as cw,
  case when b = '' then 'empty' when b = '[deleted]' then 'deleted' when b = '[removed]' then 'removed' when distinguished = 'moderator' then 'moderator' when coalesce(score, 0) < 0 then 'negative_score' end as reason,
  case when starts_with(parent_id, 't3_') then 't3' when starts_with(parent_id, 't1_') then 't1' else 'unknown' end as parent_kind from c1),
c as (select *, {_class(G.AGREEMENT_PHRASES, G.AGREEMENT_EXACT, G.AGREEMENT_OPENERS, "true")} as a, {_class(G.THANKS_PHRASES, G.THANKS_EXACT, G.THANKS_OPENERS, "false")} as th from c2),
sig as (select parent_id, sum(a::int)::bigint as agreement_count, sum(th::int)::bigint as thanks_count from c where reason is null and wc < 25 and parent_id <> '' group by 1 having sum(a::int) > 0 or sum(th::int) > 0),
p0 as (select *, {_strip("coalesce(selftext, '')")} as b from posts),
p as (select *, case when not coalesce(is_self, true) then 'not_self' when b = '' then 'empty' when b = '[deleted]' then 'deleted' when b = '[removed]' then 'removed' when distinguished = 'moderator' then 'moderator' end as reason from p0)
"""
_MONTH = "strftime(make_timestamp(created_utc * 1000000), '%Y-%m')"
_WINDOWS = "(select unnest(range(0, greatest(n - 30, 1), 270)) as i)"


def _chunks(src: str, text: str, prefix: str, cols: str) -> str:
    return f"""w as (select *, {_tokens(text)} as words from {src}), n as (select *, len(words) as n from w),
e as (select *, unnest(range(0, greatest(n - 30, 1), 270)) as i from n),
ch as (select *, (i / 270)::int as chunk_index, ceil(greatest(n - 30, 1) / 270.0)::int as total_chunks, words[i + 1 : i + 300] as part from e)
select '{prefix}' || id || '_' || chunk_index as chunk_id, md5(case when total_chunks = 1 then {_strip(text)} else array_to_string(part, ' ') end) as text_md5, {cols}, chunk_index, total_chunks, len(part)::int as word_count from ch"""


_COMMENT_SRC = """, tt as (select id as pid, arg_max(title, struct_pack(ingested_at, title)) as post_title from posts group by 1),
src as (select c.* exclude (a, th, t, clean, cw, b, wc), coalesce(tt.post_title, '') as post_title, coalesce(c.score, 0) as comment_score, coalesce(sig.agreement_count, 0) as agreement_count, coalesce(sig.thanks_count, 0) as thanks_count
  from c left join tt on regexp_replace(c.link_id, '^t3_', '') = tt.pid left join sig on sig.parent_id = 't1_' || c.id where reason is null and wc >= 25), """
_COMMENT_CHUNKS = _BASE + _COMMENT_SRC + _chunks("src", "body", "t1_", "post_title, comment_score, agreement_count, thanks_count, link_id")
_FIELD_ROWS = " union all ".join(f"select '{f}' as field, count(*) filter (where {_strip(f'{f}::varchar')} <> '')::bigint as present, count(*) filter (where {_strip(f'{f}::varchar')} in ('[deleted]', '[removed]'))::bigint as sentinel, count(*) as n from comments" for f in _FIELDS)
_J = "array_to_string(list_filter([{}], lambda x: x is not null), chr(10) || chr(10))"


def _sentence(x: str) -> str:
    t = _strip(f"regexp_replace(coalesce({x}, ''), '{WS_SQL}+', ' ', 'g')")
    cut = lambda m: f"when instr({t}, '{m}') > 0 then left({t}, least(instr({t}, '{m}'), 280)::int)"
    return f"case {cut('. ')} {cut('! ')} {cut('? ')} else left({t}, 280) end"


SQL = {
    "f1_exclusion_reason": _BASE + "select coalesce(r, 'all') as reason, count(*) as n from (select coalesce(reason, 'keep') as r from c) group by rollup (r)",
    "f2_post_exclusion": _BASE + "select coalesce(r, 'all') as reason, count(*) as n from (select coalesce(reason, 'keep') as r from p) group by rollup (r)",
    "f5_f6_reply_classes": _BASE + "select a as agrees, th as thanks, parent_kind, count(*) as n from c group by all",
    "a1_social_signals": _BASE + "select * from sig",
    "a11_signal_parents": _BASE + "select count(*) filter (where agreement_count >= 1) as agreed, count(*) filter (where agreement_count >= 2) as agreed_twice, count(*) filter (where thanks_count >= 1) as thanked, count(*) filter (where thanks_count >= 2) as thanked_twice from sig",
    "a2_gate_metrics": _BASE + "select count(*) as n, count(*) filter (where coalesce(score, 0) >= 0) as pass_score, count(*) filter (where wc >= 25) as pass_length, count(*) filter (where wc >= 25 and coalesce(score, 0) >= 0) as pass_both, count(*) filter (where wc < 25 and a) as agreement, count(*) filter (where wc < 25 and th) as thanks, count(*) filter (where wc < 25 and a and th) as both_signals from c",
    "a3_short_buckets": _BASE + "select case when wc <= 5 then '0-5' when wc <= 15 then '6-15' else '16-24' end as bucket, parent_kind, count(*) as n, count(*) filter (where a) as agreement, count(*) filter (where th) as thanks from c where wc < 25 group by all",
    "a4_word_quantiles": _BASE + "select count(*) as n, min(wc)::bigint as least, max(wc)::bigint as most, " + ", ".join(f"round(quantile_cont(wc, {q}), 6) as p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9, 0.95)) + " from c",
    "a5_field_presence": _FIELD_ROWS,
    "a6_thread_structure": _BASE + "select count(*) filter (where parent_kind = 't3') as t3_parents, count(*) filter (where parent_kind = 't1') as t1_parents, count(*) filter (where parent_kind = 'unknown') as unknown_parents, count(*) filter (where coalesce(starts_with(link_id, 't3_'), false)) as t3_links, count(*) filter (where not coalesce(starts_with(link_id, 't3_'), false)) as other_links from c",
    "a7_month_counts": f"select {_MONTH} as month, count(*) as n from comments where created_utc is not null group by 1",
    "w1_gap_flags": f"with m as (select {_MONTH} as month, count(*) as n from posts where created_utc is not null group by 1), l as (select *, lag(n) over (order by month) as previous from m) select month, n, previous, coalesce((previous - n) / previous > 0.5, false) as flagged from l",
    "j17_coverage": f"with a as (select {_MONTH} as month, count(*) as n from posts where created_utc is not null group by 1), b as (select {_MONTH} as month, count(*) as n from comments where created_utc is not null group by 1) select coalesce(a.month, b.month) as month, coalesce(a.n, 0) as n_posts, coalesce(b.n, 0) as n_comments from a full join b on a.month = b.month",
    "x2_comment_chunks": _COMMENT_CHUNKS,
    "x3_post_chunks": _BASE + ", src as (select p.* exclude (num_comments, b), coalesce(p.title, '') as post_title, coalesce(p.score, 0) as post_score, coalesce(p.num_comments, 0) as num_comments, coalesce(sig.agreement_count, 0) as agreement_count, coalesce(sig.thanks_count, 0) as thanks_count from p left join sig on sig.parent_id = 't3_' || p.id where reason is null), " + _chunks("src", "selftext", "t3_", "post_title, post_score, num_comments, agreement_count, thanks_count"),
    "a9_chunk_stats": f"with x as ({_COMMENT_CHUNKS}) select count(*) filter (where chunk_index = 0) as n_records, count(*) as n_chunks, count(*) filter (where chunk_index = 0 and total_chunks = 1) as n_single, count(*) filter (where chunk_index = 0 and total_chunks > 1) as n_multi, max(total_chunks) as max_chunks, round(count(*) / count(*) filter (where chunk_index = 0), 3) as avg_chunks from x",
    "j5_parent_sentences": f"with o as (select id, min(parent_id) as parent_id, min(body) as body from comments group by id) select o.id, {_sentence('q.body')} as parent_first_sentence from o join o q on o.parent_id = 't1_' || q.id",
    "a10_depth_histogram": "with recursive c as (select id, min(parent_id) parent_id from comments group by id), walk as (select id, parent_id as root, 1 as depth from c where parent_id like 't3\\_%' escape '\\' union all select c.id, walk.root, walk.depth + 1 from walk join c on c.parent_id = 't1_' || walk.id) select case when depth is null then 'unknown' when depth >= 4 then '4+' else depth::varchar end as bucket, count(*) as n from c left join walk using (id) group by 1",
    "w8_samples": f"""with o as (select id, arg_min(body, struct_pack(ingested_at, score)) as body, min(distinguished) as distinguished, min(score) as score from comments group by id),
r as (select *, {_strip("coalesce(body, '')")} as b from o), k as (select *, case when b = '' then 'empty' when b = '[deleted]' then 'deleted' when b = '[removed]' then 'removed' when distinguished = 'moderator' then 'moderator' when coalesce(score, 0) < 0 then 'negative_score' else 'keep' end as reason from r),
n as (select *, row_number() over (partition by reason order by id nulls first)::int as rank from k)
select reason, rank, id, case when length(body) > 80 then left(replace(body, chr(10), ' '), 80) || '…' else replace(body, chr(10), ' ') end as preview from n where rank <= 5""",
}
