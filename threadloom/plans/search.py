"""Queries of retrieval, evaluation and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions.providers import embed, lexical_score
from threadloom.functions.text import WS_SQL, first_sentence
from threadloom.operators import answers as A
from threadloom.operators import retrieval as R
from threadloom.plans.ingestion import _strip
from threadloom.runtime import spread, table

FORUM = "longhaul_example"


def _chunks(s, d):
    return table(s, d, "chunk_metadata").dropDuplicates(["chunk_id"])  # rows that repeat a chunk are identical


def _golden(s, d):
    return table(s, d, "golden_queries").withColumnRenamed("id", "query_id")


def _docs(s, d):
    return _chunks(s, d).select(F.col("chunk_id").alias("id"), F.concat_ws(" ", "post_title", "text").alias("text"))


def r1_bm25(s, d):
    return R.bm25(_docs(s, d), _golden(s, d), 10)


def _hits(s, d, k=75):
    """BM25 hits with chunk fields, equal texts once."""
    found = R.bm25(_docs(s, d), _golden(s, d), k)
    full = found.join(_chunks(s, d), F.col("id") == F.col("chunk_id"))
    return R.dedup_texts(full, 50)


def w4_exact_dedup(s, d):
    return _hits(s, d).select("query_id", "id", "score", "rank")


def _legs(s, d):
    q = _golden(s, d)
    v = embed(spread(_chunks(s, d).withColumnRenamed("chunk_id", "id")), "id", "text")
    return R.bm25(_docs(s, d), q), R.cosine_top_k(v, embed(q, "query_id", "query"), 75)


def r1_hybrid(s, d):
    return R.fuse(*_legs(s, d)).select("query_id", "id", "score", "rank")


def _lexical():
    return F.round(lexical_score(F.col("query"), F.concat_ws(" ", "post_title", "text")), 6)


def r4_rerank(s, d):
    h = _hits(s, d).join(F.broadcast(_golden(s, d).select("query_id", "query")), "query_id")
    return R.rerank(h, _lexical()).select("query_id", "id", "old_rank", "rank", "rerank_score")


def r4_fallback(s, d):
    """Queries of which a hit took too long (here: a long text) keep their order."""
    h = _hits(s, d).join(F.broadcast(_golden(s, d).select("query_id", "query")), "query_id")
    return R.rerank(h, _lexical(), budget_ok=F.length("text") < 1500).select("query_id", "id", "old_rank", "rank", "rerank_score", "reranked")


def r2_result_fields(s, d):
    return R.result_fields(_chunks(s, d)).drop("text")


def r6_retrieve(s, d):
    keyword, vector = _legs(s, d)
    return R.retrieve(keyword, vector, _chunks(s, d), _lexical(), R.WEIGHTS["B_rank_dominant"], queries=_golden(s, d)).select("query_id", "id", "rank", "hybrid_score", "rerank_score", "final_score", "final_rank")


def r14_one_config(s, d):
    return R.one_config(_hits(s, d), "C_community_dominant", ["q01", "q02"])


def r13_tournament(s, d):
    return R.tournament(_hits(s, d)).select("config", "query_id", "id", "rank", "final_score", "final_rank")


def a15_diversity(s, d):
    return R.diversity(R.rank_results(_hits(s, d), R.WEIGHTS["B_rank_dominant"]))


def j16_movement(s, d):
    h = _hits(s, d)
    return R.movement(h, R.rank_results(h, R.WEIGHTS["C_community_dominant"]))


def tk1_candidates(s, d):
    return R.candidates(_chunks(s, d), _golden(s, d)).select("query_id", "chunk_id", "link", "hits", "score", "rank")


def w3_link_cap(s, d):
    return R.link_cap(R.candidates(_chunks(s, d), _golden(s, d)), 2).select("query_id", "chunk_id", "rank")


def w5_positives(s, d):
    return R.positives(R.candidates(_chunks(s, d), _golden(s, d)), 100)


def _pool(s, d):
    pos = R.positives(R.candidates(_chunks(s, d), _golden(s, d)), 100)
    return _chunks(s, d).join(pos, "chunk_id", "left_anti").withColumn("stratum", R.stratum())


def tk6_allocation(s, d):
    return R.allocation(_pool(s, d), F.lit(50))


def tk6_sample(s, d):
    return R.stratified_sample(_pool(s, d), F.lit(50)).select("chunk_id", "stratum")


def tk2_cosine_topk(s, d):
    e = table(s, d, "embeddings")
    return R.cosine_top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")))


def _judged(s, d):
    e = table(s, d, "embeddings")
    top = tk2_cosine_topk(s, d)
    a, b = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("category")), e.select(F.col("vec_id").alias("id"), F.col("label").alias("found"))
    j = top.join(a, "query_id").join(b, "id")
    return j.withColumn("rel", F.when(F.col("category") == F.col("found"), 3).when(F.abs(F.col("category") - F.col("found")) == 1, 2).otherwise(1))


def r10_metrics(s, d):
    return R.retrieval_metrics(_judged(s, d))


def a12_by_category(s, d):
    return R.by_category(R.retrieval_metrics(_judged(s, d)))


def f11_input_gate(s, d):
    return table(s, d, "comments").select(A.gate_code(F.col("body")).alias("error_code")).groupBy("error_code").agg(F.count("*").alias("n"))


def context_packs(s, d):
    return A.pack_context(_hits(s, d), 5).select("query_id", F.md5("context").alias("context_md5"))


def _answers(s, d):
    top = _hits(s, d).where("rank <= 4")
    line = F.concat(first_sentence(F.col("text"), 80), F.lit(" ["), (F.col("rank") * 2 - 1).cast("string"), F.lit("]"))
    g = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))).alias("r"))
    return g.select("query_id", F.concat(F.lit("**Reports**\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("answer"))


def r18_sources(s, d):
    cited, _ = A.cited_sources(_answers(s, d), _hits(s, d).where("rank <= 5"), FORUM)
    return cited


def r18_orphans(s, d):
    _, lost = A.cited_sources(_answers(s, d), _hits(s, d).where("rank <= 5"), FORUM)
    return lost


def policy_split(s, d):
    b = A.policy_block(F.col("selftext"))
    one = table(s, d, "posts").groupBy("id").agg(F.min("selftext").alias("selftext"))
    return one.select("id", b.alias("b")).select("id", F.col("b.kind").alias("kind"), F.md5("b.policy").alias("policy_md5"), F.md5("b.body").alias("body_md5"))


def e6_pending(s, d):
    p = table(s, d, "posts")
    done = p.where("score > 5").select(F.col("id").alias("key"), F.when(F.col("num_comments") > 2, F.col("title")).alias("value"))
    return A.pending(p.select(F.col("id").alias("key")).distinct(), done)


QUERIES = {f.__name__: f for f in (r1_bm25, w4_exact_dedup, r1_hybrid, r2_result_fields, r4_rerank, r4_fallback, r6_retrieve, r14_one_config, r13_tournament, a15_diversity, j16_movement, tk1_candidates, w3_link_cap, w5_positives, tk6_allocation, tk6_sample, tk2_cosine_topk, r10_metrics, a12_by_category, f11_input_gate, context_packs, r18_sources, r18_orphans, policy_split, e6_pending)}

_TERMS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
_BM25 = f"""with ch as (select distinct on (chunk_id) * from chunk_metadata), t as (select chunk_id as id, {_TERMS.format("concat_ws(' ', post_title, text)")} as w from ch),
st as (select count(*) as n, avg(len(w)) as avg_len from t), q as (select id as query_id, unnest(list_distinct({_TERMS.format("query")})) as term from golden_queries),
x as (select id, len(w) as len, unnest(w) as term from t), post as (select term, id, len, count(*) as tf from x where term in (select term from q) group by all),
df as (select term, count(*) as df from post group by 1),
sc as (select query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) as score from post join df using (term) join q using (term), st group by all),
rk as (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from sc)
"""
_HITS = _BM25 + f""", h0 as (select rk.query_id, rk.id, rk.score, rk.rank as r0, ch.* from rk join ch on rk.id = ch.chunk_id where rk.rank <= 75),
h1 as (select *, row_number() over (partition by query_id, md5({_strip("text")}) order by r0) as f from h0),
h as (select *, rank_ as rank from (select *, row_number() over (partition by query_id order by r0)::int as rank_ from h1 where f = 1) where rank_ <= 50)
"""


_HASHED = """{n}t as (select id, unnest(list_filter(regexp_split_to_array(lower(coalesce(x, '')), '{ws}+'), lambda x: x <> '')) as w from {src}),
{n}v as (select id, ('0x' || left(md5(w), 4))::int % 64 as dim, sum(case when substr(md5(w), 5, 1) >= '8' then 1.0 else -1.0 end) as x from {n}t group by all),
{n}n as (select id, greatest(sqrt(sum(x * x)), 1e-12) as n from {n}v group by id)"""
_HYBRID = _BM25 + f""", {_HASHED.format(n="c", ws=WS_SQL, src="(select chunk_id as id, text as x from ch)")}, {_HASHED.format(n="q", ws=WS_SQL, src="(select id, query as x from golden_queries)")},
cos as (select q.id as query_id, c.id, round(sum(q.x / qn.n * (c.x / cn.n)), 9) as score from qv q join cv c using (dim) join qn on qn.id = q.id join cn on cn.id = c.id group by all),
vk as (select * from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from cos) where rank <= 75),
leg as (select query_id, id, 'b' as leg, score from rk where rank <= 75 union all select query_id, id, 'v', score from vk),
nrm as (select query_id, id, leg, case when max(score) over w = min(score) over w then 1.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as x from leg window w as (partition by query_id, leg)),
fu as (select * from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from (select query_id, id, round(0.8 * coalesce(sum(x) filter (where leg = 'v'), 0) + 0.2 * coalesce(sum(x) filter (where leg = 'b'), 0), 9) as score from nrm group by 1, 2)) where rank <= 75)
"""
_QT = "list_distinct(" + _TERMS.format("query") + ")"
_LEX = f"round(case when len({_QT}) > 0 then len(list_intersect({_QT}, {_TERMS.format("concat_ws(' ', post_title, text)")})) / len({_QT}) else 0 end, 6)"


def _reranked(hits: str, ok: str = "true") -> str:
    """Hits h (with rank) in the order of the lexical score, as table rr."""
    return f"""lx as (select {hits}.*, query, {_LEX} as lex from {hits} join (select id as gid, query from golden_queries) on gid = query_id), lb as (select *, bool_and({ok}) over (partition by query_id) as reranked from lx),
rr as (select * exclude (rank, lex), rank as old_rank, case when reranked then lex end as rerank_score, row_number() over (partition by query_id order by case when reranked then -lex else 0 end, rank)::int as rank from lb)"""


def _ranked(name: str, h: str = "h") -> str:
    a, b, c, r, g, t = R.WEIGHTS[name]
    log = lambda x, cap: f"case when coalesce({x}, 0) <= 1 then 0.0 else least(ln({x}) / ln({cap}), 1.0) end"
    return f"""select '{name}' as config, query_id, id, rank, link_id, final_score, final_rank from (select *, row_number() over (partition by query_id order by final_score desc, rank)::int as final_rank from (
select *, round({a} * case when total <= 1 then 1.0 else (total - rank) / (total - 1) end + {b} * {log("coalesce(comment_score, post_score)", 1500)} + {c} * {log("num_comments", 2000)}
 + {r} * case when created_utc is null or reference <= 0 then 0.0 else pow(2.0, -greatest((reference - created_utc) / 86400.0, 0) / 730) end + {g} * (coalesce(agreement_count, 0) > 0)::int + {t} * (coalesce(thanks_count, 0) > 0)::int, 9) as final_score
from (select *, count(*) over (partition by query_id) as total, coalesce(max(created_utc) over (partition by query_id), 0) as reference, row_number() over (partition by query_id, link_id order by rank) as th from {h}) where link_id is null or th <= 3)) where final_rank <= 25"""


_RE = lambda p: p.replace("'", "''")
_CAND = f"""with ch as (select distinct on (chunk_id) *, lower(concat_ws(chr(10), coalesce(post_title, ''), coalesce(post_summary, ''), coalesce(text, ''))) as hay from chunk_metadata),
q as (select id as query_id, category, unnest(expected_terms) as term from golden_queries), q0 as (select id as query_id, category from golden_queries),
m as (select query_id, chunk_id, count(*)::int as hits from ch join q on case when trim(term) = '' then false when not contains(trim(term), ' ') and (length(trim(term)) <= 4 or (upper(trim(term)) = trim(term) and lower(trim(term)) <> trim(term))) then regexp_matches(hay, '(^|[^a-z0-9])' || regexp_escape(lower(trim(term))) || '([^a-z0-9]|$)') else contains(hay, lower(trim(term))) end group by all),
hint as (select query_id, chunk_id, 1 as hits from ch, q0 where (category = 'emotional' and regexp_matches(coalesce(post_title, ''), '{_RE(R.EMOTIONAL_TITLE)}')) or (category = 'benefits' and regexp_matches(coalesce(post_title, ''), '{_RE(R.BENEFITS_TITLE)}'))),
al as (select * from m union all select * from hint where (query_id, chunk_id) not in (select (query_id, chunk_id) from m)),
sc as (select al.query_id, al.chunk_id, coalesce(link_id, case when chunk_type = 'post' then 't3_' || string_split(ch.chunk_id, '_')[2] end, ch.chunk_id) as link, al.hits, (al.hits * 10000 + case when chunk_type = 'comment' then coalesce(comment_score, 0) else coalesce(post_score, 0) end)::bigint as score from al join ch using (chunk_id)),
cand as (select * from (select *, row_number() over (partition by query_id order by score desc, chunk_id)::int as rank from sc) where rank <= 25),
pos as (select chunk_id, max(score) as score from cand group by 1 order by 2 desc, 1 limit 100)
"""
_COS = """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
n as (select vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) as v from e),
s as (select a.vec_id as query_id, b.vec_id as id, round(list_dot_product(a.v, b.v), 9) as score, a.label as category, b.label as found from n a, n b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
top as (select * from (select *, row_number() over (partition by query_id order by score desc, id)::int as rank from s) where rank <= 10),
j as (select *, case when category = found then 3 when abs(category - found) = 1 then 2 else 1 end as rel from top),
i as (select *, row_number() over (partition by query_id order by rel desc, rank) as ideal from j),
met as (select query_id, category, round(sum(rel / log2(rank + 1)) / sum(rel / log2(ideal + 1)), 6) as ndcg, round(coalesce(1.0 / min(case when rel >= 2 then rank end), 0.0), 6) as mrr from i group by all)
"""
_T = _strip("coalesce(body, '')")
_GATE = f"""select case when t = '' then 'query_empty' when length(t) > 8000 then 'query_too_long' when not regexp_matches(t, '[A-Za-z]{{3,}}') then 'query_nonsense'
 when {" or ".join(f"regexp_matches(t, '{p}')" for p in A.INJECTION)} then 'query_rejected_pattern' when regexp_matches(t, '{A.CONTROL}') then 'query_control_chars' else '' end as error_code, count(*) as n from (select {_T} as t from comments) group by 1"""
_T280 = _strip(f"regexp_replace(coalesce(text, ''), '{WS_SQL}+', ' ', 'g')")
_CUT = lambda m: f"when instr({_T280}, '{m}') > 0 then left({_T280}, least(instr({_T280}, '{m}'), 80)::int)"
_ANSWERS = _HITS + f""", an0 as (select query_id, '**Reports**' || chr(10) || string_agg((case {_CUT('. ')} {_CUT('! ')} {_CUT('? ')} else left({_T280}, 80) end) || ' [' || (rank * 2 - 1) || ']', chr(10) order by rank) as answer from h where rank <= 4 group by 1),
an as (select distinct query_id, answer, unnest(list_distinct(list_transform(regexp_extract_all(answer, '\\[(\\d{{1,9}})\\]', 1), lambda x: x::int))) as n from an0)"""
SQL = {
    "r1_bm25": _BM25 + "select query_id, id, score, rank from rk where rank <= 10",
    "r1_hybrid": _HYBRID + "select query_id, id, score, rank from fu",
    "r2_result_fields": "select distinct on (chunk_id) chunk_id, coalesce(chunk_type, '') as chunk_type, coalesce(post_title, '') as post_title, post_summary, permalink, link_id, comment_score, post_score, coalesce(num_comments, 0) as num_comments, coalesce(agreement_count, 0) as agreement_count, coalesce(thanks_count, 0) as thanks_count, coalesce(nest_level, 0) as nest_level, coalesce(stickied, false) as stickied, created_utc from chunk_metadata",
    "r4_rerank": _HITS + ", " + _reranked("h") + " select query_id, id, old_rank, rank, rerank_score from rr",
    "r4_fallback": _HITS + ", " + _reranked("h", "length(text) < 1500") + " select query_id, id, old_rank, rank, rerank_score, reranked from rr",
    "r6_retrieve": _HYBRID + f""", h0 as (select fu.query_id, fu.id, fu.score, fu.rank as r0, ch.* from fu join ch on fu.id = ch.chunk_id), h1 as (select *, row_number() over (partition by query_id, md5({_strip("text")}) order by r0) as f from h0),
h as (select * exclude (rank_), rank_ as rank from (select *, row_number() over (partition by query_id order by r0)::int as rank_ from h1 where f = 1) where rank_ <= 50), {_reranked("h")}, fin as ({_ranked("B_rank_dominant", "rr")})
select fin.query_id, fin.id, fin.rank, rr.score as hybrid_score, rr.rerank_score, final_score, final_rank from fin join rr on rr.query_id = fin.query_id and rr.id = fin.id""",
    "r14_one_config": _HITS + f""", g as (select * from h where query_id in ('q01', 'q02')), r as ({_ranked('C_community_dominant', 'g')})
select g.query_id, g.id, g.rank as old_rank, r.final_rank as new_rank, g.rank - r.final_rank as moved, config, final_score from g join r on g.query_id = r.query_id and g.id = r.id""",
    "w4_exact_dedup": _HITS + "select query_id, id, score, rank from h",
    "r13_tournament": _HITS + "select config, query_id, id, rank, final_score, final_rank from (" + " union all ".join(_ranked(n) for n in R.WEIGHTS) + ")",
    "a15_diversity": _HITS + f", r as ({_ranked('B_rank_dominant')}) select query_id, count(distinct coalesce(link_id, id)) filter (where final_rank <= 10) as threads_top, count(distinct coalesce(link_id, id)) as threads_all from r group by 1",
    "j16_movement": _HITS + f", r as ({_ranked('C_community_dominant')}) select h.query_id, h.id, h.rank as old_rank, coalesce(r.final_rank, -1) as new_rank, case when r.final_rank is not null then h.rank - r.final_rank else 0 end as moved from h left join r on h.query_id = r.query_id and h.id = r.id",
    "tk1_candidates": _CAND + "select query_id, chunk_id, link, hits, score, rank from cand",
    "w3_link_cap": _CAND + "select query_id, chunk_id, rank from (select *, row_number() over (partition by query_id, link order by rank) as n from cand) where n <= 2",
    "w5_positives": _CAND + "select * from pos",
    "tk6_allocation": _CAND + """, pool as (select chunk_type || '|' || case when v <= 0 then 'low' when v <= 10 then 'mid' else 'high' end || '|' || coalesce(year(make_timestamp(created_utc * 1000000))::varchar, 'unknown') as stratum
  from (select *, coalesce(nullif(comment_score, 0), post_score, 0) as v from ch where chunk_id not in (select chunk_id from pos))),
g as (select stratum, count(*) as size from pool group by 1), f as (select *, 50 * size / sum(size) over () as raw, floor(50 * size / sum(size) over ()) as fl from g),
o as (select *, 50 - sum(fl) over () as rest, row_number() over (order by round(raw - fl, 12) desc, stratum desc) as pos from f)
select stratum, size, (fl + (pos <= rest)::int)::bigint as target from o""",
    "tk6_sample": _CAND + """, pool as (select chunk_id, chunk_type || '|' || case when v <= 0 then 'low' when v <= 10 then 'mid' else 'high' end || '|' || coalesce(year(make_timestamp(created_utc * 1000000))::varchar, 'unknown') as stratum
  from (select *, coalesce(nullif(comment_score, 0), post_score, 0) as v from ch where chunk_id not in (select chunk_id from pos))),
g as (select stratum, count(*) as size from pool group by 1), f as (select *, 50 * size / sum(size) over () as raw, floor(50 * size / sum(size) over ()) as fl from g),
o as (select *, 50 - sum(fl) over () as rest, row_number() over (order by round(raw - fl, 12) desc, stratum desc) as pos from f),
n as (select *, row_number() over (partition by stratum order by md5(chunk_id || ':42'), chunk_id) as n from pool)
select chunk_id, n.stratum from n join o using (stratum) where n <= fl + (pos <= rest)::int""",
    "tk2_cosine_topk": _COS + "select query_id, id, score, rank from top",
    "r10_metrics": _COS + "select * from met",
    "a12_by_category": _COS + "select coalesce(category::varchar, 'all') as category, count(*) as n, round(avg(ndcg), 6) as ndcg, round(avg(mrr), 6) as mrr from met group by rollup (category)",
    "f11_input_gate": _GATE,
    "r18_sources": _ANSWERS + f""", src as (select query_id, rank as n, id as chunk_id, {_strip("coalesce(post_title, '')")} as title, coalesce(nullif({_strip("coalesce(permalink, '')")}, ''), case when regexp_matches({_strip("link_id")}, '^t3_.') then '/r/{FORUM}/comments/' || substr({_strip("link_id")}, 4) || '/' end,
 case when lower({_strip("chunk_type")}) = 'post' and regexp_matches(id, '^t3_[^_]+_.*?[0-9]+$') then '/r/{FORUM}/comments/' || string_split(id, '_')[2] || '/' end, '') as permalink, strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') as created from h where rank <= 5)
select * from (select distinct query_id, n from an) join src using (query_id, n)""",
    "r18_orphans": _ANSWERS + " select query_id, n from an where (query_id, n) not in (select (query_id, rank) from h where rank <= 5)",
    "policy_split": f"""with o as (select id, {_strip("coalesce(min(selftext), '')")} as t from posts group by id), l as (select *, string_split(t, chr(10)) as ln from o),
x as (select *, list_position(list_transform(ln, lambda y: regexp_matches({_strip("y")}, '^\\*\\*.+\\*\\*\\s*$')), true) as line_at from l),
p as (select *, case when line_at > 1 then {_strip("array_to_string(ln[1 : line_at - 1], chr(10))")} else '' end as prefix, case when line_at > 1 then {_strip("array_to_string(ln[line_at :], chr(10))")} else t end as body from x),
c as (select *, regexp_matches(prefix, '\\[[0-9]+\\]') as cites, lower(prefix) as low from p)
select id, case when cites or prefix = '' then null when {" or ".join(f"contains(low, '{x}')" for x in A.EMERGENCY)} then 'emergency' when {" or ".join(f"contains(low, '{x}')" for x in A.PRESCRIBER)} then 'prescriber' end as kind, md5(case when cites then '' else prefix end) as policy_md5, md5(case when cites then t else body end) as body_md5 from c""",
    "context_packs": _HITS + f"select query_id, md5(string_agg('[' || rank || '] ' || coalesce(post_title, '') || chr(10) || {_strip('text')}, chr(10) || chr(10) order by rank)) as context_md5 from h where rank <= 5 group by 1",
    "e6_pending": "select distinct id as key from posts where id not in (select id from posts where score > 5 and num_comments > 2 and title is not null)",
}
