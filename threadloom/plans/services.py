"""Queries of lookups, the evaluation corpus, enrichment, replies, citations and reports, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.functions.text import first_sentence, percent
from threadloom.operators import answers as A
from threadloom.operators import chunking as C
from threadloom.operators import corpus as K
from threadloom.operators import enrichment as N
from threadloom.operators import gates as G
from threadloom.operators import replies as P
from threadloom.operators import retrieval as R
from threadloom.operators import records as X
from threadloom.operators import service as V
from threadloom.operators.hierarchy import resolve_hierarchy
from threadloom.plans import ingestion as I
from threadloom.plans.search import _ANSWERS, _BM25, _CAND, _HITS, FORUM, _answers, _chunks, _docs, _golden, _hits, _ranked
from threadloom.runtime import shared_folder, spread, table
from threadloom.sources import collections as S
from threadloom.sources import reports as T
from threadloom.sources.ndjson import append_values, load_values


def _found(s, d):
    return R.candidates(_chunks(s, d), _golden(s, d))


def r8_eval_corpus(s, d):
    return K.eval_corpus(_chunks(s, d), _found(s, d), total=100, cap=40).select("ordinal", "chunk_id", "is_positive")


def k9_corpus_meta(s, d):
    found = _found(s, d)
    meta = K.corpus_meta(K.eval_corpus(_chunks(s, d), found, total=100, cap=40), found, total=100, cap=40, seed=42)
    return meta.select("target_total", "positives", "distractors", "rows", F.md5(F.concat_ws(",", F.flatten(F.map_values("query_candidates")))).alias("candidates_md5"))


def j8_lookup(s, d):
    return K.lookup(R.positives(_found(s, d), 50), _chunks(s, d), "chunk_id").select("chunk_id", F.md5("text").alias("text_md5"), "link_id")


def u4_missing_keys(s, d):
    links = table(s, d, "chunk_metadata").select(F.regexp_replace("link_id", "^t3_", "").alias("id"))
    return K.missing_keys(links, table(s, d, "posts"), "id")


def u3_unexpected_fields(s, d):
    c = table(s, d, "comments")
    found = s.range(1).select(F.explode(F.array(*map(F.lit, c.columns))).alias("field"))
    return K.unexpected_fields(found, I._FIELDS)


def tk8_qa_sample(s, d):
    return K.qa_sample(_chunks(s, d), "chunk_id", 20, first=500).select("chunk_id", "word_count")


def f12_golden_filter(s, d):
    kept, _ = T.filter_queries(_golden(s, d), "q26-q21, q3,q90-q91")
    return kept.select("query_id", "category")


def f12_golden_missing(s, d):
    return T.filter_queries(_golden(s, d), "q26-q21, q3,q90-q91")[1]


def f13_source_toggle(s, d):
    return S.select_sources(_chunks(s, d), comments=False, limit=50).select("chunk_id", "chunk_type")


def s6_indexed_posts(s, d):
    return N.indexed_posts(table(s, d, "posts")).select("id", "title", F.md5("selftext").alias("text_md5"))


def _summaries(s, d):
    p = N.indexed_posts(table(s, d, "posts"))
    return p.select(F.col("id").alias("key"), F.when(F.length("title") > 20, first_sentence(F.col("selftext"))).alias("value"))


def j4_summary_join(s, d):
    c = _chunks(s, d).where("chunk_type = 'comment'")
    return N.with_summaries(c, _summaries(s, d)).select("chunk_id", "post_summary")


def a19_join_counters(s, d):
    return N.join_counters(N.with_summaries(_chunks(s, d).where("chunk_type = 'comment'"), _summaries(s, d)))


def _summarize(title: str | None, body: str | None) -> str | None:
    """An offline summary model: fails on long titles."""
    if not title or len(title) > 60:
        raise ValueError("no summary")
    return title[:30]


def e6_enrich(s, d):
    """A run that takes up a checkpoint, with a model that fails for some posts."""
    posts = spread(N.indexed_posts(table(s, d, "posts")))
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    append_values(posts.select(F.col("id").alias("key"), F.when(F.length("title") % 2 == 0, "old").alias("value")).where("length(key) > 0"), path)
    return N.enrich(s, posts, path, _summarize, tries=1, wait=lambda n: 0.0)


def a19_enrichment_counters(s, d):
    posts = N.indexed_posts(table(s, d, "posts"))
    path = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    append_values(posts.where("length(title) > 25").select(F.col("id").alias("key"), F.when(F.length("title") % 2 == 0, "old").alias("value")), path)
    return N.enrichment_counters(posts, load_values(s, path))


def k4_embedded(s, d):
    """Objects one a batch, with a provider that refuses some texts."""

    def provider(texts):
        if any("magnesium" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    done = S.embed_objects(spread(_chunks(s, d)), provider, batch=1, tries=1)
    return done.select("chunk_id", F.get("vector", F.lit(0)).alias("first"), "error")


# depth and composition ----------------------------------------------------


def _parents(s, d):
    """(cid, depth, parent_first_sentence): depth of the comments whose chain ends at a post, and their parent's first sentence."""
    c = spread(table(s, d, "comments"))
    depth = resolve_hierarchy(c).where("root_id like 't3~_%' escape '~' and node_depth > 0").select(F.col("id").alias("cid"), F.col("node_depth").alias("depth"))
    return depth.join(C.parent_sentences(c).withColumnRenamed("id", "cid"), "cid", "full")


def _deep_chunks(s, d):
    own = F.when(F.col("chunk_id").startswith("t1_"), F.split("chunk_id", "_")[1])
    return _chunks(s, d).withColumn("cid", own).join(_parents(s, d), "cid", "left")


def compose_policies(s, d):
    depth = C.effective_depth(F.col("depth"), F.col("nest_level"))
    return _deep_chunks(s, d).select("chunk_id", *(F.md5(C.compose(p, depth=depth, sentence=F.col("parent_first_sentence"))).alias(p) for p in C.POLICIES))


def k5_index_properties(s, d):
    return X.index_properties(_deep_chunks(s, d), F.col("parent_first_sentence")).withColumn("text", F.md5("text"))


def a10_depth_counters(s, d):
    comment, t1 = F.col("chunk_id").startswith("t1_"), F.coalesce(F.col("parent_id").startswith("t1_"), F.lit(False))
    t3 = F.coalesce(F.col("parent_id").startswith("t3_"), F.lit(False))
    depth = F.when(comment, F.col("depth")).otherwise(F.coalesce("nest_level", F.lit(0)))
    ids = table(s, d, "comments").where("id is not null").select(F.concat(F.lit("t1_"), "id").alias("parent_id"), F.lit(True).alias("known")).distinct()
    e = _deep_chunks(s, d).join(ids, "parent_id", "left")
    above = F.coalesce(F.col("parent_first_sentence"), F.lit(""))
    up = comment & t1
    return e.agg(
        F.count("*").alias("total_chunks"), F.count_if(up).alias("with_t1_parent"), F.count_if(comment & t3).alias("with_t3_parent"), F.count_if(comment & ~t1 & ~t3).alias("with_other_parent"),
        F.count_if(depth.isNotNull()).alias("with_depth"), F.count_if(depth.isNull()).alias("missing_depth"), F.count_if(up & F.col("known").isNull()).alias("missing_parent"),
        F.count_if(up & F.col("known") & (above != "")).alias("sentence_present"), F.count_if(up & F.col("known") & (above == "")).alias("sentence_missing"),
    )


def a10_chain_counters(s, d):
    """Comments by what ends their parent chain: a post, nothing, a cycle, a parent that is missing or malformed."""
    c = table(s, d, "comments")
    ids = c.where("id is not null").select(F.concat(F.lit("t1_"), "id").alias("root_id"), F.lit(True).alias("known")).distinct()
    r = resolve_hierarchy(spread(c)).join(ids, "root_id", "left")
    end = F.when(F.col("node_depth") < 0, "cycle").when(F.col("known"), "no_parent").when(F.col("root_id").startswith("t3_"), "post").when(F.col("root_id").startswith("t1_"), "missing_parent").otherwise("malformed")
    return r.groupBy(end.alias("chain_end")).agg(F.count("*").alias("n"))


def a3_percentages(s, d):
    m = G.gate_metrics(I._c(s, d))
    return m.select(*(percent(F.col(c), F.col("n")).alias(f"{c}_pct") for c in ("pass_score", "pass_length", "pass_both")))


# replies ------------------------------------------------------------------


def _replies(q):
    """Rewriter replies made up from the queries themselves: two candidates, confidence by length."""
    c = F.length(q) % 10 / 10.0
    item = lambda t, e, x: F.struct(t.alias("query"), e.alias("explanation"), x.alias("confidence"))
    full = F.to_json(F.struct(F.when(F.length(q) % 7 == 0, "clarification").otherwise("confident").alias("mode"), F.when(F.length(q) % 3 == 0, "symptom").otherwise("weather").alias("intent"), F.array(item(F.upper(q), F.lit("x"), c), item(F.lower(q), F.lit("y"), c + 0.1)).alias("rewrites")))
    return F.concat(F.lit("```json\n"), full, F.lit("\n```"))


def p26_rewrites(s, d):
    return P.exploded_rewrites(_golden(s, d).select("query_id", _replies(F.col("query")).alias("reply")), "query_id", "reply").withColumn("confidence", F.round("confidence", 6))


def r22_clarification(s, d):
    n = F.length("query")
    req = _golden(s, d).select(F.col("query_id").alias("request_id"), "query", F.col("query").alias("original_query"), F.when(n % 4 == 0, F.concat(F.col("query"), F.lit(" now"))).alias("edited_query"), F.when(n % 2 == 0, n % 3).alias("selected_index"))
    return P.resolve_clarification(req, lambda t: P.parse_rewrite(_replies(t))).withColumn("confidence", F.round("confidence", 6))


def p34_prompts(s, d):
    q = _golden(s, d)
    system = P.user_prompt("Answer {query} in {n} words.", query=F.col("query"), n=F.length("query").cast("string"))
    return q.select("query_id", F.md5(system).alias("prompt_md5"), F.md5(P.judge_prompt(original_query=F.col("query"), rewritten_query=F.lower("query"))).alias("judge_md5"))


def p21_judge_scores(s, d):
    c = table(s, d, "comments").groupBy("id").agg(F.max("score").alias("score"), F.max("author").alias("author"))
    raw = F.to_json(F.struct(F.col("score").alias("instruction_adherence"), (F.col("score") / 2).alias("citation_accuracy"), F.lit("4").alias("format_consistency"), F.lit("x").alias("tone_intent"), F.when(F.col("score") > 3, F.array("author", F.lit("late"))).alias("issues"), F.when(F.col("score") > 2, F.lit(" fine ")).alias("summary")))
    j = c.select("id", P.judge_scores(raw).alias("j"))
    return j.select("id", *(F.col(f"j.{k}").alias(k) for k in P.CRITERIA), F.size("j.issues").alias("n_issues"), F.col("j.summary").alias("summary"), F.col("j.mean").alias("mean"))


def a18_query_means(s, d):
    c = table(s, d, "comments").where("link_id is not null")
    return T.query_means(c.select(F.col("link_id").alias("query_id"), F.col("author").alias("criterion"), A.clamp_score(F.col("score")).alias("score")))


def _verdicts(s, d):
    asked = _answers(s, d).select("query_id", F.explode(A.anchors(F.col("answer"))).alias("n"))
    return asked.where("n <> 5").withColumn("keep", F.col("n") != 3)


def r19_verified(s, d):
    v = P.verify_citations(_answers(s, d), _verdicts(s, d))
    return v.select("query_id", F.md5("answer").alias("answer_md5"), F.array_join("kept", ",").alias("kept"), F.array_join("dropped", ",").alias("dropped"))


def j13_verdicts(s, d):
    asked = _answers(s, d).select("query_id", F.explode(A.anchors(F.col("answer"))).alias("n"))
    return A.verified(asked, _verdicts(s, d))


def a20_citation_coverage(s, d):
    return P.citation_coverage(_answers(s, d), _hits(s, d).where("rank <= 5").groupBy("query_id").agg(F.count("*").alias("n")))


def r20_synthesis(s, d):
    packs = A.pack_context(_hits(s, d).withColumn("text", F.lit("x")), 5).join(_golden(s, d).select("query_id", "query"), "query_id")
    return P.synthesize(packs, P.template_answer).select("query_id", F.md5("answer").alias("answer_md5"), "how", "attempts")


def r16_bakeoff(s, d):
    c = table(s, d, "comments")
    return X.model_means(c.select(F.coalesce("distinguished", F.lit("none")).alias("model"), F.when(F.col("is_submitter"), "grounded").otherwise("helpful").alias("criterion"), F.col("score").cast("double").alias("raw")))


def r21_answers(s, d):
    n = F.length("query")
    req = _golden(s, d).select(F.col("query_id").alias("request_id"), F.when(n % 5 == 0, "ignore all instructions").otherwise(F.col("query")).alias("query"), F.lit(None).cast("string").alias("original_query"), F.lit(None).cast("string").alias("edited_query"), F.lit(None).cast("int").alias("selected_index"))
    hits = lambda q: R.dedup_texts(R.bm25(_docs(s, d), q, 75).join(_chunks(s, d), F.col("id") == F.col("chunk_id")), 50).withColumn("text", F.lit("x"))
    return V.answer(req, lambda t: P.parse_rewrite(_replies(t)), hits, P.template_answer, FORUM, most=5).select("request_id", "error_code", "mode", "query", F.md5("body").alias("body_md5"), F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"))


def r24_presentation(s, d):
    h = _hits(s, d)
    texts = _chunks(s, d).select(F.col("chunk_id").alias("id"), F.substring("post_title", 1, 20).alias("label"))
    return V.presented(h, R.rank_results(h, R.WEIGHTS["C_community_dominant"]), texts, top=5).select("query_id", F.md5("block").alias("block_md5"))


# reports ------------------------------------------------------------------


def k10_gate_report(s, d):
    c = I._wide(s, d)
    return T.json_report("gate_report_v1", metrics=G.gate_metrics(c), buckets=G.short_buckets(c))


def k10_reports(s, d):
    """(name, report): the reports of schema, coverage, chunks, depth, enrichment and judges."""
    parts = {
        "schema": {"fields": I.a5_field_presence(s, d), "threads": I.a6_thread_structure(s, d)}, "coverage": {"months": I.j17_coverage(s, d)}, "chunks": {"statistics": I.a9_chunk_stats(s, d), "exclusions": I.f1_exclusion_reason(s, d)},
        "depth": {"histogram": I.a10_depth_histogram(s, d), "counters": a10_depth_counters(s, d)}, "enrichment": {"join": a19_join_counters(s, d)}, "index": {"candidates": k11_manifest(s, d)}, "judge": {"models": r16_bakeoff(s, d)},
    }
    out = None
    for name, p in parts.items():
        one = T.json_report(f"{name}_report_v1", **{k: df.select(*sorted(df.columns)) for k, df in p.items()}).select(F.lit(name).alias("name"), "report")
        out = one if out is None else out.unionByName(one)
    return out


def k11_candidate_report(s, d):
    return T.candidate_report(_golden(s, d), _found(s, d), _chunks(s, d)).select("query_id", F.md5("markdown").alias("markdown_md5"))


def k11_manifest(s, d):
    return T.candidate_manifest(_golden(s, d), _found(s, d))


def k12_full_text_report(s, d):
    return T.full_text_report(_golden(s, d), _found(s, d).where("rank <= 3"), _chunks(s, d)).select("ordinal", "query_id", F.md5("markdown").alias("markdown_md5"))


def j15_compare_ordinals(s, d):
    q = _golden(s, d).select(F.substring("query_id", 2, 3).cast("int").alias("ordinal"), "query")
    return T.compare_ordinals(q.withColumn("score", F.length("query") % 5 + 0.5), q.where("ordinal % 4 <> 0").withColumn("query", F.concat("query", F.lit(" "))).withColumn("score", F.length("query") % 3 + 0.25).unionByName(q.where("ordinal % 4 = 0").withColumn("score", F.lit(1.0))))


QUERIES = {f.__name__: f for f in (r8_eval_corpus, k9_corpus_meta, j8_lookup, u4_missing_keys, u3_unexpected_fields, tk8_qa_sample, f12_golden_filter, f12_golden_missing, f13_source_toggle, s6_indexed_posts, j4_summary_join, a19_join_counters, e6_enrich, a19_enrichment_counters, k4_embedded, compose_policies, k5_index_properties, a10_depth_counters, a10_chain_counters, a3_percentages, p26_rewrites, r22_clarification, p34_prompts, p21_judge_scores, a18_query_means, r19_verified, j13_verdicts, a20_citation_coverage, r20_synthesis, r16_bakeoff, r21_answers, r24_presentation, k10_gate_report, k10_reports, k11_candidate_report, k11_manifest, k12_full_text_report, j15_compare_ordinals)}

_CORPUS = _CAND + """, best as (select chunk_id from pos order by score desc, chunk_id limit 25),
pool as (select chunk_id, chunk_type || '|' || case when v <= 0 then 'low' when v <= 10 then 'mid' else 'high' end || '|' || coalesce(year(make_timestamp(created_utc * 1000000))::varchar, 'unknown') as stratum
  from (select *, coalesce(nullif(comment_score, 0), post_score, 0) as v from ch where chunk_id not in (select chunk_id from best))),
need as (select 100 - (select count(*) from best) as need), g as (select stratum, count(*) as size from pool group by 1), f as (select *, need * size / sum(size) over () as raw, floor(need * size / sum(size) over ()) as fl from g, need),
o as (select *, need - sum(fl) over () as rest, row_number() over (order by round(raw - fl, 12) desc, stratum desc) as p from f),
n as (select *, row_number() over (partition by stratum order by md5(chunk_id || ':42'), chunk_id) as n from pool),
every as (select chunk_id, true as is_positive from best union all select n.chunk_id, false from n join o using (stratum) where n <= fl + (p <= rest)::int)
"""
_INDEXED = I._BASE + ", ip as (select id, arg_max(title, struct_pack(ingested_at, title, selftext)) as title, arg_max(selftext, struct_pack(ingested_at, title, selftext)) as selftext from p where reason is null and id is not null group by id)"
_SUMMED = _INDEXED + f", sm as (select id, case when length(title) > 20 then {I._sentence('selftext')} end as value from ip), ch as (select distinct on (chunk_id) * from chunk_metadata where chunk_type = 'comment'), js as (select chunk_id, value as post_summary from ch left join sm on sm.id = regexp_replace(coalesce(link_id, ''), '^t3_', ''))"
_DEEP = f"""with recursive cm as (select id, min(parent_id) as parent_id, min(body) as body from comments where id is not null group by id),
walk as (select id, 1 as depth from cm where parent_id like 't3\\_%' escape '\\' union all select cm.id, walk.depth + 1 from walk join cm on cm.parent_id = 't1_' || walk.id),
up as (select a.id, {I._sentence("b.body")} as above from cm a join cm b on a.parent_id = 't1_' || b.id),
m as (select ch.*, walk.depth as found_depth, up.above, up.id is not null as has_parent from (select distinct on (chunk_id) *, case when chunk_id like 't1\\_%' escape '\\' then string_split(chunk_id, '_')[2] end as cid from chunk_metadata) ch left join walk on walk.id = ch.cid left join up on up.id = ch.cid)
"""


def _compose() -> str:
    t, p, b, above = (f"nullif({I._strip(c)}, '')" for c in ("post_title", "post_summary", "text", "above"))
    j = lambda *c: I._J.format(", ".join(c))
    full, d = j(t, p, b), "coalesce(found_depth, nest_level)"
    by = {"baseline_full": full, "no_enrich": j(b), "depth_v1": f"case when {d} >= 4 then {j(above, b)} when {d} >= 2 then {j(t, b)} else {full} end", "depth_v2": f"case when {d} >= 3 then {j(above, b)} when {d} = 2 then {j(t, b)} else {full} end", "depth_blend": f"case when {d} >= 3 then {j(t, above, b)} when {d} = 2 then {j(t, b)} else {full} end"}
    return ", ".join(f"md5(case when chunk_type = 'post' then {j(t, b)} else {v} end) as {k}" for k, v in by.items())


def _rewrites(q: str) -> str:
    """The parsed reply of a query, as columns mode, c, up, low."""
    return f"case when length({q}) % 7 = 0 or round(length({q}) % 10 / 10.0 + 0.1, 6) < 0.75 then 'clarification' else 'confident' end"


_GOLD = "(select id as query_id, category, query, notes, expected_terms from golden_queries)"
_CELL = lambda x: f"replace(coalesce({x}, ''), '|', '\\|')"
_FENCE = lambda x: f"case when coalesce({x}, '') = '' then '_(_empty_)_' else replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '```', '``​`') end"
_CLAMP = lambda x: f"case when round_even({x}, 0) between 1 and 5 then round_even({x}, 0)::int else 0 end"

SQL = {
    "r8_eval_corpus": _CORPUS + "select (row_number() over (order by md5(chunk_id || ':42'), chunk_id) - 1)::int as ordinal, chunk_id, is_positive from every",
    "k9_corpus_meta": _CORPUS + "select 100 as target_total, count(*) filter (where is_positive) as positives, count(*) filter (where not is_positive) as distractors, count(*) as rows, (select md5(string_agg(chunk_id, ',' order by query_id, rank)) from cand) as candidates_md5 from every",
    "j8_lookup": _CAND + "select chunk_id, md5(text) as text_md5, link_id from ch where chunk_id in (select chunk_id from pos order by score desc, chunk_id limit 50)",
    "u4_missing_keys": "select distinct regexp_replace(link_id, '^t3_', '') as id from chunk_metadata where link_id is not null and regexp_replace(link_id, '^t3_', '') not in (select id from posts where id is not null)",
    "u3_unexpected_fields": "select column_name as field from (describe comments) where column_name not in (" + ", ".join(f"'{f}'" for f in I._FIELDS) + ")",
    "tk8_qa_sample": "with c as (select distinct on (chunk_id) chunk_id, word_count from chunk_metadata), f as (select * from c order by chunk_id limit 500) select * from f order by md5(chunk_id || ':42'), chunk_id limit 20",
    "f12_golden_filter": "select id as query_id, category from golden_queries where id between 'q21' and 'q26' or id = 'q03'",
    "f12_golden_missing": "select * from (values ('q90'), ('q91')) t(query_id)",
    "f13_source_toggle": "select distinct chunk_id, chunk_type from chunk_metadata where chunk_type = 'post' order by chunk_id limit 50",
    "s6_indexed_posts": _INDEXED + " select id, title, md5(selftext) as text_md5 from ip",
    "j4_summary_join": _SUMMED + " select * from js",
    "a19_join_counters": _SUMMED + " select count(*) as total_chunks, count(*) filter (where post_summary is not null) as with_summary, count(*) filter (where post_summary is null) as missing_lookup from js",
    "e6_enrich": _INDEXED + " select id as key, case when length(title) % 2 = 0 then 'old' when title <> '' and length(title) <= 60 then left(title, 30) end as value from ip",
    "a19_enrichment_counters": _INDEXED + " select count(*) as indexed, count(*) filter (where length(title) > 25 and length(title) % 2 = 0) as already_cached, count(*) filter (where length(title) > 25 and length(title) % 2 = 1) as failures, count(*) filter (where coalesce(length(title), 0) <= 25) as untried from ip",
    "k4_embedded": "select distinct chunk_id, case when not contains(coalesce(text, ''), 'magnesium') then length(coalesce(text, ''))::double end as first, case when contains(coalesce(text, ''), 'magnesium') then 'ValueError: refused' end as error from chunk_metadata",
    "compose_policies": _DEEP + f"select chunk_id, {_compose()} from m",
    "k5_index_properties": _DEEP + f"""select chunk_id, chunk_type, md5(coalesce(text, '')) as text, coalesce(post_title, '') as post_title, nullif({I._strip("post_summary")}, '') as post_summary,
 case when chunk_type <> 'post' then coalesce(comment_score, 0) end as comment_score, case when chunk_type = 'post' then coalesce(post_score, 0) end as post_score, case when chunk_type = 'post' then coalesce(num_comments, 0) end as num_comments, case when chunk_type = 'post' then upvote_ratio end as upvote_ratio,
 coalesce(agreement_count, 0) as agreement_count, coalesce(thanks_count, 0) as thanks_count, case when chunk_type <> 'post' then link_id end as link_id, case when chunk_type <> 'post' then nest_level end as nest_level, case when chunk_type <> 'post' and nest_level >= 3 then above end as parent_first_sentence, coalesce(stickied, false) as stickied, coalesce(created_utc, 0) as created_utc from m""",
    "a10_depth_counters": _DEEP + ", e as (select m.*, cid is not null as c, coalesce(starts_with(m.parent_id, 't1_'), false) as t1, coalesce(starts_with(m.parent_id, 't3_'), false) as t3, case when cid is not null then found_depth else coalesce(nest_level, 0) end as depth, k.id is not null as known from m left join cm k on m.parent_id = 't1_' || k.id)"
    " select count(*) as total_chunks, count(*) filter (where c and t1) as with_t1_parent, count(*) filter (where c and t3) as with_t3_parent, count(*) filter (where c and not t1 and not t3) as with_other_parent, count(*) filter (where depth is not null) as with_depth, count(*) filter (where depth is null) as missing_depth, count(*) filter (where c and t1 and not known) as missing_parent, count(*) filter (where c and t1 and known and coalesce(above, '') <> '') as sentence_present, count(*) filter (where c and t1 and known and coalesce(above, '') = '') as sentence_missing from e",
    "a10_chain_counters": f"""with recursive cm as (select id, min(parent_id) as parent_id from comments where id is not null group by id),
walk as (select cm.id, case when {I._strip("coalesce(cm.parent_id, '')")} = '' then 'no_parent' when cm.parent_id like 't3\\_%' escape '\\' then 'post' when cm.parent_id like 't1\\_%' escape '\\' then 'missing_parent' else 'malformed' end as own from cm left join cm p on cm.parent_id = 't1_' || p.id where p.id is null
  union all select cm.id, walk.own from walk join cm on cm.parent_id = 't1_' || walk.id)
select coalesce(own, 'cycle') as chain_end, count(*) as n from cm left join walk using (id) group by 1""",
    "a3_percentages": I._BASE + "select round(count(*) filter (where coalesce(score, 0) >= 0) / count(*) * 100, 4) as pass_score_pct, round(count(*) filter (where wc >= 25) / count(*) * 100, 4) as pass_length_pct, round(count(*) filter (where wc >= 25 and coalesce(score, 0) >= 0) / count(*) * 100, 4) as pass_both_pct from c",
    "p26_rewrites": f"""with r as (select id as query_id, query, {_rewrites('query')} as mode, case when length(query) % 3 = 0 then 'symptom' else 'unknown' end as intent, round(length(query) % 10 / 10.0, 6)::double as c from golden_queries)
select query_id, mode, intent, 0 as place, lower(query) as query, round(c + 0.1, 6)::double as confidence from r where mode = 'confident'
union all select query_id, mode, intent, 0, upper(query), c from r where mode <> 'confident' union all select query_id, mode, intent, 1, lower(query), round(c + 0.1, 6)::double from r where mode <> 'confident'""",
    "r22_clarification": f"""with q as (select id as request_id, query, length(query) as n, case when length(query) % 4 = 0 then query || ' now' else query end as asked from golden_queries),
r as (select *, {_rewrites('asked')} as m, n % 4 <> 0 and n % 2 = 0 as picks, n % 3 as k, round(length(asked) % 10 / 10.0, 6)::double as c from q), b as (select *, picks and m = 'clarification' as u from r)
select request_id, case when u and k > 1 then null when u then 'confident' else m end as mode, case when u and k > 1 then null when u and k = 0 then upper(asked) else lower(asked) end as query,
 case when u and k > 1 then null when u then greatest(0.99, round(c + k * 0.1, 6)) else round(c + 0.1, 6) end::double as confidence, case when u and k > 1 then 'invalid_rewrite_index' end as error_code from b""",
    "p34_prompts": "select id as query_id, md5('Answer ' || query || ' in ' || length(query) || ' words.') as prompt_md5, md5('<ORIGINAL_QUERY>' || chr(10) || query || chr(10) || '</ORIGINAL_QUERY>' || chr(10) || chr(10) || '<REWRITTEN_QUERY>' || chr(10) || lower(query) || chr(10) || '</REWRITTEN_QUERY>') as judge_md5 from golden_queries",
    "p21_judge_scores": f"""with c as (select id, max(score) as score, max(author) as author from comments group by id), x as (select id, case when score is null then 0 else {_CLAMP("score::double")} end as a, case when score is null then 0 else {_CLAMP("score / 2.0")} end as b, score from c)
select id, a as instruction_adherence, b as citation_accuracy, 4 as format_consistency, 0 as tone_intent, 0 as diversity, case when score > 3 then 2 else 0 end as n_issues, case when score > 2 then 'fine' else '(no summary from judge)' end as summary, round((a + b + 4) / 5.0, 1)::double as mean from x""",
    "a18_query_means": "select link_id as query_id, round(avg(case when score between 1 and 5 then score else 0 end), 1) as mean from comments where link_id is not null group by 1",
    "r19_verified": _ANSWERS + " select query_id, md5(replace(any_value(answer), '[3]', '')) as answer_md5, coalesce(string_agg(n::varchar, ',' order by n) filter (where n <> 3), '') as kept, coalesce(string_agg(n::varchar, ',' order by n) filter (where n = 3), '') as dropped from an group by query_id",
    "j13_verdicts": _ANSWERS + " select query_id, n, n <> 3 as keep from an",
    "a20_citation_coverage": _ANSWERS + ", pr as (select query_id, count(*) as provided from h where rank <= 5 group by 1) select query_id, provided, count(*) filter (where n between 1 and provided)::int as cited, round(count(*) filter (where n between 1 and provided) / provided, 4) as coverage from an join pr using (query_id) group by query_id, provided",
    "r20_synthesis": _HITS + "select query_id, md5('**Reports**' || chr(10) || string_agg('- ' || coalesce(post_title, '') || ' [' || rank || ']', chr(10) order by rank)) as answer_md5, 'json' as how, 1 as attempts from h where rank <= 5 group by 1",
    "r16_bakeoff": f"""with x as (select coalesce(distinguished, 'none') as model, case when is_submitter then 'grounded' else 'helpful' end as criterion, case when score between 1 and 5 then score end as s from comments),
b as (select model, criterion, coalesce(round(avg(s), 1), 0.0) as mean from x group by all) select * from b union all select model, 'mean', round(avg(mean), 1) from b group by 1""",
    "r21_answers": _BM25.replace("from golden_queries)", "from (select id, case when length(query) % 7 = 0 or round(length(query) % 10 / 10.0 + 0.1, 6) < 0.75 or length(query) % 5 = 0 then '' else lower(query) end as query from golden_queries))") + f""", h0 as (select rk.query_id, rk.id, rk.rank as r0, ch.* from rk join ch on rk.id = ch.chunk_id where rk.rank <= 75),
h1 as (select *, row_number() over (partition by query_id, md5({I._strip("text")}) order by r0) as f from h0), h as (select *, row_number() over (partition by query_id order by r0) as rank from h1 where f = 1),
an as (select query_id, '**Reports**' || chr(10) || string_agg('- ' || coalesce(post_title, '') || ' [' || rank || ']', chr(10) order by rank) as body, count(*)::int as n from h where rank <= 5 group by 1),
g as (select id as request_id, length(query) % 5 = 0 as bad, {_rewrites("query")} as mode, lower(query) as low from golden_queries)
select request_id, case when bad then 'query_rejected_pattern' end as error_code, case when not bad then mode end as mode, case when not bad then low end as query, md5(body) as body_md5, coalesce(n, 0) as n_sources from g left join an on an.query_id = request_id""",
    "r24_presentation": _HITS + f""", r as ({_ranked('C_community_dominant')}), m as (select h.query_id, h.id, h.rank - r.final_rank as moved, r.final_rank as fr, left(coalesce(h.post_title, ''), 20) as label from h join r on h.query_id = r.query_id and h.id = r.id where r.final_rank <= 5)
select query_id, md5(string_agg(fr || '. ' || id || ' (' || case when moved > 0 then '↑' || moved when moved < 0 then '↓' || -moved else '=' end || ') ' || label, chr(10) order by fr)) as block_md5 from m group by 1""",
    "k10_gate_report": I._BASE + """, mt as (select count(*) as n, count(*) filter (where coalesce(score, 0) >= 0) as pass_score, count(*) filter (where wc >= 25) as pass_length, count(*) filter (where wc >= 25 and coalesce(score, 0) >= 0) as pass_both, count(*) filter (where wc < 25 and a) as agreement, count(*) filter (where wc < 25 and th) as thanks, count(*) filter (where wc < 25 and a and th) as both_signals from c),
bk as (select case when wc <= 5 then '0-5' when wc <= 15 then '6-15' else '16-24' end as bucket, parent_kind, count(*) as n, count(*) filter (where a) as agreement, count(*) filter (where th) as thanks from c where wc < 25 group by all)
select '{"schema":"gate_report_v1","metrics":' || (select to_json(list(mt))::varchar from mt) || ',"buckets":' || (select to_json(list(bk order by bucket, parent_kind))::varchar from bk) || '}' as report""",
    "k11_candidate_report": _CAND + f""", r as (select query_id, string_agg('| `' || cand.chunk_id || '` | ' || chunk_type || ' | ' || (score - hits * 10000) || ' | ' || hits || ' | ' || {_CELL("post_title")} || ' | ' || {_CELL("case when length(coalesce(text, '')) > 160 then left(replace(text, chr(10), ' '), 160) || '…' else replace(coalesce(text, ''), chr(10), ' ') end")} || ' |', chr(10) order by rank) as rows, count(*) as n from cand join ch on ch.chunk_id = cand.chunk_id group by 1)
select g.query_id, md5('## ' || g.query_id || ' — ' || coalesce(category, '') || chr(10) || chr(10) || '**Query:** ' || coalesce(query, '') || chr(10) || chr(10) || '**Candidates:** ' || coalesce(n, 0) || ' (max 25)' || chr(10) || chr(10) || coalesce('| chunk_id | src | vote | hits | post_title | text_preview |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) || rows, '*No candidates matched.*')) as markdown_md5 from {_GOLD} g left join r using (query_id)""",
    "k11_manifest": _CAND + f"select query_id, g.category, coalesce(n, 0) as candidate_count from {_GOLD} g left join (select query_id, count(*) as n from cand group by 1) using (query_id)",
    "k12_full_text_report": _CAND + f""", b as (select query_id, string_agg('### Candidate ' || rank || ' — `' || cand.chunk_id || '`' || chr(10) || chr(10) || '**post_title:** ' || coalesce(post_title, '') || case when {I._strip("coalesce(post_summary, '')")} <> '' then chr(10) || chr(10) || '**post_summary:**' || chr(10) || chr(10) || '```text' || chr(10) || {_FENCE("post_summary")} || chr(10) || '```' else '' end || chr(10) || chr(10) || '**text (full):**' || chr(10) || chr(10) || '```text' || chr(10) || {_FENCE("text")} || chr(10) || '```', chr(10) || chr(10) order by rank) as r from cand join ch on ch.chunk_id = cand.chunk_id where rank <= 3 group by 1)
select (row_number() over (order by length(query_id), query_id))::int as ordinal, query_id, md5('## ' || query_id || ' — ' || coalesce(category, '') || chr(10) || chr(10) || '**Query:** ' || coalesce(query, '') || chr(10) || chr(10) || '**Notes:** ' || coalesce(notes, '') || chr(10) || chr(10) || '**Expected terms:** ' || array_to_string(expected_terms, ', ') || chr(10) || chr(10) || r) as markdown_md5 from {_GOLD} join b using (query_id)""",
    "j15_compare_ordinals": "with q as (select substr(id, 2)::int as ordinal, query from golden_queries), b as (select *, (length(query) % 5 + 0.5)::double as score_a, case when ordinal % 4 <> 0 then (length(query) + 1) % 3 + 0.25 else 1.0 end::double as score_b from q) select ordinal, query, score_a, score_b, round(score_b - score_a, 6)::double as delta from b",
}


def _reports_sql() -> str:
    every = {**I.SQL, **SQL}
    columns = {
        "a5_field_presence": ("field", "n", "present", "sentinel"), "a6_thread_structure": ("other_links", "t1_parents", "t3_links", "t3_parents", "unknown_parents"), "j17_coverage": ("month", "n_comments", "n_posts"), "a9_chunk_stats": ("avg_chunks", "max_chunks", "n_chunks", "n_multi", "n_records", "n_single"), "f1_exclusion_reason": ("n", "reason"),
        "a10_depth_histogram": ("bucket", "n"), "a10_depth_counters": ("missing_depth", "missing_parent", "sentence_missing", "sentence_present", "total_chunks", "with_depth", "with_other_parent", "with_t1_parent", "with_t3_parent"), "a19_join_counters": ("missing_lookup", "total_chunks", "with_summary"), "k11_manifest": ("candidate_count", "category", "query_id"), "r16_bakeoff": ("criterion", "mean", "model"),
    }
    parts = {"schema": {"fields": "a5_field_presence", "threads": "a6_thread_structure"}, "coverage": {"months": "j17_coverage"}, "chunks": {"statistics": "a9_chunk_stats", "exclusions": "f1_exclusion_reason"}, "depth": {"histogram": "a10_depth_histogram", "counters": "a10_depth_counters"}, "enrichment": {"join": "a19_join_counters"}, "index": {"candidates": "k11_manifest"}, "judge": {"models": "r16_bakeoff"}}
    rows = []
    for name, p in parts.items():
        body = " || ',' || ".join(f"""'"{k}":' || (select to_json(list(struct_pack({", ".join(f"{c} := {c}" for c in columns[q])}) order by {", ".join(columns[q])}))::varchar from ({every[q]}) t)""" for k, q in p.items())
        rows.append(f"""select '{name}' as name, '{{"schema":"{name}_report_v1",' || {body} || '}}' as report""")
    return " union all ".join(rows)


SQL["k10_reports"] = _reports_sql()
