"""Queries that write and read back: lines, documents, checkpoints, collections, reports, model replies; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.functions import providers as M
from threadloom.operators import answers as A
from threadloom.operators import chunking as C
from threadloom.operators import gates as G
from threadloom.operators import records as X
from threadloom.operators import replies as P
from threadloom.operators import service as V
from threadloom.plans import ingestion as I
from threadloom.plans.search import _LEX, _chunks, _golden
from threadloom.plans.services import _replies, _rewrites
from threadloom.runtime import drop_at_end, shared_folder, spread, table
from threadloom.sources import collections as S
from threadloom.sources import ndjson as L
from threadloom.sources import reports as T


def _folder(s) -> str:
    at = f"{shared_folder(s)}/{uuid.uuid4().hex}"
    drop_at_end(s, at)
    return at


def k1_k2_chunk_lines(s, d):
    """Chunks of comments and posts written as lines and read back, strictly."""
    comments, posts, at = I._c(s, d), I._p(s, d), _folder(s)
    back = []
    for kind, chunks in (("comment", C.comment_chunks(comments, posts)), ("post", C.post_chunks(posts, comments))):
        L.write_ndjson(chunks, f"{at}/{kind}")
        back.append(L.read_strict(s, f"{at}/{kind}", chunks.schema).select("chunk_id", F.md5("text").alias("text_md5"), "word_count"))
    return back[0].unionByName(back[1])


_LINE = "id string, n int"


def _lines(s, d) -> str:
    """A file of a line a golden query, in order of their ids: some blank, some broken, some of the same id."""
    n = F.substring("query_id", 2, 2).cast("int")
    good = F.to_json(F.struct(F.concat(F.lit("k"), (n % 6).cast("string")).alias("id"), n.alias("n"), F.col("category").alias("other")))
    line = F.when(n % 7 == 0, "  ").when(n % 5 == 0, F.concat(F.lit("{"), good)).when(n % 11 == 0, "[1]").otherwise(good)
    at = _folder(s)
    _golden(s, d).select("query_id", line.alias("value")).orderBy("query_id").coalesce(1).select("value").write.text(at)
    return at


def s1_tolerant_lines(s, d):
    return L.read_ndjson(s, _lines(s, d), s.createDataFrame([], _LINE).schema).select("line_no", "id", "n", F.col("error").isNotNull().alias("bad"))


def s10_keep_last(s, d):
    lines = L.read_ndjson(s, _lines(s, d), s.createDataFrame([], _LINE).schema).where("error is null")
    return L.keep_last(lines.select("line_no", "id", "n"), "id")


def a5_discovered_fields(s, d):
    return L.discovered_fields(s, _lines(s, d))


def s4_query_document(s, d):
    at = _folder(s)
    rows = _golden(s, d).select(F.col("query_id").alias("id"), F.concat(F.lit("  "), F.when(F.col("category") != "emotional", F.col("query")).otherwise("")).alias("query"))
    rows.agg(F.to_json(F.struct(F.lit(3).alias("version"), F.collect_list(F.struct("id", "query")).alias("queries"))).alias("value")).coalesce(1).write.text(at)
    return L.read_query_document(s, at).select(F.col("version").cast("int").alias("version"), "id", "query")


def s7_checkpoint(s, d):
    """Two runs over the same keys: the second one counts, also where it is null."""
    at, p = _folder(s), table(s, d, "posts").groupBy("id").agg(F.max("title").alias("title"))
    n = F.coalesce(F.length("title"), F.lit(0))
    L.append_values(p.select(F.col("id").alias("key"), F.upper("title").alias("value")), at)
    L.append_values(p.where(n % 2 == 0).select(F.col("id").alias("key"), F.when(n % 4 == 0, "a").alias("value")), at)
    return L.load_values(s, at)


def k7_cloned_collection(s, d):
    """A collection made, filled with vectors, filled again in part, cloned and counted."""
    at, objects = _folder(s), _chunks(s, d).select("chunk_id", "chunk_type", "text")
    S.create_collection(s, f"{at}/c")
    provider = lambda texts: [[float(len(t))] for t in texts]
    S.ingest(objects, f"{at}/c", provider)
    S.ingest(objects.where("chunk_type = 'post'").withColumn("text", F.lit("again")), f"{at}/c", provider)
    S.clone_collection(s, f"{at}/c", f"{at}/copy")
    copy = s.read.parquet(f"{at}/copy")
    return copy.groupBy("chunk_type").agg(F.count("*").alias("n"), F.sum(F.get("vector", F.lit(0))).alias("lengths"))


def k8_embedding_sink(s, d):
    at, e = _folder(s), table(s, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    S.write_embeddings(v, at, "m1", "no_enrich", "chunks")
    S.write_embeddings(v.where("id % 100 = 0"), at, "m1", "no_enrich", "queries")
    return S.embedding_manifest(s, at)


def s12_vectors(s, d):
    e = table(s, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return S.vectors_of(v, e.where("label = 3").select(F.col("vec_id").alias("id"))).select("id", F.size("v").alias("dims"))


def _numbered(s, d):
    """Reports 1 to 3 of growing parts of the comments, written and found again."""
    at = _folder(s)
    for years in (2021, 2023, 2100):
        part = G.gate_metrics(I._c(s, d).where(F.col("created_utc") < F.unix_seconds(F.lit(f"{years}-01-01").cast("timestamp"))))
        T.write_report(s, at, "golden_iteration", part.agg(F.to_json(F.struct(F.first(F.struct(*part.columns)).alias("aggregate"))).alias("r")).first().r)
    return T.discover_reports(s, at, "golden_iteration")


def j14_report_deltas(s, d):
    m = T.report_metrics(T.newest(_numbered(s, d), 2))
    return X.metric_deltas(m.where("number = 2"), m.where("number = 3"), "metric", "value")


def s15_next_number(s, d):
    r = _numbered(s, d)
    return T.newest(r, 2).select("number").withColumn("next", F.lit(T.next_number(r)))


# replies of models --------------------------------------------------------


def p24_parsed_replies(s, d):
    n = F.length("query")
    good = F.concat(F.lit('{"n": '), n.cast("string"), F.lit("}"))
    reply = F.when(n % 4 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(n % 4 == 1, F.concat(F.lit("So "), good, F.lit(", I think"))).when(n % 4 == 2, good).otherwise("none")
    return X.parse_reply(_golden(s, d).select("query_id", reply.alias("reply")), "query_id", "reply")


def p25_recovered_answers(s, d):
    n, text = F.length("query"), F.concat(F.lit("Some say rest helps, some say pacing does, and a few say that neither does [1], as in "), F.col("query_id"))
    reply = F.when(n % 4 == 0, F.concat(F.lit('{"answer_markdown": "'), text, F.lit('"}'))).when(n % 4 == 1, F.concat(F.lit('{"answer_markdown": "say "now" '), text, F.lit('", "x": '))).when(n % 4 == 2, text).otherwise("no")
    return P.recover_answers(_golden(s, d).select("query_id", reply.alias("reply")), "query_id", "reply")


def e4_scored_pairs(s, d):
    words = lambda t: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower()).split()}
    load = lambda: lambda pairs: [len(words(q) & words(t)) / len(words(q)) if words(q) else 0.0 for q, t in pairs]
    q = _golden(s, d).where("query_id in ('q01', 'q02')").select("query_id", "query")
    pairs = _chunks(s, d).select("chunk_id", F.concat_ws(" ", "post_title", "text").alias("t")).crossJoin(F.broadcast(q))  # two rows
    return M.score_pairs(spread(pairs), ["query_id", "chunk_id"], "query", "t", load).withColumn("score", F.round("score", 6))


def e7_judged_pairs(s, d):
    q = _golden(s, d).where("query_id = 'q03'").select("query")
    pairs = _chunks(s, d).select("chunk_id", "post_title").crossJoin(F.broadcast(q))  # one row
    reply = M.ask(spread(pairs), "chunk_id", ["query", "post_title"], M.judge_reply)
    return reply.select("chunk_id", A.judge_digit(F.col("value"), strict=True).alias("relevance"))


def e8_judged_answers(s, d):
    """A judge that replies in JSON for some queries at once, for others after a reminder."""
    def call(query: str, remind: bool) -> str:
        return '{"n": %d}' % len(query) if remind or len(query) % 2 == 0 else "fine"

    return V.judged(_golden(s, d).select("query_id", "query"), "query_id", ["query"], call)


def e9_rewritten(s, d):
    q = _golden(s, d).select("query_id", _replies(F.col("query")).alias("query"))
    r = V.rewritten(q, lambda reply: reply)
    return r.select("query_id", F.col("rewrite.mode").alias("mode"), F.col("rewrite.best").alias("best"), F.size("rewrite.candidates").alias("n"))


QUERIES = {f.__name__: f for f in (k1_k2_chunk_lines, s1_tolerant_lines, s10_keep_last, a5_discovered_fields, s4_query_document, s7_checkpoint, k7_cloned_collection, k8_embedding_sink, s12_vectors, j14_report_deltas, s15_next_number, p24_parsed_replies, p25_recovered_answers, e4_scored_pairs, e7_judged_pairs, e8_judged_answers, e9_rewritten)}

_N = "with q as (select id as qid, substr(id, 2, 2)::int as n, row_number() over (order by id) as line_no from golden_queries), l as (select *, n % 7 <> 0 and n % 5 = 0 as torn, n % 7 <> 0 and n % 5 <> 0 and n % 11 = 0 as no_object from q where n % 7 <> 0) "
_DELTA = ("n", "pass_score", "pass_length", "pass_both", "agreement", "thanks", "both_signals")
_COUNTED = ["count(*)", "count(*) filter (where coalesce(score, 0) >= 0)", "count(*) filter (where wc >= 25)", "count(*) filter (where wc >= 25 and coalesce(score, 0) >= 0)", "count(*) filter (where wc < 25 and a)", "count(*) filter (where wc < 25 and th)", "count(*) filter (where wc < 25 and a and th)"]
_TEXT = "'Some say rest helps, some say pacing does, and a few say that neither does [1], as in ' || id"
_WSPLIT = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '{I.WS_SQL}+'), lambda y: y <> ''))"

SQL = {
    "k1_k2_chunk_lines": f"select chunk_id, text_md5, word_count from ({I.SQL['x2_comment_chunks']}) union all select chunk_id, text_md5, word_count from ({I.SQL['x3_post_chunks']})",
    "s1_tolerant_lines": _N + "select line_no, case when not torn and not no_object then 'k' || (n % 6) end as id, case when not torn and not no_object then n end as n, torn or no_object as bad from l",
    "s10_keep_last": _N + "select 'k' || (n % 6) as id, arg_max(n, line_no) as n from l where not torn and not no_object group by 1",
    "a5_discovered_fields": "select unnest(['id', 'n', 'other']) as field",
    "s4_query_document": f"select 3 as version, id, {I._strip('query')} as query from golden_queries where category <> 'emotional'",
    "s7_checkpoint": "with p as (select id, max(title) as title from posts group by id), n as (select *, coalesce(length(title), 0) as n from p) select id as key, case when n % 2 = 0 then case when n % 4 = 0 then 'a' end else upper(title) end as value from n",
    "k7_cloned_collection": "select chunk_type, count(*) as n, sum(case when chunk_type = 'post' then 5 else length(coalesce(text, '')) end)::double as lengths from (select distinct on (chunk_id) * from chunk_metadata) group by 1",
    "k8_embedding_sink": "select 'm1' as model_id, 'no_enrich' as policy, 'chunks' as kind, count(*) as n, max(len(embedding))::int as dims from embeddings union all select 'm1', 'no_enrich', 'queries', count(*), max(len(embedding))::int from embeddings where vec_id % 100 = 0",
    "s12_vectors": "select vec_id as id, len(embedding)::int as dims from embeddings where label = 3",
    "j14_report_deltas": I._BASE + ", b as (select * from c where created_utc < epoch(timestamp '2023-01-01')), e as (select * from c where created_utc < epoch(timestamp '2100-01-01')), " + f"bm as (select unnest([{', '.join(repr(x) for x in _DELTA)}]) as metric, unnest([{', '.join(_COUNTED)}])::double as before from b), em as (select unnest([{', '.join(repr(x) for x in _DELTA)}]) as metric, unnest([{', '.join(_COUNTED)}])::double as after from e) select metric, before, after, round(after - before, 6) as delta from bm join em using (metric)",
    "s15_next_number": "select unnest([3, 2]) as number, 4 as next",
    "p24_parsed_replies": "select id as query_id, case when length(query) % 4 < 3 then '{\"n\": ' || length(query) || '}' end as parsed from golden_queries",
    "p25_recovered_answers": f"select id as query_id, case length(query) % 4 when 0 then {_TEXT} when 1 then 'say \"now\" ' || {_TEXT} when 2 then {_TEXT} end as answer, case length(query) % 4 when 0 then 'json' when 1 then 'loose' when 2 then 'plain' else 'failed' end as how from golden_queries",
    "e4_scored_pairs": f"with p as (select ch.chunk_id, post_title, text, g.id as query_id, query from (select distinct on (chunk_id) chunk_id, post_title, text from chunk_metadata) ch, golden_queries g where g.id in ('q01', 'q02')) select query_id, chunk_id, {_LEX} as score from p",
    "e7_judged_pairs": f"with p as (select distinct chunk_id, post_title, query from chunk_metadata, golden_queries g where g.id = 'q03'), x as (select *, len(list_intersect({_WSPLIT('query')}, {_WSPLIT('post_title')})) / len({_WSPLIT('query')}) as share from p) select chunk_id, case when share >= 0.5 then 3 when share >= 0.2 then 2 else 1 end as relevance from x",
    "e8_judged_answers": "select id as query_id, '{\"n\": ' || length(query) || '}' as parsed from golden_queries",
    "e9_rewritten": f"with r as (select id as query_id, lower(query) as best, {_rewrites('query')} as mode from golden_queries) select query_id, mode, best, case when mode = 'confident' then 1 else 2 end as n from r",
}
