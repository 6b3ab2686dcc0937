"""From questions to cited answers: gate, rewrite, retrieval, writing, citations and policy in one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.providers import ask
from threadloom.functions.text import ustrip
from threadloom.operators.answers import cited_sources, gate_code, pack_context, policy_block
from threadloom.operators.records import parse_reply
from threadloom.operators.replies import parse_rewrite, resolve_clarification, synthesize
from threadloom.operators.retrieval import movement
from threadloom.runtime import stored


def rewritten(queries: DataFrame, call: Callable[[str], str | None], **kw) -> DataFrame:
    """(query_id, reply, rewrite): what a rewriter makes of each query; see :func:`parse_rewrite`."""
    r = ask(queries, "query_id", ["query"], call, **kw)
    return r.select("query_id", F.col("value").alias("reply"), parse_rewrite(F.col("value")).alias("rewrite"))


def judged(df: DataFrame, key: str, prompt: list[str], call: Callable[..., str | None], **kw) -> DataFrame:
    """(key, parsed): a judge's JSON for each row, asked again with a reminder where the first reply held none.

    ``call`` gets the prompt columns and whether to remind; null where the
    second reply holds none either, or the calls fail.
    """
    first = parse_reply(ask(df, key, prompt, lambda *a: call(*a, False), **kw), key, "value")
    again = ask(df.join(first.where("parsed is null").select(key), key, "left_semi"), key, prompt, lambda *a: call(*a, True), **kw)
    return first.where("parsed is not null").unionByName(parse_reply(again, key, "value"))


def answer(requests: DataFrame, rewrite: Callable[[Column], Column], retrieve: Callable[[DataFrame], DataFrame], write: Callable[[str, str, int], str], forum: str, *, most: int = 25) -> DataFrame:
    """(request_id, error_code, mode, query, policy_kind, body, sources): what each request comes to.

    ``requests``: as for :func:`resolve_clarification`.  The gate sees the
    edited query, else the original one if an option was chosen, else the query.
    Rejected requests and those that need clarification are not retrieved.
    ``retrieve``: (query_id, query) to ranked rows (query_id, rank, chunk
    fields).  ``sources`` are the cited ones in order of their numbers.
    """
    edited = F.nullif(ustrip(F.coalesce("edited_query", F.lit(""))), F.lit(""))
    seen = F.coalesce(edited, F.when(F.col("selected_index").isNotNull(), F.col("original_query")), F.col("query"))
    gated = requests.select("request_id", F.nullif(gate_code(seen), F.lit("")).alias("gate"))
    r = resolve_clarification(requests, rewrite).join(gated, "request_id")
    r = r.select("request_id", F.coalesce("gate", "error_code").alias("error_code"), F.when(F.col("gate").isNull(), F.col("mode")).alias("mode"), F.when(F.col("gate").isNull(), F.col("query")).alias("query"))
    sure = r.where("error_code is null and mode = 'confident'").select(F.col("request_id").alias("query_id"), "query")
    hits = stored(retrieve(sure))  # read by the writer and by the citations
    written = synthesize(pack_context(hits, most).join(sure, "query_id"), write).where("answer is not null")
    cited, _ = cited_sources(written, hits.where(F.col("rank") <= most), forum)
    sources = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "chunk_id", "title", "permalink"))).alias("sources"))
    out = written.select("query_id", policy_block(F.col("answer")).alias("p")).join(sources, "query_id", "left")
    return r.join(out, r.request_id == out.query_id, "left").select("request_id", "error_code", "mode", "query", F.col("p.kind").alias("policy_kind"), F.col("p.body").alias("body"), "sources")


def presented(before: DataFrame, after: DataFrame, texts: DataFrame, *, top: int = 10) -> DataFrame:
    """(query_id, block): the ``top`` results of each query as lines, with how far each has moved.

    ``texts``: (id, label).
    """
    m = movement(before, after).where((F.col("new_rank") > 0) & (F.col("new_rank") <= top)).join(texts, "id", "left")
    arrow = F.when(F.col("moved") > 0, F.concat(F.lit("↑"), F.col("moved").cast("string"))).when(F.col("moved") < 0, F.concat(F.lit("↓"), (-F.col("moved")).cast("string"))).otherwise("=")
    line = F.format_string("%d. %s (%s) %s", "new_rank", "id", arrow, F.coalesce("label", F.lit("")))
    return m.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("new_rank", line.alias("l")))).alias("r")).select("query_id", F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("block"))
