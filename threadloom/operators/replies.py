"""Replies of models: answers and rewrites recovered, prompts rendered, citations verified, clarifications resolved."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import ustrip
from threadloom.operators.answers import anchors, clamp_score, strip_fences, without_anchors

# fixed values: intents a rewrite may have, criteria a judge scores
INTENTS = ("symptom", "treatment", "timeline", "prevalence", "emotional", "admin", "community", "unknown")
CRITERIA = ("instruction_adherence", "citation_accuracy", "format_consistency", "tone_intent", "diversity")
UNSURE, CHOSEN = 0.75, 0.99
LEAST_PLAIN = 80
_FIELD = re.compile(r'"answer_markdown"\s*:\s*"')
_ESCAPE = re.compile(r'\\(?:u([0-9a-fA-F]{4})|(.))|"(?=\s*[,}])|[^\\"]+|.', re.S)
_PLAIN_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def loose_answer(text: str) -> str | None:
    """The answer field of a broken JSON object: up to a quote that a comma or a closing brace follows; other quotes belong to it."""
    m = _FIELD.search(text)
    if not m:
        return None
    out = []
    for part in _ESCAPE.finditer(text, m.end()):
        code, sign = part[1], part[2]
        if code:
            out.append(chr(int(code, 16)))
        elif sign:
            out.append(_PLAIN_ESCAPES.get(sign, part[0]))
        elif part[0] == '"' and text[part.end() :].lstrip()[:1] in ("}", ","):
            break
        else:
            out.append(part[0])
    return "".join(out).strip() or None


def recover_answer(raw: str | None) -> tuple[str | None, str]:
    """(answer, how): ``json``, ``loose`` (broken JSON), ``plain`` (cited Markdown without JSON) or ``failed``."""
    text = raw or ""
    try:
        v = json.loads(text)
        if isinstance(v, dict) and isinstance(v.get("answer_markdown"), str) and v["answer_markdown"].strip():
            return v["answer_markdown"].strip(), "json"
        return None, "failed"
    except ValueError:
        pass
    loose = loose_answer(text)
    if loose is not None:
        return loose, "loose"
    t = text.strip()
    if len(t) >= LEAST_PLAIN and not t.startswith("{") and re.search(r"\[\d+\]", t):
        return t, "plain"
    return None, "failed"


def recover_answers(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, answer, how) of each reply, after its fences are stripped; see :func:`recover_answer`."""
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [recover_answer(x) for x in f["bare"]]
            yield pd.DataFrame({key: f[key], "answer": [a for a, _ in got], "how": [h for _, h in got]}, dtype=object)

    return df.select(key, strip_fences(F.col(reply)).alias("bare")).mapInPandas(run, f"{key} {kind}, answer string, how string")


REWRITES = "mode string, intent string, rewrites array<struct<query: string, explanation: string, confidence: double>>"


def parse_rewrite(reply: Column, threshold: float = UNSURE) -> Column:
    """struct(mode, intent, candidates, best, confidence) of a rewriter's reply; null if it is no JSON or holds no rewrite.

    An unknown intent becomes ``unknown``; no explanation is '', no confidence
    0.5.  The mode is clarification if the reply says so or its best candidate
    is unsure; a confident one keeps the best candidate only, the first of ties.
    """
    r = F.from_json(strip_fences(reply), REWRITES)
    full = F.transform(r["rewrites"], lambda x: F.struct(x["query"].alias("query"), F.coalesce(x["explanation"], F.lit("")).alias("explanation"), F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence")))
    at = F.array_max(F.transform(full, lambda x, i: F.struct(x["confidence"].alias("c"), (-i).alias("i"))))
    best = F.get(full, -at["i"])
    ask = (F.coalesce(r["mode"], F.lit("confident")) == "clarification") | (best["confidence"] < threshold)
    intent = F.when(r["intent"].isin(*INTENTS), r["intent"]).otherwise("unknown")
    out = F.struct(F.when(ask, "clarification").otherwise("confident").alias("mode"), intent.alias("intent"), F.when(ask, full).otherwise(F.array(best)).alias("candidates"), best["query"].alias("best"), best["confidence"].alias("confidence"))
    return F.when(F.size(r["rewrites"]) > 0, out)


def exploded_rewrites(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, mode, intent, place, query, confidence): one row per candidate that is kept."""
    p = df.select(key, parse_rewrite(F.col(reply)).alias("p")).where("p is not null")
    return p.select(key, F.col("p.mode").alias("mode"), F.col("p.intent").alias("intent"), F.posexplode("p.candidates").alias("place", "c")).select(key, "mode", "intent", "place", "c.query", "c.confidence")


def resolve_clarification(requests: DataFrame, rewrite: Callable[[Column], Column]) -> DataFrame:
    """(request_id, mode, query, confidence, error_code) of requests (request_id, query, original_query, edited_query, selected_index).

    An edited query is rewritten afresh.  A chosen index rewrites the original
    query again: if that is sure, its result counts; else the option with that
    index, with a confidence of at least 0.99, or ``invalid_rewrite_index``.
    Otherwise the query is rewritten.  ``rewrite``: a text column to the struct
    of :func:`parse_rewrite`.
    """
    edited = F.nullif(ustrip(F.coalesce("edited_query", F.lit(""))), F.lit(""))
    picks = edited.isNull() & F.col("selected_index").isNotNull()
    asked = F.when(edited.isNotNull(), edited).when(picks, ustrip(F.coalesce("original_query", F.lit("")))).otherwise(ustrip(F.coalesce("query", F.lit(""))))
    d = requests.select("request_id", "selected_index", picks.alias("picks"), asked.alias("asked")).withColumn("r", rewrite(F.col("asked")))
    unsure = F.col("picks") & (F.col("r.mode") == "clarification")
    option = F.when(F.col("selected_index") >= 0, F.get("r.candidates", F.col("selected_index")))
    bad = unsure & option.isNull()
    return d.select(
        "request_id", F.when(bad, F.lit(None)).when(unsure, "confident").otherwise(F.col("r.mode")).alias("mode"), F.when(bad, F.lit(None)).when(unsure, option["query"]).otherwise(F.col("r.best")).alias("query"),
        F.when(bad, F.lit(None)).when(unsure, F.greatest(option["confidence"], F.lit(CHOSEN))).otherwise(F.col("r.confidence")).alias("confidence"), F.when(bad, "invalid_rewrite_index").alias("error_code"),
    )


def user_prompt(template: str, **parts: Column) -> Column:
    """A template with ``{name}`` slots filled by columns; a null column is ''."""
    out = F.lit(template)
    for name, c in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c, F.lit("")))
    return out


def judge_prompt(**parts: Column) -> Column:
    """Tagged sections in the order given, a blank line between them."""
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"<{n.upper()}>\n"), F.coalesce(c, F.lit("")), F.lit(f"\n</{n.upper()}>")) for n, c in parts.items()))


def judge_scores(parsed: Column) -> Column:
    """struct of a judge's JSON: clamped criteria, issues (none unless a list), summary (a stated default), and the mean of the criteria."""
    m = F.from_json(parsed, "map<string,string>")
    scores = [clamp_score(F.try_element_at(m, F.lit(k)).try_cast("double")) for k in CRITERIA]
    scores = [F.coalesce(s, F.lit(0)) for s in scores]
    issues = F.coalesce(F.from_json(F.try_element_at(m, F.lit("issues")), "array<string>"), F.array().cast("array<string>"))
    summary = F.coalesce(F.nullif(ustrip(F.coalesce(F.try_element_at(m, F.lit("summary")), F.lit(""))), F.lit("")), F.lit("(no summary from judge)"))
    return F.struct(*(s.alias(k) for s, k in zip(scores, CRITERIA, strict=True)), issues.alias("issues"), summary.alias("summary"), F.round(sum(scores, F.lit(0)) / len(CRITERIA), 1).alias("mean"))


def sorted_anchors(md: Column) -> Column:
    return F.array_sort(anchors(md))


def verify_citations(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(query_id, answer, kept, dropped): answers without the anchors that a verdict rejects; an anchor without one is kept.

    ``answers``: (query_id, answer); ``verdicts``: (query_id, n, keep).
    """
    bad = verdicts.where(~F.col("keep")).groupBy("query_id").agg(F.collect_set("n").alias("bad"))
    d = answers.select("query_id", "answer", sorted_anchors(F.col("answer")).alias("all")).join(bad, "query_id", "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<int>")))
    drop = F.array_intersect("all", "bad")
    return d.select("query_id", without_anchors(F.col("answer"), drop).alias("answer"), F.array_except("all", "bad").alias("kept"), drop.alias("dropped"))


def citation_coverage(answers: DataFrame, provided: DataFrame) -> DataFrame:
    """(query_id, provided, cited, coverage): distinct anchors that name a provided chunk, against how many were provided.

    ``provided``: (query_id, n).
    """
    d = answers.join(provided, "query_id", "left").withColumn("provided", F.coalesce(F.col("n"), F.lit(0)))
    cited = F.size(F.filter(anchors(F.col("answer")), lambda x: (x >= 1) & (x <= F.col("provided"))))
    return d.select("query_id", "provided", cited.alias("cited"), F.when(F.col("provided") > 0, F.round(cited / F.col("provided"), 4)).otherwise(0.0).alias("coverage"))


def synthesize(contexts: DataFrame, call: Callable[[str, str, int], str], *, tries: int = 3) -> DataFrame:
    """(query_id, answer, how, attempts): grounded answers to (query_id, query, context).

    ``call`` gets the query, the context and the number of the attempt; a reply
    that cannot be recovered is asked for again, at most ``tries`` times, then
    the answer is null and ``how`` is ``failed``.
    """

    def answer(query: str, context: str) -> tuple[str | None, str, int]:
        for n in range(tries):
            raw = call(query or "", context or "", n) or ""
            got, how = recover_answer("\n".join(x for x in raw.splitlines() if not x.strip().startswith("```")) if raw.strip().startswith("```") else raw)
            if got is not None:
                return got, how, n + 1
        return None, "failed", tries

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [answer(q, c) for q, c in zip(f["query"], f["context"], strict=True)]
            yield pd.DataFrame({"query_id": f["query_id"], "answer": [x[0] for x in got], "how": [x[1] for x in got], "attempts": [x[2] for x in got]})

    kind = contexts.schema["query_id"].dataType.simpleString()
    return contexts.select("query_id", "query", "context").mapInPandas(run, f"query_id {kind}, answer string, how string, attempts int")


def template_answer(query: str, context: str, attempt: int) -> str:
    """An offline writer: the first line of each numbered block, cited."""
    blocks = re.findall(r"^\[(\d+)\] (.*)$", context, re.M)
    return json.dumps({"answer_markdown": "**Reports**\n" + "\n".join(f"- {title} [{n}]" for n, title in blocks)})
