"""Input gate, answer parsing, policy blocks, citations and judge scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import ustrip

# fixed values: patterns of the input gate and hints of the policy classes
INJECTION = (r"(?i)ignore\s+(previous|all|the)\s+instructions", r"(?i)disregard\s+(the\s+)?(above|instructions)", r"(?i)\bsystem\s*:", r"(?i)you\s+are\s+now\s+", r"(?i)\bDAN\b", r"(?i)sudo\s+mode", r"(?i)```(?:json|markdown|text)?")
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
EMERGENCY = ("emergency", "911", "emergency room", "urgent", "crushing chest", "chest pain", "immediate medical", "in-person", "cannot determine", "just long covid")
PRESCRIBER = ("prescribing physician", "prescribing clinician", "qualified clinician", "prescription medication", "taper", "stopping, starting, or changing", "peer-reported context", "not instructions")


def gate_code(q: Column) -> Column:
    """The first rule a question breaks; '' if none."""
    t = ustrip(F.coalesce(q, F.lit("")))
    bad = t.rlike(INJECTION[0])
    for p in INJECTION[1:]:
        bad = bad | t.rlike(p)
    return F.when(t == "", "query_empty").when(F.length(t) > 8000, "query_too_long").when(~t.rlike("[A-Za-z]{3,}"), "query_nonsense").when(bad, "query_rejected_pattern").when(t.rlike(CONTROL), "query_control_chars").otherwise("")


def anchors(md: Column) -> Column:
    """Distinct numbers of [n] by first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(md, F.lit("")), F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


def without_anchors(md: Column, drop: Column) -> Column:
    return F.aggregate(drop, md, lambda t, n: F.replace(t, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))


def policy_block(md: Column) -> Column:
    """struct(policy, kind, body): what stands before the first line that is a bold heading.

    Without such a line, or if that part cites something, the policy is empty
    and the body is the whole text.
    """
    t = ustrip(F.coalesce(md, F.lit("")))
    lines = F.split(t, "\n")
    heads = F.transform(lines, lambda x: ustrip(x).rlike(r"^\*\*.+\*\*\s*$"))
    at = F.array_position(heads, True)
    prefix = F.when(at > 1, ustrip(F.array_join(F.slice(lines, F.lit(1), (at - 1).cast("int")), "\n"))).otherwise("")
    body = F.when(at > 1, ustrip(F.array_join(F.slice(lines, at.cast("int"), F.size(lines)), "\n"))).otherwise(t)
    cites = prefix.rlike(r"\[\d+\]")
    low = F.lower(prefix)
    said = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(low, h))
    kind = F.when(cites | (prefix == ""), F.lit(None)).when(said(EMERGENCY), "emergency").when(said(PRESCRIBER), "prescriber")
    return F.struct(F.when(cites, "").otherwise(prefix).alias("policy"), kind.alias("kind"), F.when(cites, t).otherwise(body).alias("body"))


def strip_fences(t: Column) -> Column:
    s = ustrip(F.coalesce(t, F.lit("")))
    return F.when(s.startswith("```"), ustrip(F.regexp_replace(s, r"(?m)^\s*```.*$\R?", ""))).otherwise(s)


def judge_digit(t: Column, strict: bool = False) -> Column:
    """The first of 1, 2, 3 in a reply; null if there is none, or an error with ``strict``."""
    d = F.regexp_extract(F.coalesce(t, F.lit("")), "[123]", 0)
    none = F.raise_error(F.concat(F.lit("no score in: "), F.coalesce(t, F.lit("")))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(d != "", d.try_cast("int")).otherwise(none)


def clamp_score(x: Column) -> Column:
    """Rounded score if it lies in 1..5, else 0."""
    r = F.bround(x.cast("double")).try_cast("int")
    return F.when(r.between(1, 5), r).otherwise(0)


def pack_context(hits: DataFrame, most: int = 25) -> DataFrame:
    """(query_id, context): numbered blocks of the first ``most`` ranked texts."""
    top = hits.where(F.col("rank") <= most)
    block = F.format_string("[%d] %s\n%s", F.col("rank"), F.coalesce("post_title", F.lit("")), ustrip(F.coalesce("text", F.lit(""))))
    rows = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("r"))
    return rows.select("query_id", F.array_join(F.transform("r", lambda x: x["b"]), "\n\n").alias("context"))


def permalink(link_id: Column, chunk_type: Column, chunk_id: Column, stored: Column, forum: str) -> Column:
    """Stored address, else that of the thread, else (posts) that of the chunk's own id, else ''."""
    path = lambda p: F.concat(F.lit(f"/r/{forum}/comments/"), p, F.lit("/"))
    own = F.nullif(ustrip(F.coalesce(stored, F.lit(""))), F.lit(""))
    by_link = F.when(ustrip(link_id).rlike("^t3_."), path(F.substring(ustrip(link_id), 4, 1 << 30)))
    by_chunk = F.when((F.lower(ustrip(chunk_type)) == "post") & chunk_id.rlike(r"^t3_[^_]+_.*?\d+$"), path(F.split(chunk_id, "_")[1]))
    return F.coalesce(own, by_link, by_chunk, F.lit(""))


def cited_sources(answers: DataFrame, hits: DataFrame, forum: str) -> tuple[DataFrame, DataFrame]:
    """Cited sources in order of their number, and anchors that name none.

    ``answers``: (query_id, answer); ``hits``: ranked rows with chunk fields.
    """
    asked = answers.select("query_id", F.explode(anchors(F.col("answer"))).alias("n"))
    src = hits.select("query_id", F.col("rank").alias("n"), "chunk_id", ustrip(F.coalesce("post_title", F.lit(""))).alias("title"), permalink(F.col("link_id"), F.col("chunk_type"), F.col("chunk_id"), F.col("permalink"), forum).alias("permalink"), F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("created"))
    return asked.join(src, ["query_id", "n"]), asked.join(src, ["query_id", "n"], "left_anti")


def verified(asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Anchors with a keep flag; an anchor without a verdict is kept."""
    return asked.join(verdicts, ["query_id", "n"], "left").select("query_id", "n", F.coalesce("keep", F.lit(True)).alias("keep"))


def pending(keys: DataFrame, done: DataFrame) -> DataFrame:
    """Keys without a non-null value in the checkpoint: (key) and (key, value)."""
    return keys.join(done.where("value is not null"), "key", "left_anti")


