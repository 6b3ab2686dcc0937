"""Reports: JSON from aggregates, Markdown per query, numbered report files and their comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import shorten, ustrip


def json_report(schema: str, **parts: DataFrame) -> DataFrame:
    """One row (report): the parts' rows as lists of objects under their names; parts are aggregates of few rows, in the order of their columns."""
    out = None
    for name, df in parts.items():
        one = df.agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    body = F.concat_ws(",", *(F.expr(f"substring({n}, 2, length({n}) - 2)") for n in parts))
    return out.select(F.concat(F.lit(f'{{"schema":"{schema}",'), body, F.lit("}")).alias("report"))


# fixed values: the headings, marks and fences of the two Markdown reports below
EMPTY, NO_BREAK = "_(_empty_)_", "``\u200b`"


def escape_cell(c: Column) -> Column:
    return F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))


def candidate_report(queries: DataFrame, found: DataFrame, chunks: DataFrame, *, preview: int = 160, most: int = 25) -> DataFrame:
    """(query_id, markdown): a table of each query's candidates, cells escaped; a query without one says so.

    ``queries``: (query_id, category, query); ``found``: (query_id, chunk_id,
    hits, score, rank).
    """
    d = found.join(chunks.select("chunk_id", "chunk_type", "post_title", "text"), "chunk_id")
    vote = F.col("score") - F.col("hits") * 10000
    row = F.format_string("| `%s` | %s | %d | %d | %s | %s |", "chunk_id", "chunk_type", vote, "hits", escape_cell(F.col("post_title")), escape_cell(shorten(F.coalesce("text", F.lit("")), preview)))
    rows = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("row")))).alias("rows"), F.count("*").alias("n"))
    q = queries.select("query_id", "category", "query").join(rows, "query_id", "left")
    head = F.format_string("## %s — %s\n\n**Query:** %s\n\n**Candidates:** %d (max %d)\n\n", "query_id", F.coalesce("category", F.lit("")), F.coalesce("query", F.lit("")), F.coalesce("n", F.lit(0)), F.lit(most))
    table = F.concat(F.lit("| chunk_id | src | vote | hits | post_title | text_preview |\n|---|---|---|---|---|---|\n"), F.array_join(F.transform("rows", lambda x: x["row"]), "\n"))
    return q.select("query_id", F.concat(head, F.coalesce(table, F.lit("*No candidates matched.*"))).alias("markdown"))


def candidate_manifest(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, category, candidate_count), queries without candidates included."""
    n = found.groupBy("query_id").agg(F.count("*").alias("n"))
    return queries.select("query_id", "category").join(n, "query_id", "left").select("query_id", "category", F.coalesce("n", F.lit(0)).alias("candidate_count"))


def fenced(c: Column) -> Column:
    """A text that can stand in a code fence; a stated mark for an empty one."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    return F.when(t == "", EMPTY).otherwise(F.replace(t, F.lit("```"), F.lit(NO_BREAK)))


def full_text_report(queries: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ordinal, query_id, markdown): every candidate with its whole text; queries by length of id, then id.  A candidate that is no chunk is named as such."""
    d = found.select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "post_title", "post_summary", "text", F.lit(True).alias("known")), "chunk_id", "left")
    summary = F.when(ustrip(F.coalesce("post_summary", F.lit(""))) != "", F.concat(F.lit("\n\n**post_summary:**\n\n```text\n"), fenced(F.col("post_summary")), F.lit("\n```"))).otherwise("")
    block = F.concat(F.lit("**post_title:** "), F.coalesce("post_title", F.lit("")), summary, F.lit("\n\n**text (full):**\n\n```text\n"), fenced(F.col("text")), F.lit("\n```"))
    block = F.concat(F.format_string("### Candidate %d — `%s`\n\n", "rank", "chunk_id"), F.when(F.col("known"), block).otherwise("_Chunk record not found._"))
    rows = d.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("r"))
    q = queries.select("query_id", "category", "query", "notes", "expected_terms").join(rows, "query_id")
    head = F.format_string("## %s — %s\n\n**Query:** %s\n\n**Notes:** %s\n\n**Expected terms:** %s\n\n", "query_id", F.coalesce("category", F.lit("")), F.coalesce("query", F.lit("")), F.coalesce("notes", F.lit("")), F.array_join(F.coalesce("expected_terms", F.array().cast("array<string>")), ", "))
    # the window holds one row a query, a stated set
    return q.select(F.row_number().over(Window.orderBy(F.length("query_id"), "query_id")).alias("ordinal"), "query_id", F.concat(head, F.array_join(F.transform("r", lambda x: x["b"]), "\n\n")).alias("markdown"))


def write_report(spark: SparkSession, folder: str, stem: str, report: str) -> int:
    """Write a report as the next ``stem_N.json`` of a folder; gives its number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    names = (re.fullmatch(rf"{re.escape(stem)}_(\d+)\.json", f.getPath().getName()) for f in system.listStatus(path))
    number = max((int(m[1]) for m in names if m), default=0) + 1
    out = system.create(spark._jvm.org.apache.hadoop.fs.Path(path, f"{stem}_{number}.json"), False)
    out.write(bytearray(report.encode()))
    out.close()
    return number


def discover_reports(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """(number, report): the JSON documents ``stem_N.json`` of a folder, one row each; other files are left out."""
    files = spark.read.option("wholetext", True).text(f"{folder}/{stem}_*.json").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("report"))
    return files.select(F.regexp_extract("file", rf"^{re.escape(stem)}_(\d+)\.json$", 1).alias("n"), "report").where("n <> ''").select(F.col("n").cast("int").alias("number"), "report")


def next_number(reports: DataFrame) -> int:
    """The number of the next report: one more than the greatest, 1 if there is none."""
    return (reports.agg(F.max("number")).first()[0] or 0) + 1


def newest(reports: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest reports, newest first; the newest two are those to compare."""
    return reports.orderBy(F.desc("number")).limit(n)


def report_metrics(reports: DataFrame, field: str = "aggregate") -> DataFrame:
    """(number, metric, value) of a report's object of numbers."""
    m = F.from_json(F.get_json_object("report", f"$.{field}"), "map<string,double>")
    return reports.select("number", F.explode(m).alias("metric", "value"))


def compare_ordinals(bakeoff: DataFrame, iteration: DataFrame) -> DataFrame:
    """Two runs side by side by ordinal: (ordinal, query, score_a, score_b, delta); different query texts raise when the rows are read.

    Both: (ordinal, query, score).
    """
    j = bakeoff.select("ordinal", "query", F.col("score").alias("score_a")).join(iteration.select("ordinal", F.col("query").alias("other"), F.col("score").alias("score_b")), "ordinal", "left")
    same = F.when(ustrip(F.col("query")).eqNullSafe(ustrip(F.col("other"))), F.col("query")).otherwise(F.raise_error(F.concat(F.lit("other query at ordinal "), F.col("ordinal").cast("string"))).cast("string"))
    return j.select("ordinal", same.alias("query"), "score_a", "score_b", F.round(F.col("score_b") - F.col("score_a"), 6).alias("delta"))


def query_means(scores: DataFrame) -> DataFrame:
    """(query_id, mean) of (query_id, criterion, score), one decimal; a failed criterion counts as 0."""
    return scores.groupBy("query_id").agg(F.round(F.avg(F.coalesce("score", F.lit(0))), 1).alias("mean"))


def golden_id(n: int) -> str:
    return f"q{n:02d}" if 1 <= n <= 99 else f"q{n}"


def only_ids(spec: str) -> list[str]:
    """Ids of a list such as ``q21-q28,q3``: single ones and ranges (either way round), zero-padded, sorted; anything else raises."""
    out = set()
    for part in filter(None, (x.strip() for x in spec.split(","))):
        m = re.fullmatch(r"q(\d+)(?:\s*-\s*q(\d+))?", part, re.I)
        if not m:
            raise ValueError(f"neither an id nor a range: {part!r}")
        ends = sorted((int(m[1]), int(m[2] or m[1])))
        out |= {golden_id(n) for n in range(ends[0], ends[1] + 1)}
    if not out:
        raise ValueError("no ids")
    return sorted(out)


def filter_queries(queries: DataFrame, spec: str | None) -> tuple[DataFrame, DataFrame]:
    """The queries that were asked for, and (query_id) of those asked for that there are not; all if nothing was asked for."""
    if spec is None:
        return queries, queries.select("query_id").limit(0)
    asked = queries.sparkSession.createDataFrame([(i,) for i in only_ids(spec)], "query_id string")
    return queries.join(F.broadcast(asked), "query_id", "left_semi"), asked.join(queries.select("query_id"), "query_id", "left_anti")
