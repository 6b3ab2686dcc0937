"""Queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.llm.common import keyed_text, one_per_key
from threadloom.llm.leakage import find_leaks
from threadloom.llm.near_duplicates import duplicate_classes, similar_records
from threadloom.llm.personal_data import find_personal_data
from threadloom.llm.shared_spans import shared_pairs, shared_share
from threadloom.llm.splitting import MAX_CHARS, MAX_TOKENS, split_texts
from threadloom.llm.text_quality import text_statistics, text_tokens
from threadloom.llm.tokenization import decode_corpus, encode_corpus
from threadloom.runtime import spread, table


def _comments(spark, d):
    return one_per_key(keyed_text(table(spark, d, "comments"), "comments", "id", "body"))


def _posts(spark, d):
    return one_per_key(keyed_text(table(spark, d, "posts"), "posts", "id", "selftext"))


def _chunks(spark, d):
    return one_per_key(keyed_text(table(spark, d, "chunk_metadata"), "chunk_metadata", "chunk_id", "text"))


def _delivered(spark, d):
    """Comment bodies and post texts as delivered, repeated ids and all."""
    rows = keyed_text(table(spark, d, "comments"), "comments", "id", "body").unionByName(keyed_text(table(spark, d, "posts"), "posts", "id", "selftext"))
    return spread(rows.where("row_key is not null"))


def _bodies_and_chunks(spark, d):
    return keyed_text(table(spark, d, "comments"), "comments", "id", "body").unionByName(keyed_text(table(spark, d, "chunk_metadata"), "chunk_metadata", "chunk_id", "text"))


def _personal(spark, d, rows, **kw):
    return find_personal_data(rows, table(spark, d, "given_names"), table(spark, d, "common_words"), **kw)


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_records(_bodies_and_chunks(spark, d), n=3, threshold=0.5)


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_classes(_bodies_and_chunks(spark, d), n=3, threshold=0.5)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    common = table(spark, d, "common_words")
    bodies = text_statistics(spread(keyed_text(table(spark, d, "comments"), "comments", "id", "body").where("row_key is not null")), common)
    junk = bodies.where("not is_prose").select("table_name", "row_key")
    chunks = table(spark, d, "chunk_metadata").where("chunk_id is not null")
    counted = text_tokens(spread(chunks.select(F.lit("chunk_metadata").alias("table_name"), F.col("chunk_id").alias("row_key"), "text", "word_count")), carry="word_count")
    wrong = counted.where("word_count is null or word_count <> n_tokens").select("table_name", "row_key")
    return junk.distinct().unionByName(wrong.distinct())


def p2_statistics(spark: SparkSession, d: str) -> DataFrame:
    every = _comments(spark, d).unionByName(_chunks(spark, d))
    return text_statistics(every, table(spark, d, "common_words"))


def p2_measures(spark: SparkSession, d: str) -> DataFrame:
    """The measures that need no rule, of every comment and chunk."""
    shares = ("mean_word_len", "symbol_ratio", "end_punct_share", "common_share", "dup_line_share")
    return p2_statistics(spark, d).select("table_name", "row_key", "n_chars", "n_tokens", "n_words", *(F.round(c, 6).alias(c) for c in shares))


def p2_word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose recorded word count is missing or wrong, with the true one."""
    chunks = table(spark, d, "chunk_metadata").where("chunk_id is not null")
    counted = text_tokens(spread(chunks.select(F.lit("chunk_metadata").alias("table_name"), F.col("chunk_id").alias("row_key"), "text", "word_count")), carry="word_count")
    return counted.where("word_count is null or word_count <> n_tokens").select("row_key", "word_count", "n_tokens").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = _personal(spark, d, _delivered(spark, d))
    kinds = found.select("table_name", "row_key", F.explode(F.array_distinct("found.pii_kind")).alias("pii_kind"))
    return kinds.where("pii_kind <> 'account'").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _personal(spark, d, _comments(spark, d).unionByName(_posts(spark, d))).select("table_name", "row_key", "redacted", F.size("found").alias("n_found"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_texts(_delivered(spark, d))
    return pieces.where(f"n_tokens > {MAX_TOKENS} or n_chars > {MAX_CHARS}").select("table_name", "row_key").distinct()


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(spread(_comments(spark, d).unionByName(_posts(spark, d))))


def p5_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of every text that has pieces: its counts, whether all pieces keep the limits, and whether they leave out white space only."""
    key = ["table_name", "row_key"]
    texts = spread(_comments(spark, d).unionByName(_posts(spark, d)))
    order = Window.partitionBy(*key).orderBy("piece_index")
    pieces = split_texts(texts).withColumn("from", F.coalesce(F.lag("end_char").over(order), F.lit(0))).withColumn("upto", F.lead("start_char").over(order))
    token = r"(?U)[^\s\x1c-\x1f]+"
    within = (F.length("piece") <= MAX_CHARS) & (F.size(F.regexp_extract_all("piece", F.lit(f"({token})"), 1)) <= MAX_TOKENS)
    spans = pieces.groupBy(*key).agg(F.first("n_chars").alias("n_chars"), F.first("n_tokens").alias("n_tokens"), F.min(within).alias("within"), F.collect_list(F.struct("from", "start_char", "end_char", "upto")).alias("s"))
    cut = lambda a, b: ~F.substring(F.col("text"), (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).rlike(token)
    whole = F.forall("s", lambda x: cut(x["from"], x["start_char"]) & F.when(x["upto"].isNull(), cut(x["end_char"], F.col("n_chars"))).otherwise(True))
    return spans.join(texts, key).select(*key, "n_chars", "n_tokens", "within", whole.alias("complete"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    back = decode_corpus(encode_corpus(docs)).withColumnRenamed("text", "decoded")
    joined = docs.select("doc_id", "text").join(back, "doc_id")
    return joined.select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _leaks(spark, d):
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_pairs(_texts(spark, d))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    return shared_share(_texts(spark, d)).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_statistics, p2_measures, p2_word_counts, p3_found, p3_redacted, p5_found, p5_pieces, p5_checked, p7_ids, p7_roundtrip, p8_found, p8_spans, p9_found, p9_shared)}

_WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\pL\pN]+'), lambda x: x <> '')"

_LONG = f"""
with t as (select 'comments' as table_name, id as row_key, min(body) as text from comments where id is not null group by id
           union all select 'posts', id, min(selftext) from posts where id is not null group by id),
n as (select table_name, row_key, length(text)::bigint as n_chars, len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> ''))::bigint as n_tokens from t where text is not null)
"""

SQL = {
    "p5_found": _LONG + "select table_name, row_key from n where n_chars > 2400 or n_tokens > 300",
    "p5_checked": _LONG + "select *, true as within, true as complete from n where n_tokens > 0 or n_chars > 2400",
    "p1_found": f"""
with t as (select distinct 'comments' as table_name, id as k, body as x from comments where id is not null and body is not null
           union all select distinct 'chunk_metadata', chunk_id, text from chunk_metadata where chunk_id is not null and text is not null),
w as (select table_name, k, {_WORDS.format("x")} as w from t), ok as (select * from w where len(w) >= 40),
g as (select distinct table_name, k, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from ok),
n as (select table_name, k, count(*) as n from g group by all),
p as (select a.table_name, a.k as ka, b.k as kb, count(*) as c from g a join g b on a.table_name = b.table_name and a.gram = b.gram and a.k < b.k group by all)
select p.table_name, ka as key_a, kb as key_b from p join n na on na.table_name = p.table_name and na.k = ka join n nb on nb.table_name = p.table_name and nb.k = kb where c >= 0.5 * (na.n + nb.n - c)""",
    "p1_classes": f"""
with t as (select distinct 'comments' as table_name, id as k, body as x from comments where id is not null and body is not null
           union all select distinct 'chunk_metadata', chunk_id, text from chunk_metadata where chunk_id is not null and text is not null),
w as (select table_name, k, x, {_WORDS.format("x")} as w from t), ok as (select * from w where len(w) >= 40),
c as (select table_name, x, min(k) as ck, count(*) as copies, any_value(w) as w from ok group by all),
g as (select distinct table_name, ck, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from c),
n as (select table_name, ck, count(*) as n from g group by all),
p as (select a.table_name, a.ck as ka, b.ck as kb, count(*) as c from g a join g b on a.table_name = b.table_name and a.gram = b.gram and a.ck <> b.ck group by all),
l as (select p.table_name, ka as ck, count(*) as links from p join n na on na.table_name = p.table_name and na.ck = ka join n nb on nb.table_name = p.table_name and nb.ck = kb where c >= 0.5 * (na.n + nb.n - c) group by all)
select ok.table_name, ok.k as row_key, c.ck as class_key, coalesce(links, 0)::bigint as n_links from ok join c using (table_name, x) left join l on l.table_name = c.table_name and l.ck = c.ck where copies > 1 or links > 0""",
    "p8_found": f"""
with i as (select item_id, {_WORDS.format("text")} as w from eval_items), d as (select doc_id, {_WORDS.format("text")} as w from documents where text is not null),
ig as (select distinct item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) as g from i where len(w) >= 13),
dg as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) as g from d where len(w) >= 13)
select distinct item_id, doc_id from ig join dg using (g)""",
    "p9_found": """
with d as (select doc_id, text, unnest(range(1, length(text) - 298)) as i from documents where length(text) >= 300),
h as (select distinct doc_id, md5(substring(text, i, 300)) as h from d)
select distinct a.doc_id as doc_a, b.doc_id as doc_b from h a join h b on a.h = b.h and a.doc_id < b.doc_id""",
    "p9_shared": """
with d as (select doc_id, text, unnest(range(1, length(text) - 298)) as i from documents where length(text) >= 300),
h as (select doc_id, i, md5(substring(text, i, 300)) as h from d), s as (select h from h group by h having count(distinct doc_id) > 1),
k as (select distinct doc_id, i from h semi join s using (h)), c as (select doc_id, least(300, coalesce(lead(i) over (partition by doc_id order by i) - i, 300)) as c from k)
select doc_id, any_value(length(text))::bigint as n_chars, sum(c)::bigint as shared_chars, round(sum(c) / any_value(length(text)), 6) as shared_share from c join documents using (doc_id) group by doc_id""",
    "p8_spans": rf"""
with i as (select item_id, {_WORDS.format("text")} as w from eval_items), d0 as (select doc_id, text, lower(text) as low from documents where text is not null),
d as (select *, {_WORDS.format("text")} as w from d0),
ig as (select distinct item_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) as g from i where len(w) >= 13),
dg as (select doc_id, unnest(range(0, len(w) - 12)) as pos, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i : i + 12], ' '))) as g from d where len(w) >= 13),
hit as (select distinct item_id, doc_id, pos from ig join dg using (g)),
isl as (select *, sum(new) over (partition by item_id, doc_id order by pos) as g from (select *, case when pos - lag(pos) over (partition by item_id, doc_id order by pos) <= 13 then 0 else 1 end as new from hit)),
span as (select item_id, doc_id, min(pos)::bigint as word_from, max(pos)::bigint + 13 as word_to from isl group by item_id, doc_id, g),
part as (select doc_id, unnest(p) as p, unnest(range(len(p))) as k from (select doc_id, regexp_extract_all(low, '[\pL\pN]+|[^\pL\pN]+') as p from d0 where doc_id in (select doc_id from span))),
place as (select doc_id, p, sum(length(p)) over (partition by doc_id order by k) - length(p) as c, regexp_matches(p, '^[\pL\pN]') as word, k from part),
wd as (select doc_id, c::bigint as s, (c + length(p))::bigint as e, row_number() over (partition by doc_id order by k) - 1 as n from place where word),
ok as (select doc_id, length(low) = length(text) as same from d0)
select item_id, span.doc_id, word_from, word_to, case when same then a.s end as char_from, case when same then b.e end as char_to
from span join wd a on a.doc_id = span.doc_id and a.n = word_from join wd b on b.doc_id = span.doc_id and b.n = word_to - 1 join ok on ok.doc_id = span.doc_id""",
    "p2_word_counts": f"""select distinct chunk_id as row_key, word_count, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> ''))::bigint as n_tokens from chunk_metadata
 where chunk_id is not null and (word_count is null or word_count <> len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}'), lambda x: x <> '')))""",
    "p2_measures": rf"""
with t as (select 'comments' as table_name, id as row_key, coalesce(min(body), '') as x from comments where id is not null group by id
           union all select 'chunk_metadata', chunk_id, coalesce(min(text), '') from chunk_metadata where chunk_id is not null group by chunk_id),
w as (select *, {_WORDS.format("x")} as w, list_filter(regexp_split_to_array(x, '{_WS}'), lambda y: y <> '') as tok,
 list_filter(list_transform(regexp_split_to_array(x, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda y: regexp_replace(regexp_replace(y, '^{_WS}', ''), '{_WS}$', '')), lambda y: y <> '') as ln from t),
m as (select *, list_sum(list_transform(w, lambda y: length(y))) as letters, list_sum(list_transform(tok, lambda y: length(y))) as solid, (select list(lower(word)) from common_words where word is not null) as common from w)
select table_name, row_key, length(x)::bigint as n_chars, len(tok)::bigint as n_tokens, len(w)::bigint as n_words,
 round(case when len(w) > 0 then letters / len(w) else 0 end, 6) as mean_word_len, round(case when solid > 0 then (solid - coalesce(letters, 0)) / solid else 0 end, 6) as symbol_ratio,
 round(case when len(ln) > 0 then len(list_filter(ln, lambda y: contains('.!?…。！？"''”’)', right(y, 1)))) / len(ln) else 0 end, 6) as end_punct_share,
 round(case when len(w) > 0 then len(list_filter(w, lambda y: list_contains(common, y))) / len(w) else 0 end, 6) as common_share,
 round(case when len(ln) < 2 then 0 else (list_sum(list_transform(ln, lambda y: length(y))) - list_sum(list_transform(list_distinct(ln), lambda y: length(y)))) / list_sum(list_transform(ln, lambda y: length(y))) end, 6) as dup_line_share from m""",
    "p7_roundtrip": "select doc_id, true as same from documents",
}
