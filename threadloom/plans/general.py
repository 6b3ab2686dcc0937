"""Queries of the general training-data operators: orphan references, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.hierarchy import ancestor_pairs, descendant_counts, resolve_hierarchy
from threadloom.operators.references import comment_references, record_references, references_by_month
from threadloom.runtime import stored, table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return comment_references(table(spark, d, "comments"), table(spark, d, "posts"), table(spark, d, "removals"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select(F.col("child_id").alias("comment_id"), "ref_field", "ref_state")


def p4_by_month(spark: SparkSession, d: str) -> DataFrame:
    """Of both tables that refer to posts and comments."""
    chunks, comments = table(spark, d, "chunk_metadata"), table(spark, d, "comments")
    of_chunks = record_references(chunks, "chunk_id", comments, table(spark, d, "posts"), table(spark, d, "removals"), seen=None)
    return references_by_month(_orphans(spark, d), comments, "comments").unionByName(references_by_month(of_chunks, chunks, "chunk_metadata", "chunk_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(table(spark, d, "comments")).select(F.col("id").alias("comment_id"), "root_id", "node_depth")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(table(spark, d, "comments"), with_path=True)


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select(F.col("id").alias("comment_id"), "root_id", "node_depth", F.array_join("path", "/").alias("node_path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendant_counts(stored(_paths(spark, d))).withColumnRenamed("id", "comment_id")


def p6_descendant_pairs(spark: SparkSession, d: str) -> DataFrame:
    return ancestor_pairs(_paths(spark, d)).select("ancestor_id", F.col("id").alias("comment_id"), "distance")


QUERIES = {f.__name__: f for f in (p4_found, p4_by_month, p6_found, p6_paths, p6_descendants, p6_descendant_pairs)}

_P4 = r"""
with c as (select id, min(parent_id) parent_id, min(link_id) link_id, min(ingested_at) seen, min(created_utc) created_utc from comments where id is not null group by id),
refs as (select id, seen, created_utc, 'parent_id' ref_field, parent_id k from c union all select id, seen, created_utc, 'link_id', link_id from c),
t as (select 't3_' || id k, min(ingested_at) first_at, 'post' kind from posts group by 1
      union all select 't1_' || id, min(ingested_at), 'comment' from comments group by 1),
r as (select distinct fullname k from removals),
j as (select refs.*, t.first_at, t.k is not null as hit, r.k is not null as gone
      from refs left join t on refs.k = t.k and (t.kind = 'post' or ref_field = 'parent_id') left join r on refs.k = r.k
      where refs.k is not null and trim(refs.k) <> ''),
s as (select id, created_utc, ref_field, case when hit then case when first_at > seen then 'late' end when gone then 'deleted' else 'missing' end ref_state from j)
"""
_P4_CHUNKS = """, ck as (select chunk_id as id, min(parent_id) parent_id, min(link_id) link_id, min(created_utc) created_utc from chunk_metadata where chunk_id is not null group by 1),
kr as (select id, created_utc, 'parent_id' ref_field, parent_id k from ck union all select id, created_utc, 'link_id', link_id from ck),
ks as (select kr.*, case when t.k is not null then null when r.k is not null then 'deleted' else 'missing' end ref_state from kr left join t on kr.k = t.k and (t.kind = 'post' or ref_field = 'parent_id') left join r on kr.k = r.k where kr.k is not null and trim(kr.k) <> '')
"""
_P6 = """
with recursive c as (select id, min(parent_id) parent_id from comments where id is not null group by id),
e as (select c.id, c.parent_id, p.id as pid from c left join c p on c.parent_id = 't1_' || p.id),
walk as (
  select id, case when parent_id is null or trim(parent_id) = '' then 't1_' || id else parent_id end as root_id,
         case when parent_id is null or trim(parent_id) = '' then 0 else 1 end as node_depth, id as node_path
  from e where pid is null
  union all
  select e.id, walk.root_id, walk.node_depth + 1, walk.node_path || '/' || e.id from walk join e on e.pid = walk.id),
r as (select c.id as comment_id, coalesce(walk.root_id, 'cycle') as root_id, coalesce(walk.node_depth, -1)::int as node_depth, walk.node_path from c left join walk on c.id = walk.id),
pairs as (select unnest(string_split(node_path, '/'))  as ancestor_id, comment_id, len(string_split(node_path, '/')) as n, generate_subscripts(string_split(node_path, '/'), 1) as i from r where node_path is not null)
"""
SQL = {
    "p4_found": _P4 + "select id as comment_id, ref_field, ref_state from s where ref_state is not null",
    "p4_by_month": _P4 + _P4_CHUNKS + "select table_name, coalesce(strftime(make_timestamp(created_utc * 1000000), '%Y-%m'), 'unknown') as month, ref_field, ref_state, count(*) as n_refs from (select 'comments' as table_name, created_utc, ref_field, ref_state from s union all select 'chunk_metadata', created_utc, ref_field, ref_state from ks) where ref_state is not null group by all",
    "p6_found": _P6 + "select comment_id, root_id, node_depth from r",
    "p6_paths": _P6 + "select comment_id, root_id, node_depth, node_path from r",
    "p6_descendant_pairs": _P6 + "select ancestor_id, comment_id, (n - i)::int as distance from pairs where i < n",
    "p6_descendants": _P6 + ", below as (select ancestor_id, count(*) n, max(n - i) h from pairs where i < n group by 1) select r.comment_id, coalesce(below.n, 0)::bigint as n_descendants, coalesce(below.h, 0)::int as height from r left join below on r.comment_id = below.ancestor_id where r.node_depth >= 0",
}
