"""References to records that do not exist.

Keys are range-partitioned over the 64-bit hash order, so the ranges are even
by construction and need no sample.  Each range keeps its target keys as one
sorted array; batches of references probe it by binary search.  Ranges that
hold very many references (one hot thread) are cut by a salt of the referring
id, their targets being copied to each cut.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.runtime import estimated_bytes, shuffle_partitions, tz

REFERENCE_SCHEMA = "child_id string, ref_field string, ref_key string, ref_state string"
#: Code points that count as white space; F.trim knows U+0020 only.
BLANK = r"^(?U)[\s\x1c-\x1f]*$"


def hash_range(key: Column, ranges: int) -> Column:
    """The range of a key among equal slices of the 64-bit hash order."""
    return F.least(F.floor((F.xxhash64(key) / F.lit(2.0**64) + 0.5) * ranges), F.lit(ranges - 1)).cast("int")


def probe(sorted_hashes: np.ndarray, keys: np.ndarray, ref_hashes: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Position of each reference among the sorted targets, -1 where it has none.

    Targets of equal hash stand side by side; the search steps along them until
    the strings agree, so a hash collision never makes a reference resolve.
    """
    out = np.full(len(refs), -1, dtype=np.int64)
    if not len(keys):
        return out
    pos = np.searchsorted(sorted_hashes, ref_hashes)
    open_ = np.arange(len(refs))
    while len(open_):
        p = pos[open_]
        inside = p < len(keys)
        open_, p = open_[inside], p[inside]
        same_hash = sorted_hashes[p] == ref_hashes[open_]
        open_, p = open_[same_hash], p[same_hash]
        hit = keys[p] == refs[open_]
        out[open_[hit]] = p[hit]
        open_ = open_[~hit]
        pos[open_] += 1
    return out


def _probe_range(late_after: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(targets: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(targets["h"].to_numpy(), kind="stable")
        hashes = targets["h"].to_numpy(np.int64)[order]
        keys = targets["key"].to_numpy(object)[order]
        first = targets["first_at"].to_numpy(np.float64, na_value=np.nan)[order]
        exists = targets["is_there"].to_numpy(bool)[order]
        at = probe(hashes, keys, refs["h"].to_numpy(np.int64), refs["ref_key"].to_numpy(object))
        known = at >= 0
        there = known.copy()
        there[known] = exists[at[known]]
        state = np.where(known & ~there, "deleted", np.where(there, "ok", "missing")).astype(object)
        if late_after and there.any():
            idx = np.flatnonzero(there)
            own = refs["child_at"].to_numpy(np.float64, na_value=np.nan)[idx]
            state[idx[first[at[idx]] > own]] = "late"
        bad = state != "ok"
        return pd.DataFrame({"child_id": refs["child_id"][bad], "ref_field": refs["ref_field"][bad], "ref_key": refs["ref_key"][bad], "ref_state": state[bad]})

    return run


def orphan_references(refs: DataFrame, targets: DataFrame, removed: DataFrame, *, keys_per_range: int = 500_000, refs_per_task: int = 500_000) -> DataFrame:
    """References that do not resolve, with the reason.

    ``refs``: (child_id, ref_field, ref_key, child_at); ``targets``: (key,
    seen_at), an entry for every record that exists; ``removed``: (key).
    A reference is ``late`` if its target's earliest ``seen_at`` is after
    ``child_at``; unresolved ones are ``deleted`` when named by ``removed``,
    else ``missing``.  Null and blank references, and rows without a child id,
    are no cases; null times never make a reference late; repeated rows count
    once; empty tables give no or only missing references.
    """
    spark = refs.sparkSession
    live = targets.where("key is not null").select("key", F.unix_micros(tz("seen_at")).alias("t"), F.lit(1).alias("e"))
    gone = removed.where("key is not null").select("key", F.lit(None).cast("long").alias("t"), F.lit(0).alias("e"))
    # the number of ranges needs the order of magnitude only: a key and its time take some 24 bytes
    size = estimated_bytes(targets)
    keys = targets.count() if size is None else size // 24
    ranges = max(shuffle_partitions(spark), keys // keys_per_range + 1)
    known = live.unionByName(gone).groupBy("key").agg(F.min("t").alias("first_at"), (F.max("e") == 1).alias("is_there"))
    known = known.withColumn("h", F.xxhash64("key")).withColumn("rng", hash_range(F.col("key"), ranges))
    asked = (
        refs.where(F.col("child_id").isNotNull() & F.col("ref_key").isNotNull() & ~F.col("ref_key").rlike(BLANK))
        .select("child_id", "ref_field", "ref_key", F.unix_micros(tz("child_at")).alias("child_at"))
        .withColumn("h", F.xxhash64("ref_key"))
        .withColumn("rng", hash_range(F.col("ref_key"), ranges))
    )
    # at most `ranges` rows, whatever the data: safe to broadcast
    cuts = F.broadcast(asked.groupBy("rng").agg(F.ceil(F.count("*") / refs_per_task).cast("int").alias("cuts")))
    asked = asked.join(cuts, "rng").withColumn("cut", F.pmod(F.xxhash64("child_id"), F.col("cuts")).cast("int")).drop("cuts")
    known = known.join(cuts, "rng").withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
    return known.groupBy("rng", "cut").cogroup(asked.groupBy("rng", "cut")).applyInPandas(_probe_range(True), REFERENCE_SCHEMA)


#: Goes before a key that a field cannot resolve to, so that it only meets its removal.
APART = "\x00"


def record_references(rows: DataFrame, key: str, comments: DataFrame, posts: DataFrame, removals: DataFrame, *, seen: str | None = "ingested_at", **kw) -> DataFrame:
    """Orphan references of a table with ``parent_id`` (to posts or comments) and ``link_id`` (to posts).

    A repeated key counts once, at its earliest ``seen``; without ``seen`` no
    reference is late.
    """
    at = F.min(tz(seen)) if seen else F.lit(None).cast("timestamp")
    one = rows.groupBy(key).agg(F.min("parent_id").alias("parent_id"), F.min("link_id").alias("link_id"), at.alias("child_at"))
    # a link names posts only: one that names a comment is looked up among the removals alone
    link = F.when(F.col("link_id").startswith("t1_"), F.concat(F.lit(APART), "link_id")).otherwise(F.col("link_id"))
    refs = one.select(F.col(key).alias("child_id"), "child_at", F.explode(F.create_map(F.lit("parent_id"), F.col("parent_id"), F.lit("link_id"), link)).alias("ref_field", "ref_key"))
    targets = posts.select(F.concat(F.lit("t3_"), "id").alias("key"), F.col("ingested_at").alias("seen_at")).unionByName(comments.select(F.concat(F.lit("t1_"), "id").alias("key"), F.col("ingested_at").alias("seen_at")))
    gone = removals.select(F.explode(F.array(F.col("fullname"), F.when(F.col("fullname").startswith("t1_"), F.concat(F.lit(APART), "fullname")))).alias("key"))
    out = orphan_references(refs, targets, gone, **kw)
    return out.withColumn("ref_key", F.ltrim("ref_key", F.lit(APART)))


def comment_references(comments: DataFrame, posts: DataFrame, removals: DataFrame, **kw) -> DataFrame:
    """Orphan references of a comment table; see :func:`record_references`."""
    return record_references(comments, "id", comments, posts, removals, **kw)


def references_by_month(orphans: DataFrame, rows: DataFrame, table_name: str, key: str = "id") -> DataFrame:
    """Counts per table, month of the referring row (UTC, ``unknown`` if null), field and state."""
    month = rows.groupBy(key).agg(F.min("created_utc").alias("created_utc")).select(F.col(key).alias("child_id"), F.coalesce(F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM"), F.lit("unknown")).alias("month"))
    return orphans.join(month, "child_id").groupBy(F.lit(table_name).alias("table_name"), "month", "ref_field", "ref_state").agg(F.count("*").alias("n_refs"))
