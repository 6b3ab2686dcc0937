"""Orphan references and hierarchies on small tables, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators.hierarchy import ancestor_pairs, descendant_counts, resolve_hierarchy
from threadloom.operators.references import comment_references, orphan_references, probe, references_by_month
from threadloom.runtime import stored

T = [dt.datetime(2024, 1, d) for d in range(1, 20)]
COMMENTS = "id string, parent_id string, link_id string, created_utc long, ingested_at timestamp, key string, rng int"


def _tables(spark, comments):
    rows = [(*c, "clash", 7) for c in comments]
    posts = spark.createDataFrame([("p1", T[0], 1), ("p1", T[5], 1), ("p2", T[9], 2)], "id string, ingested_at timestamp, h int")
    gone = spark.createDataFrame([("t3_gone", T[1]), ("t1_gone", T[1]), (None, T[1])], "fullname string, removed_at timestamp")
    return spark.createDataFrame(rows, COMMENTS), posts, gone


def test_states_of_references(spark):
    c, p, g = _tables(spark, [
        ("a", "t3_p1", "t3_p1", 1704067200, T[3]), ("a", "t3_p1", "t3_p1", None, T[8]),
        ("b", "t1_a", "t3_p2", None, T[4]), ("c", "t1_gone", "t3_gone", 1, T[4]), ("d", "t1_none", "t1_a", 1, T[4]),
        ("e", None, " ", 1, T[4]), ("f", "", " ", 1, T[4]), (None, "t3_x", "t3_x", 1, T[4]), ("g", "t3_p1 ", "t1_gone", 1, T[4]), ("h", "t3_p2", "t3_p2", 1, None),
    ])
    got = {(r.child_id, r.ref_field, r.ref_state) for r in comment_references(c, p, g, refs_per_task=2).collect()}
    assert got == {("b", "link_id", "late"), ("c", "parent_id", "deleted"), ("c", "link_id", "deleted"), ("d", "parent_id", "missing"), ("d", "link_id", "missing"), ("g", "parent_id", "missing"), ("g", "link_id", "deleted")}
    months = references_by_month(comment_references(c, p, g), c, "comments").collect()
    assert sum(r.n_refs for r in months) == 7 and {r.month for r in months} == {"unknown", "1970-01"}


def test_references_of_empty_tables(spark):
    c, p, g = _tables(spark, [("a", "t3_p1", "t3_p1", 1, T[3])])
    assert comment_references(c.limit(0), p, g).count() == 0
    assert {r.ref_state for r in comment_references(c, p.limit(0), g.limit(0)).collect()} == {"missing"}


def test_hot_reference_is_cut(spark):
    refs = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("child_id"), F.lit("parent_id").alias("ref_field"), F.when(F.col("id") % 3 == 0, "x").otherwise("t3_hot").alias("ref_key"), F.lit(T[5]).alias("child_at"))
    targets = spark.createDataFrame([("t3_hot", T[6])], "key string, seen_at timestamp")
    got = orphan_references(refs, targets, targets.select("key").limit(0), refs_per_task=100)
    assert {(r.ref_state, r["count"]) for r in got.groupBy("ref_state").count().collect()} == {("late", 2000), ("missing", 1000)}


def test_probe_steps_over_equal_hashes():
    hashes, keys = np.array([1, 5, 5, 5, 9]), np.array(["a", "b", "c", "d", "e"], object)
    got = probe(hashes, keys, np.array([5, 5, 5, 9, 7, 10]), np.array(["d", "b", "zz", "e", "e", "q"], object))
    assert got.tolist() == [3, 1, -1, 4, -1, -1]
    assert probe(hashes[:0], keys[:0], np.array([5]), np.array(["d"], object)).tolist() == [-1]


def brute(parents):
    out = {}
    for i in parents:
        path, x, seen = [], i, set()
        while True:
            if x in seen:
                out[i] = ("cycle", -1, None)
                break
            seen.add(x)
            path.append(x)
            p = parents[x]
            if p and p.startswith("t1_") and p[3:] in parents:
                x = p[3:]
                continue
            own = p is None or not p.strip()
            out[i] = (f"t1_{x}" if own else p, len(path) - own, path[::-1])
            break
    return out


@pytest.mark.parametrize(("levels", "batch"), [(8, 4), (512, 8), (3, 1)])
def test_hierarchy_against_brute_force(spark, levels, batch):
    rnd = random.Random(5)
    parents = {"r0": None, "r1": "  ", "r2": "t3_x", "r3": "t1_absent", "s": "t1_s", "u": "t1_v", "v": "t1_w", "w": "t1_u", "below": "t1_u"}
    for i in range(150):
        parents[f"n{i}"] = f"t1_n{i - 1}" if i else "t3_deep"
    for i in range(300):
        parents[f"m{i}"] = "t1_" + rnd.choice(list(parents))
    rows = [(k, v, "x") for k, v in parents.items()] + [("n7", parents["n7"], "x"), (None, "t3_x", "x")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, anc string")
    want = brute(parents)
    r = stored(resolve_hierarchy(nodes, levels=levels, batch=batch, with_path=True))
    got = {x.id: (x.root_id, x.node_depth, x.path) for x in r.collect()}
    assert got == want
    pairs = {(x.ancestor_id, x.id, x.distance) for x in ancestor_pairs(r).collect()}
    assert pairs == {(p[i], k, len(p) - 1 - i) for k, (_, _, p) in want.items() if p for i in range(len(p) - 1)}
    counts = {x.id: x.n_descendants for x in descendant_counts(r).collect()}
    assert counts == {k: sum(a == k for a, _, _ in pairs) for k, v in want.items() if v[1] >= 0}


def test_hierarchy_of_an_empty_table(spark):
    assert resolve_hierarchy(spark.createDataFrame([], "id string, parent_id string")).count() == 0
