"""Parent-child rows to full hierarchies.

Frontier joins from the roots extend paths and depths level by level, several
levels a job; each job reads only the nodes that none has reached yet.  A level
that finds nothing ends the search: what is left lies on or below a cycle.  A
thread may be hundreds of levels deep, and a join a level would be all overhead
for its last few nodes; so after ``levels`` levels the nodes left carry an
ancestor pair (node, ancestor, distance) that doubles each round and closes as
soon as its ancestor is resolved: the rounds are the logarithm of the depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from threadloom.runtime import shuffle_partitions, stored

CYCLE = "cycle"


def resolve_hierarchy(nodes: DataFrame, *, prefix: str = "t1_", levels: int = 24, batch: int = 4, with_path: bool = False) -> DataFrame:
    """Root, depth and (optionally) path of every node.

    ``nodes``: (id, parent_id).  A parent is followed while it is exactly
    ``prefix`` + an existing id.  A top node with a null or blank parent is its
    own root (``prefix`` + id, depth 0); any other top node has the stored
    parent as root, whether or not that exists, and depth 1.  Chains that never
    end have root ``cycle``, depth -1 and a null path.

    Result: (id, root_id, node_depth, path); ``path`` lists the ids from the top
    node to the node itself, null unless asked for.  Null ids are left out; ids
    given twice count once (least parent); an empty table gives an empty result.
    """
    # min() of the parents: repeated rows agree, and a defined choice where they don't
    one = nodes.where("id is not null").groupBy("id").agg(F.min("parent_id").alias("parent_id"))
    keyed = one.withColumn("pid", F.when(F.col("parent_id").startswith(prefix), F.expr(f"substring(parent_id, {len(prefix) + 1})")))
    ids = one.select(F.col("id").alias("pid"), F.lit(True).alias("known"))
    edges = stored(keyed.join(ids, "pid", "left").select("id", "parent_id", F.when(F.col("known"), F.col("pid")).alias("pid")))

    blank = F.coalesce(F.col("parent_id"), F.lit("")).rlike(r"^(?U)[\s\x1c-\x1f]*$")
    none = F.lit(None).cast("array<string>")
    seg = F.array("id") if with_path else none
    top = edges.where("pid is null").select(
        "id",
        F.when(blank, F.concat(F.lit(prefix), "id")).otherwise(F.col("parent_id")).alias("root_id"),
        F.when(blank, 0).otherwise(1).cast("long").alias("node_depth"),
        seg.alias("path"),
    )
    below = edges.where("pid is not null").select("id", F.col("pid").alias("anc"), F.lit(1).cast("long").alias("dist"), seg.alias("seg"))

    def step(open_: DataFrame, frontier: DataFrame) -> DataFrame:
        f = frontier.select(F.col("id").alias("anc"), "root_id", "node_depth", "path")
        return open_.join(f, "anc").select("id", "root_id", (F.col("node_depth") + 1).alias("node_depth"), F.concat("path", "seg").alias("path"))

    tasks = shuffle_partitions(nodes.sparkSession)  # unions would add their tasks up
    out, frontier, open_, done = None, top, below, 0
    while True:
        parts = [frontier] if out is None else []
        for k in range(1, batch + 1):
            frontier = step(open_, frontier)
            parts.append(frontier.withColumn("level", F.lit(k)))
        every = parts[0] if out is not None else parts[0].withColumn("level", F.lit(0))
        for part in parts[1:]:
            every = every.unionByName(part)
        seen = Observation()  # counted as the table is written, without a job
        reached = stored(every.coalesce(tasks).observe(seen, F.count_if(F.col("level") == batch).alias("n")))
        out = reached.drop("level") if out is None else out.unionByName(reached.drop("level"))
        frontier = reached.where(f"level = {batch}").drop("level")
        done += batch
        open_ = stored(open_.join(reached.select("id"), "id", "left_anti").coalesce(tasks))
        moving = seen.get["n"] > 0
        if done >= levels or not moving:
            break
    out = out.withColumn("node_depth", F.col("node_depth").cast("int"))
    if not moving:  # nothing more is reached: what is open never ends
        return out.unionByName(open_.select("id", F.lit(CYCLE).alias("root_id"), F.lit(-1).alias("node_depth"), none.alias("path")))
    # the level after the frontier closes the open nodes' chains; nothing above it is needed again
    last = step(open_, frontier)
    state, left = _with_open(open_.join(last, "id", "left").coalesce(tasks))
    before = -1
    # a round closes every pair whose ancestor is closed; if it closed none, the open nodes only lead to each other
    while left not in (0, before):
        before = left
        upper = state.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("seg").alias("seg2"), F.col("root_id").alias("root2"), F.col("node_depth").alias("depth2"), F.col("path").alias("path2"))
        moved = state.where("root_id is null").drop("root_id", "node_depth", "path").join(upper, "anc")
        hit = F.col("root2").isNotNull()
        # a node that comes again above itself is on a cycle: closed, and its segment dropped
        again = ~hit & ((F.col("anc2") == F.col("id")) | F.coalesce(F.array_contains("seg2", F.col("id")), F.lit(False)))
        moved = moved.select(
            "id", F.when(hit, F.col("anc")).otherwise(F.col("anc2")).alias("anc"), F.when(hit, F.col("dist")).otherwise(F.col("dist") + F.col("dist2")).alias("dist"), F.when(~hit & ~again, F.concat("seg2", "seg")).alias("seg"),
            F.when(again, CYCLE).otherwise(F.col("root2")).alias("root_id"), F.when(again | (F.col("root2") == CYCLE), -1).otherwise(F.col("depth2") + F.col("dist")).alias("node_depth"), F.concat("path2", "seg").alias("path"),
        )
        state, left = _with_open(state.where("root_id is not null").select(*moved.columns).unionByName(moved).coalesce(tasks))
    cyclic = F.col("root_id").isNull() | (F.col("node_depth") < 0)
    deep = state.select("id", F.when(cyclic, CYCLE).otherwise(F.col("root_id")).alias("root_id"), F.when(cyclic, -1).otherwise(F.col("node_depth")).cast("int").alias("node_depth"), F.when(~cyclic, F.col("path")).alias("path"))
    return out.unionByName(deep)


def _with_open(state: DataFrame) -> tuple[DataFrame, int]:
    """A state as a table, and how many of its nodes are open."""
    seen = Observation()
    table = stored(state.observe(seen, F.count_if(F.col("root_id").isNull()).alias("n")))
    return table, seen.get["n"]


def ancestor_pairs(resolved: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance) of every node below another one, from the paths.

    Nodes of cyclic chains have no path and give no pairs.
    """
    pairs = resolved.where("path is not null").select("id", F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor_id"))
    return pairs.where("pos < n - 1").select("ancestor_id", "id", (F.col("n") - 1 - F.col("pos")).alias("distance"))


def descendant_counts(resolved: DataFrame) -> DataFrame:
    """(id, n_descendants, height) of every node that is not on or below a cycle."""
    below = ancestor_pairs(resolved).groupBy("ancestor_id").agg(F.count("*").alias("n"), F.max("distance").alias("h"))
    r = resolved.where("node_depth >= 0").select("id")
    return r.join(below, r.id == below.ancestor_id, "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_descendants"), F.coalesce("h", F.lit(0)).cast("int").alias("height"))
