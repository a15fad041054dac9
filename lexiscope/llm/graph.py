"""Connected components by alternating large-star and small-star contractions.

Every round is a handful of equi-joins and partial aggregates on the edge list; nothing is collected but one
row of counters a round.  Both sides of every join on a node are plain written tables, so adaptive execution can
split the rows of a hub over many tasks, and minima are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexiscope.llm.runtime import discard, materialize

#: Tasks of a round at least, and edges a task beyond that.
LEAST_TASKS, TASK_EDGES = 8, 50_000


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges, written, and their count and hashes, observed on the way."""
    seen = Observation()
    kinds = F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("bit_xor(xxhash64(v, u, 7))").alias("y")
    table = materialize(edges.observe(seen, *kinds), name)
    row = seen.get
    return table, (row["n"], row["x"], row["y"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, root)`` for each node that an edge touches; ``root`` is the smallest node that can be reached.

    Edges with a null end and loops are ignored; repeated edges and either direction count once; no edges
    give no rows.  Nodes may be of any orderable type.
    """
    flat = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    flat = flat.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, stamp = _written(flat.distinct(), "edges")
    while stamp[0]:
        # Never more rows than edges, which don't grow in number: a small graph takes few tasks, a large one all.
        few = max(LEAST_TASKS, stamp[0] // TASK_EDGES)
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(now.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = materialize(both.groupBy("x").agg(F.min("y").alias("lowest")).select(F.col("x").alias("v"), F.least("x", "lowest").alias("m")).coalesce(few), "lowest")
        large = materialize(now.join(low, "v").select("u", F.col("m").alias("v")).distinct().coalesce(few), "large-star")
        down = materialize(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few), "parents")
        small = large.join(down, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = stamp
        then, stamp = _written(down.select("u", F.col("m").alias("v")).unionByName(small).distinct().coalesce(few), "edges")
        discard(now, low, large, down)
        now = then
        if stamp == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
