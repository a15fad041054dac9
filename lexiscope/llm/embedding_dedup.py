"""Embedding near-dedup by int8 quantised tile products with rigorous error bounds.

Copies of a vector are one row with a count.  Distinct vectors are dealt to blocks by hash, and each pair of
blocks is one group; a block holds up to BLOCK vectors (or BLOCK_BYTES), so a vector is sent to few groups, in the
type that the table has.  In a group the unit vectors of each block are quantised to int8 once and multiplied as
integers, tile by tile (exactly, in float32 while dimension * 127^2 < 2^24, else in float64).  For vector i with
quantised part q_i (length A_i) and quantisation error e_i (length E_i), the true cosine lies within

    (A_i + E_i) * E_j + E_i * A_j

of the quantised product, so only pairs whose product plus bound reaches the threshold are recomputed, from
the full-precision vectors in double precision.  A group returns one row per vector that links: how many
vectors it links with there, and one neighbour in a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.graph import connected_components
from lexiscope.llm.runtime import by_value, materialize

by_value(__name__)

TILE, ROWS_AT_ONCE, PAIRS_AT_ONCE = 2048, 512, 1 << 15
#: Most vectors of a block, most bytes of its unit vectors, and blocks that a table of many vectors has at least, so
#: that its pairs are work for many tasks.
BLOCK, BLOCK_BYTES, LEAST_BLOCKS = 1 << 15, 1 << 25, 12
#: Slack for rounding in the bound's own arithmetic and in float32 comparisons.
SLACK = 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, safe against overflow and underflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantised:
    """Int8 values of unit rows on one scale, and per row the lengths of quantised part and error."""

    def __init__(self, rows: np.ndarray):
        self.scale = np.abs(rows).max() / 127
        self.q = np.rint(rows / self.scale).astype(np.int8)
        back = self.q * self.scale
        self.part = np.sqrt((back * back).sum(axis=1))
        self.error = np.sqrt(((rows - back) ** 2).sum(axis=1))


def tile_links(x: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Links between the unit rows ``left`` and ``right`` of ``x`` (all pairs i < j if they are the same rows).

    Returns per row the weight of its linked rows, per row a representative that links reach, and how many
    pairs were recomputed in double precision.
    """
    same = left is right
    a = Quantised(x[left])
    b = a if same else Quantised(x[right])
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    columns = b.q.astype(kind).T.copy()
    most_part, most_error = b.part.max(), b.error.max()
    linked, root, checked = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    for at in range(0, len(left), ROWS_AT_ONCE):
        rows = slice(at, at + ROWS_AT_ONCE)
        least = (threshold - (a.part[rows] + a.error[rows]) * most_error - a.error[rows] * most_part - SLACK) / (a.scale * b.scale)
        mine = a.q[rows].astype(kind)
        for over in range(at // TILE * TILE if same else 0, len(right), TILE):
            i, j = np.nonzero((mine @ columns[:, over : over + TILE]) >= least[:, None].astype(kind) - 1)
            i, j = i + at, j + over
            if same:
                i, j = i[j > i], j[j > i]
            for k in range(0, len(i), PAIRS_AT_ONCE):
                p, q = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
                product = np.einsum("ij,ij->i", a.q[p].astype(kind), b.q[q].astype(kind)).astype(np.float64) * (a.scale * b.scale)
                bound = (a.part[p] + a.error[p]) * b.error[q] + a.error[p] * b.part[q] + SLACK
                close = product + bound >= threshold
                u, v = left[p[close]], right[q[close]]
                checked += len(u)
                true = (x[u] * x[v]).sum(axis=1) >= threshold
                u, v = u[true], v[true]
                linked += np.bincount(u, weight[v], len(x)).astype(np.int64) + np.bincount(v, weight[u], len(x)).astype(np.int64)
                while len(u):
                    low = np.minimum(root[u], root[v])
                    np.minimum.at(root, root[u], low)
                    np.minimum.at(root, root[v], low)
                    while (root[root] != root).any():
                        root = root[root]
                    u, v = u[root[u] != root[v]], v[root[u] != root[v]]
    return linked, root, checked


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int | None = None) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are their
    own component; vectors of different lengths never link; repeated rows link with each other and come out
    repeated; a null id is carried, and its row is kept only if its component's ids are all null; an empty
    table gives no rows.  Other columns are not read.
    """
    x = F.col("embedding")
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(~odd & F.exists(x, lambda v: v != 0), F.lit(False))
    #: Adding zero turns -0.0 into 0.0, so that equal vectors have one key.
    plain = F.transform(x, lambda v: v.cast("double") + 0.0)
    key = F.when(usable, F.concat(F.hex(F.xxhash64(plain)), F.hex(F.xxhash64(F.lit(1), plain)), F.size(x).cast("string")))
    keyed = rows.withColumn("key", key)
    distinct = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    distinct = materialize(distinct, "distinct-vectors")
    n, longest = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    most = block or max(1, min(BLOCK, BLOCK_BYTES // (8 * (longest or 1))))
    tiles = max(1, -(-n // most), 1 if block else min(LEAST_BLOCKS, n // TILE))

    own = F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int")
    spread = distinct.select("key", "copies", "embedding", F.size("embedding").alias("length"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
    spread = spread.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("other")

    def compare(key, table):
        n = table.num_rows
        flat = table.column("embedding").combine_chunks()
        values = unit(np.asarray(flat.flatten()).astype(np.float64).reshape(n, -1))
        where = table.column("own").to_numpy()
        first = np.flatnonzero(where == key[1].as_py())
        second = first if key[1].as_py() == key[2].as_py() else np.flatnonzero(where == key[2].as_py())
        if not len(first) or not len(second):
            hit, linked, root = np.zeros(0, np.int64), np.zeros(n, np.int64), np.arange(n)
        else:
            linked, root, _ = tile_links(values, first, second, table.column("copies").to_numpy(), threshold)
            hit = np.flatnonzero(linked)
        names = table.column("key").combine_chunks()
        return pa.table({"key": names.take(pa.array(hit)), "links": pa.array(linked[hit]), "near": names.take(pa.array(root[hit]))})

    found = spread.groupBy("length", "one", "two").applyInArrow(compare, "key string, links long, near string")
    found = materialize(found, "vector-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(found.filter("key != near").select("key", "near").distinct(), "key", "near").withColumnRenamed("node", "key")
    table = distinct.select("key", "first_id", "copies").join(links, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    lowest = table.groupBy("root").agg(F.min("first_id").alias("component_id"))
    table = table.join(lowest, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = keyed.select("vec_id", "key").join(table, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
