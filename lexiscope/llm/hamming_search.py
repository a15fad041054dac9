"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into ``SEGMENTS`` segments, each an index by its value.  Round r probes all values at
distance exactly r from the query's in every segment.  A code whose total distance is below
SEGMENTS * (r + 1) has a segment within r, so after round r every such code has been found; a query is done
once that many found rows suffice for its k, else its radius grows.  Codes farther than the k nearest found
so far are left out in the join itself, so late rounds yield little.  A candidate is taken in just one place,
the first of its segments with the least segment distance, so no round yields it again.

Equal codes are one entry of the index, however many rows have them, and equal query codes one query.  Of a
code's rows only the smallest ids that any query can return are expanded, after the search.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiscope.llm.runtime import materialize

BITS, SEGMENTS, K = 64, 4, 10
WIDTH = BITS // SEGMENTS


def sign_code(vector: Column) -> Column:
    """64-bit code of an array of numbers: bit i is set if its components i, i + 64, ... sum to more than zero.
    Null and NaN components count as zero; null and empty arrays have no code."""
    x = F.transform(vector.cast("array<double>"), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))
    folds = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.aggregate(F.filter(x, lambda v, at: at % BITS == i), F.lit(0.0), lambda a, v: a + v))
    x = F.when(F.size(x) <= BITS, x).otherwise(folds)
    bits = F.transform(x, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(vector) > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _segment(code: Column, i: int) -> Column:
    return F.shiftrightunsigned(code, i * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int")


def _segments(df: DataFrame, code: str) -> DataFrame:
    parts = [F.struct(F.lit(i).alias("segment"), _segment(F.col(code), i).alias("value")) for i in range(SEGMENTS)]
    return df.withColumn("part", F.explode(F.array(*parts))).select("*", "part.segment", "part.value").drop("part")


def _first_met(x: Column, radius: int) -> Column:
    """Whether the probed segment is where a code with the difference ``x`` to the query is taken."""
    far = [F.bit_count(_segment(x, i)) for i in range(SEGMENTS)]
    checks = [F.when(F.col("segment") > i, far[i] > radius).otherwise(far[i] >= radius) for i in range(SEGMENTS)]
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def _masks(radius: int) -> Column:
    """All differences of one segment with ``radius`` bits, as a constant array."""
    values = [sum(1 << b for b in bits) for bits in combinations(range(WIDTH), radius)]
    return F.from_json(F.lit(str(values)), "array<int>")


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, distance)``: for each row of ``queries(vec_id, code)`` the ``k`` rows of
    ``codes(vec_id, code)`` with other ids that are nearest in Hamming distance, ties by id.

    Rows with a null code or id are neither found nor asked for.  Rows with one id and several codes are
    several entries, of which a query may return each, and so are repeated rows; none of a query's own id count
    among its ``k``.  With fewer than ``k`` other rows all are returned; empty tables give no rows.
    """
    codes = codes.filter("vec_id is not null and code is not null").groupBy("vec_id", "code").agg(F.count("*").alias("times"))
    codes = materialize(codes, "codes")
    asked = materialize(queries.filter("vec_id is not null and code is not null").select("vec_id", "code").distinct(), "queries")
    # Entries are pairs of an id and a code, each of one row or more.  Those of the query's own id don't count.
    own = asked.join(codes.select("vec_id"), "vec_id").groupBy("vec_id", "code").agg(F.count("*").alias("own"))
    needs = asked.join(own, ["vec_id", "code"], "left").groupBy(F.col("code").alias("query")).agg((k + F.coalesce(F.max("own"), F.lit(0))).alias("need"))
    index = materialize(_segments(codes.groupBy("code").agg(F.count("*").alias("copies")), "code"), "code-index")
    needs = materialize(needs, "needs")
    active = materialize(needs.select("query", "need", F.lit(BITS).alias("limit")), "active")
    best = done = None
    for radius in range(WIDTH + 1):
        masks = _masks(radius)
        probes = _segments(active, "query").select("query", "need", "limit", "segment", F.col("value").alias("own")).withColumn("mask", F.explode(masks))
        probes = probes.select("query", "need", "limit", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        x = F.col("query").bitwiseXOR(F.col("code"))
        # Probes look small to the planner, as it doesn't know how many masks there are: never broadcast them.
        met = probes.hint("merge").join(index, ["segment", "value"]).filter(_first_met(x, radius) & (F.bit_count(x) <= F.col("limit"))).select("query", "need", "code", "copies", F.bit_count(x).alias("distance"))
        if best is not None:
            met = met.unionByName(best.join(active, "query", "left_semi"))
        order = W.partitionBy("query").orderBy("distance")
        kept = materialize(met.withColumn("place", F.rank().over(order)).filter("place <= need").drop("place"), "nearest")
        sure = SEGMENTS * (radius + 1) - 1
        counted = kept.filter(F.col("distance") <= sure).groupBy("query", "need").agg(F.sum("copies").alias("n")).filter("n >= need")
        ready = materialize(counted.select("query"), "ready") if radius < WIDTH else active
        now_done = kept.join(ready, "query", "left_semi")
        done = now_done if done is None else done.unionByName(now_done)
        reach = kept.groupBy("query", "need").agg(F.when(F.count("*") >= F.col("need"), F.max("distance")).otherwise(BITS).alias("reach"))
        following = active.join(ready, "query", "left_anti").join(reach.drop("need"), "query", "left")
        following = materialize(following.select("query", "need", F.least("limit", F.coalesce("reach", F.lit(BITS))).alias("limit")), "active")
        best, active = kept, following
        if active.isEmpty():
            break
    # Within a code one id at most is the query's own.
    ids = codes.withColumn("place", F.row_number().over(W.partitionBy("code").orderBy("vec_id"))).filter(F.col("place") <= k + 1).drop("place")
    found = done.select("query", "need", "code", "distance").join(ids, "code").select(F.col("query").alias("code"), "need", "vec_id", "times", "distance")
    top = W.partitionBy("code").orderBy("distance", "vec_id")
    found = found.withColumn("place", F.row_number().over(top)).filter("place <= need").drop("place")
    pairs = asked.select(F.col("vec_id").alias("query_id"), "code").join(found, "code").filter("query_id != vec_id")
    pairs = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("times", F.lit(k).cast("long")))))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "code").orderBy("distance", "vec_id"))).filter(F.col("rank") <= k)
    return pairs.select("query_id", "rank", "vec_id", "distance")
