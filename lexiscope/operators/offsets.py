"""Spans and the passages that they lie in, by offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a bin.  A passage is listed once for each bin that it touches, and a span's place is looked up in one.
BIN = 1000


def line_offsets(documents: DataFrame, keys: Sequence[str], column: str = "text") -> DataFrame:
    """``(*keys, passage_no, text, offset)``: the lines of each text and where they begin."""
    lines = documents.select(*keys, F.posexplode(F.split(column, "\n")).alias("passage_no", "text"))
    before = W.partitionBy(*keys).orderBy("passage_no").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def located(spans: DataFrame, passages: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", width: int = BIN) -> DataFrame:
    """``spans`` with ``passage_no`` and ``last_passage_no``, the passages of its first and its last character, and
    ``inner_start``, its start in the first one.

    ``passages(*keys, passage_no, text, offset)`` hold the characters from ``offset`` on, in any number and with gaps.
    A span that crosses a border has two different numbers; the number is null for a character that no passage holds,
    and for null offsets.  An empty span has the place of its start.  Where passages overlap, the one with the lowest
    number counts.  Equi-joins on the keys and the bin keep a document with very many spans or passages apart.
    """
    low, high = F.col("offset").cast("long"), (F.col("offset") + F.length("text")).cast("long")
    bins = passages.filter(high > low).select(*keys, "passage_no", low.alias("low"), (high - 1).alias("high"))
    bins = bins.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))))
    # One row for each bin with its passages in order; there are at most as many as the bin has characters.
    held = bins.groupBy(*keys, "_bin").agg(F.array_sort(F.collect_list(F.struct("passage_no", "low", "high"))).alias("_held"))

    def at(rows: DataFrame, place: Column, out: str) -> DataFrame:
        placed = rows.withColumn("_place", place.cast("long")).withColumn("_bin", F.floor(F.col("_place") / width)).join(held, [*keys, "_bin"], "left")
        here = F.filter("_held", lambda p: F.col("_place").between(p.low, p.high))
        return placed.withColumn(out, F.get(here, F.lit(0))).drop("_bin", "_place", "_held")

    out = at(at(spans, F.col(start), "_first"), F.greatest(F.col(start), F.col(end) - 1), "_last")
    return out.select(*spans.columns, F.col("_first.passage_no").alias("passage_no"), F.col("_last.passage_no").alias("last_passage_no"), (F.col(start) - F.col("_first.low")).alias("inner_start"))
