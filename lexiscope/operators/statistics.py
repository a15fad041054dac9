"""Aggregation shapes shared by all metrics: scalars, statistics, distributions, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIGITS = 8
STATS = ("mean", "stdev", "min", "median", "max", "count")


#: Rows of a summary stand for so many rows; rows without this column for one each.
WEIGHT = "_n"


def carried(rows: DataFrame) -> list[str]:
    return [WEIGHT] if WEIGHT in rows.columns else []


def occurrences(rows: DataFrame) -> Column:
    return F.sum(WEIGHT) if carried(rows) else F.count("*")


def weighted_sum(rows: DataFrame, value) -> Column:
    return F.sum(value * F.col(WEIGHT)) if carried(rows) else F.sum(value)


def describe(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation, minimum, median, maximum and count per key, rounded to eight digits.

    Values are counted first, so that what is shuffled and sorted is one row per key and distinct value.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    return describe_counted(counted, keys)


def describe_counted(counted: DataFrame, keys: list[str]) -> DataFrame:
    """``describe`` over ``(keys, value, n)``.

    The deviation is that of the distances from the mean, which a window finds first: the difference of two large
    sums would lose it.  Window and aggregation share one shuffle of the counted values.
    """
    total, every = F.sum("n"), W.partitionBy(*keys)
    mean = F.sum(F.col("value") * F.col("n")).over(every) / F.sum("n").over(every)
    counted = counted.withColumn("_mean", mean).withColumn("_far", F.col("value") - F.col("_mean"))
    deviation = F.when(total > 1, F.sqrt(F.sum(F.col("_far") * F.col("_far") * F.col("n")) / (total - 1)))
    rounded = lambda c: F.round(c, DIGITS)
    return counted.groupBy(*keys).agg(
        rounded(F.min("_mean")).alias("mean"), rounded(deviation).alias("stdev"), rounded(F.min("value")).alias("min"),
        rounded(F.expr("percentile(value, 0.5, n)")).alias("median"), rounded(F.max("value")).alias("max"), total.cast("long").alias("count"),
    )


def complete(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """``stats`` with a row for every (target, scope): count 0 and null statistics where there is no data."""
    return pairs.join(stats, ["target", "scope"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def shares(counts: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """``counts`` with each row's proportion of its keys' total, eight digits, 0 where the total is 0."""
    total = F.sum(count).over(W.partitionBy(*keys))
    return counts.withColumn("proportion", F.round(F.when(total == 0, F.lit(0.0)).otherwise(F.col(count) / total), DIGITS))


def distribution(rows: DataFrame, keys: list[str], key: Column) -> DataFrame:
    """Count and proportion per value of ``key``, null as ``null``."""
    counted = rows.groupBy(*keys, F.coalesce(key.cast("string"), F.lit("null")).alias("key")).agg(F.count("*").alias("count"))
    return shares(counted, keys)


def vocabulary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, key, n)``: how often each key occurs; null is a value like any other."""
    return rows.groupBy(*keys, "key").agg(occurrences(rows).alias("n"))


def overlap(vocab: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sizes, intersection, union and Jaccard index of two targets' vocabularies, for each pair and scope.

    ``pairs(target1, target2)`` is a configured table; each key of a pair is one row that says on
    which sides it is, so there is one shuffle and no self join.  Without any key the index is 0.
    """
    sides = pairs.select("target1", "target2", F.explode(F.array(F.struct(F.col("target1").alias("target"), F.lit(1).alias("side")), F.struct(F.col("target2").alias("target"), F.lit(2).alias("side")))).alias("x")).select("target1", "target2", "x.*")
    keyed = vocab.select("target", "scope", "key").join(sides, "target")
    on = lambda side: F.max((F.col("side") == side).cast("int"))
    each = keyed.groupBy("target1", "target2", "scope", "key").agg(on(1).alias("one"), on(2).alias("two"))
    out = each.groupBy("target1", "target2", "scope").agg(F.sum("one").alias("n1"), F.sum("two").alias("n2"), F.sum(F.col("one") * F.col("two")).alias("n_intersection"), F.count("*").alias("n_union"))
    return out.withColumn("jaccard", F.round(F.col("n_intersection") / F.col("n_union"), DIGITS))
