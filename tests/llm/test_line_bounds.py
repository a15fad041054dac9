"""Bounds of the edit distance that spare verification decide as the exact distance does."""

import random

import pytest
from lexiscope.llm import line_dedup as ld
from pyspark.sql import functions as F


@pytest.mark.parametrize("likely", [True, False])
def test_bounds_decide_as_the_distance_does(spark, likely):
    rng = random.Random(4)
    made = lambda n: "".join(rng.choice("abcd  \u00e9\U0001f600") for _ in range(n))
    pairs = [("", ""), ("", "a"), ("a", ""), ("ab", "ba"), ("a" * 10, "b" * 100), ("abcde", "abcdf")]
    for _ in range(400):
        base = made(rng.randrange(1, 400))
        passage, share = base[rng.randrange(len(base)) :], rng.choice([0.0, 0.1, 0.19, 0.2, 0.21, 0.3])
        edited = "".join(rng.choice(["", c + "x", "y"]) if rng.random() < share else c for c in base)
        pairs += [(base, edited), (edited, base), (base, made(len(base) - len(passage)) + passage), (passage + made(20), made(20) + passage)]
    df = spark.createDataFrame(pairs, "one string, two string")
    exact = F.levenshtein("one", "two") <= F.floor(F.greatest(F.length("one"), F.length("two")) * F.lit(0.2) + 1e-9)
    rows = df.select(ld.edit_similar(likely).alias("got"), exact.alias("want")).collect()
    assert all(r.got == r.want for r in rows) and 100 < sum(r.want for r in rows) < len(rows) - 100


def test_unlike_ends_spare_the_whole_distance(spark):
    """Of lines that share a passage only, the ends are compared, at a fraction of the cells."""
    condition = ld.edit_similar(likely=False)._jc.toString()
    assert condition.count("left(one") == 1 and condition.count("right(one") == 1
    assert condition.index("left(one") < condition.index("levenshtein(one, two")
