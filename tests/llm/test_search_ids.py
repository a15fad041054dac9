"""Hamming search where rows repeat the query's id."""

import random

from lexiscope.llm import hamming_search as hs


def test_search_with_repeated_ids(spark):
    rng = random.Random(8)
    rows = [(i, rng.getrandbits(63)) for i in range(60)] + [(0, rng.getrandbits(63))]
    rows += rows[:1] * 4 + [(0, rows[0][1] ^ 1), (0, rows[0][1] ^ 2), (100, rows[0][1] ^ 4), (100, rows[0][1] ^ 4)]
    df = spark.createDataFrame(rows, "vec_id long, code long")
    asked = df.limit(0).union(spark.createDataFrame(rows[:1] * 3, df.schema))
    got = sorted((r.rank, r.distance, r.vec_id) for r in hs.top_k(df, asked, 6).collect())
    near = sorted(((rows[0][1] ^ c).bit_count(), i) for i, c in rows if i != 0)[:6]
    assert got == [(n + 1, d, i) for n, (d, i) in enumerate(near)]
