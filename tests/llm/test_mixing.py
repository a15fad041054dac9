"""Mixing: targets, totals, bounds and the mixed texts."""

import random
import re

import pytest
from lexiscope.llm import mixing as mx
from pyspark.sql import functions as F


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing, source -> target."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if rate * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: rate * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def corpus(spark, seed, n, sources):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choice([0, 1, 5, 60, 400])
        text = "".join(f"w{rng.randrange(99)}" + rng.choice([" ", "\n", "\t ", "\x0b"]) for _ in range(words))
        rows.append((i, rng.choice([" \n", ""]) + text, rng.choice(sources)))
    rows += [(n, None, sources[0]), (n + 1, "\xa0", sources[0]), (0, rows[0][1], rows[0][2])]
    return spark.createDataFrame([(i, t, s, "en", 1) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long")


@pytest.mark.parametrize(("seed", "sources"), [(1, ["a", "a", "a", "b", "é", "B", None]), (2, ["x"]), (3, [f"s{i}" for i in range(9)])])
def test_report(spark, seed, sources):
    docs = corpus(spark, seed, 200, sources)
    rows = mx.mix_report(docs, block_words=16, shard_slots=50).collect()
    given = sorted((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect())
    assert sorted((r.doc_id, r["size"]) for r in rows) == given
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, taken, target = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken <= 3 * r["size"]
    assert all(r.source_size == sizes[source[r.doc_id]] for r in rows)
    assert target == pytest.approx(targets(sizes))
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 3 * 16
    again = mx.mix_report(docs.repartition(7), block_words=16, shard_slots=50).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_capped_source(spark):
    docs = spark.createDataFrame([(1, "a b", "a")] + [(i, "w " * 50, s) for i in range(2, 40) for s in [random.Random(i).choice("bc")]], "doc_id long, text string, source string")
    rows = {r.doc_id: r for r in mx.mix_report(docs, block_words=8, shard_slots=10).collect()}
    assert (rows[1].target, rows[1].taken) == (6.0, 6)


def test_empty_tables(spark):
    schema = "doc_id long, text string, source string"
    assert mx.mix_report(spark.createDataFrame([], schema)).count() == 0
    (row,) = mx.mix_report(spark.createDataFrame([(1, None, None)], schema)).collect()
    assert tuple(row) == (1, 0, 0, 0.0, 0)
    assert mx.mixed_documents(spark.createDataFrame([], schema)).count() == 0


def test_permutation(spark):
    for n in (1, 2, 3, 7, 64, 1000):
        found = spark.range(n).select(mx.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit(1)).alias("p")).collect()
        assert sorted(r.p for r in found) == list(range(n))


def test_shards_are_drawn(spark):
    docs = corpus(spark, 4, 200, ["a", "b", None])
    placed, sources = mx._placed(docs, mx.WEIGHTS, 16)
    slots = mx.plan(sources, 50).collect()
    quota = {r["rank"]: (r.quota, r.blocks) for r in sources.collect()}
    for rank, (n, blocks) in quota.items():
        own = [r for r in slots if r["rank"] == rank]
        assert sorted(r.slot for r in own) == list(range(n))
        for k in range(3):
            seen = [r.block for r in own if r["pass"] == k]
            assert len(set(seen)) == len(seen) <= blocks
    counts = {}
    for r in slots:
        counts[r.shard] = counts.get(r.shard, 0) + 1
    assert max(counts.values()) <= 50 and len(set(counts.values())) > 1


def test_mixed_texts(spark):
    docs = corpus(spark, 6, 60, ["a", "a", "b", None]).withColumn("size", F.lit("clash")).withColumn("k1", F.lit("clash"))
    report = mx.mix_report(docs, block_words=16, shard_slots=50).collect()
    out = mx.mixed_documents(docs, block_words=16, shard_slots=50)
    assert out.columns == docs.columns
    rows = out.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    took, want = {}, {}
    for r in rows:
        took[r.doc_id] = took.get(r.doc_id, 0) + count(r.text)
        assert r.n_chars == len(r.text)
    for r in report:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert took == {k: v for k, v in want.items() if v}
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert any(r.text == whole[r.doc_id] for r in rows)
    for r in rows:
        words = iter(whole[r.doc_id].split())
        assert all(w in words for w in r.text.split())
