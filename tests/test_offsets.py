"""Spans by offset and changes by key against plain Python."""

import random

import pytest
from lexiscope.operators import offsets, rollups


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_spans(spark, width):
    rng = random.Random(width)
    passages, spans = [], []
    for doc in ("a", "b", "c"):
        at = rng.randrange(5)
        for no in range(12):
            text = "x" * rng.choice([0, 1, 3, 20])
            passages.append((doc, no, text, at))
            at += len(text) + rng.choice([0, 1, 4])
        spans += [(doc, s, s + rng.randrange(25), "clash") for s in range(-2, at + 3)]
    spans += [("a", None, 5, "n"), ("none", 3, 4, "n"), ("a", 2, 3, "twice"), ("a", 2, 3, "twice"), (None, 1, 2, "n")]
    hit = lambda doc, place: next(((no, at) for d, no, text, at in passages if d == doc and place is not None and at <= place < at + len(text)), (None, None))
    want = []
    for doc, s, e, more in spans:
        first, at = hit(doc, s)
        want.append((doc, s, e, more, first, hit(doc, max(s, e - 1) if s is not None else e - 1)[0], None if at is None else s - at))
    p = spark.createDataFrame(passages, "doc string, passage_no int, text string, offset int")
    out = offsets.located(spark.createDataFrame(spans, "doc string, start int, end int, low string"), p, ["doc"], width=width)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_changes_by_key(spark):
    nan = float("nan")
    old = spark.createDataFrame([("a", 1, nan, "x"), ("b", 2, None, "y"), ("c", 3, 1.0, "z"), ("d", 4, 1.0, "z")], "k string, n int, v double, t string")
    new = spark.createDataFrame([("a", 1, nan, "x"), ("b", 2, 0.0, "Y"), ("c", 3, None, "z"), ("e", 5, 1.0, "z")], "k string, n int, v double, t string")
    assert sorted((r.k, r.change, tuple(r.fields)) for r in rollups.keyed_changes(old, new, ["k"]).collect()) == [("b", "changed", ("t", "v")), ("c", "changed", ("v",)), ("d", "removed", ()), ("e", "added", ())]
    other = new.withColumn("n", new["n"].cast("long")).drop("t")
    assert [tuple(r.fields) for r in rollups.keyed_changes(old, other, ["k"]).filter("k = 'a'").collect()] == [("n", "t")]
    with pytest.raises(Exception, match="twice"):
        rollups.keyed_changes(old.unionByName(old), new, ["k"]).collect()
