"""Variation and ambiguity make rows distinct before they come once for each scope."""

from lexiscope.operators import metrics as mt
from lexiscope.plans.frames import Corpus
from lexiscope.plans.targets import target_frame


def test_scopes_come_after_distinct_rows(spark):
    rows = [("c", "s", "x", "A", "1"), ("c", "s", "x", "A", "1"), ("c", "s", "x", "B", "1"), ("c", "s", "y", "A", None), ("c", "t", "x", "A", "1"), ("c", "t", "x", None, "2")]
    df = spark.createDataFrame(rows, "corpus string, subset string, text string, label string, link_key string")
    targets = target_frame(spark, {"all": [("c", None)], "s": [("c", "s"), ("c", "s")]})
    out = mt.ambiguity_degree_stats(Corpus(None, None, df), targets, {"a": ["A"], "ab": ["A", "B"]})
    found = {(r.target, r.scope): (r.mean, r.max, r["count"]) for r in out.collect()}
    assert found == {("all", "all"): (2.0, 3.0, 2), ("all", "a"): (1.0, 1.0, 2), ("all", "ab"): (1.5, 2.0, 2), ("s", "all"): (1.5, 2.0, 2), ("s", "a"): (1.0, 1.0, 2), ("s", "ab"): (1.5, 2.0, 2)}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan[plan.rindex("array_compact") :].count("Deduplicate") == 2
