"""Leaves are counted once: for any number of targets, scopes and terminologies annotations are read one time."""

from lexiscope.operators import terminology as tm
from lexiscope.plans.battery import Battery
from lexiscope.plans.frames import Corpus
from lexiscope.plans.resources import Resources
from lexiscope.plans.targets import target_frame

SCHEMA = "corpus string, subset string, label string, links array<struct<identifier:string,resource:string,match_type:string>>"
ROWS = [
    ("c", "a", "R", [("1", "X", "exact"), ("2", "Y", "exact")]), ("c", "a", None, [("1", "x-", "exact"), (None, "X", "NIL")]), ("c", "b", "N", [("1", "X", "exact"), ("1", "X", "exact")]), ("c", "b", "R", []), ("c", "b", "R", None),
]
BUNDLES = {"all": [("c", None)], "a": [("c", "a")], "twice": [("c", "a"), ("c", "a")]}


def test_ids_from_counted_leaves(spark):
    found = tm.counted_leaves(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(map(tuple, found.collect()), key=str) == [("c", "a", "R", "1", "X", 1), ("c", "a", "R", "2", "Y", 1), ("c", "a", None, "1", "x-", 1), ("c", "b", "N", "1", "X", 2)]
    got = {tuple(r) for r in tm.linked_ids(found, target_frame(spark, BUNDLES), {"r": ["R"], "n": ["N"]}, tm.Terminology(None, None, ("X",))).collect()}
    assert got == {("all", "all", "1", 4), ("all", "r", "1", 1), ("all", "n", "1", 2), ("a", "all", "1", 2), ("a", "r", "1", 1), ("twice", "all", "1", 4), ("twice", "r", "1", 2)}


def test_battery_reads_annotations_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    annotations = spark.createDataFrame(ROWS, SCHEMA).coalesce(1).mapInArrow(seen, SCHEMA)
    concepts = spark.createDataFrame([(0, "1", "one", ["A"], [], [], []), (1, "2", "two", ["A.B"], [], [], [])], "seq long, ui string, name string, tree_numbers array<string>, parent_ids array<string>, mapped_ui_ids array<string>, alt_ids array<string>")
    terminologies = {"x": tm.Terminology(concepts, None, ("X",)), "y": tm.Terminology(concepts, None, ("Y",))}
    metrics = [{"result": f"{m}-{t}", "metric": m, "bundles": ["all", "a"], "terminology": t} for m in ("high_level_concept_counts", "concept_depth_counts") for t in "xy"]
    found = Battery({"c": []}, BUNDLES, metrics).run(spark, Corpus(annotations, annotations, annotations), Resources(terminologies=terminologies))
    rows = {k: {(r.target, r["key" if "key" in r else "depth"]): r["annotation_count" if "key" in r else "count"] for r in df.collect()} for k, df in found.items()}
    assert rows == {
        "high_level_concept_counts-x": {("all", "1"): 4.0, ("a", "1"): 2.0}, "high_level_concept_counts-y": {("all", "1"): 1.0, ("a", "1"): 1.0},
        "concept_depth_counts-x": {("all", 1): 4.0, ("all", 2): 0.0, ("a", 1): 2.0, ("a", 2): 0.0}, "concept_depth_counts-y": {("all", 1): 0.0, ("all", 2): 1.0, ("a", 1): 0.0, ("a", 2): 1.0},
    }
    assert read.value == len(ROWS)
