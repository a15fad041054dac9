"""Columns of a caller that are called like an operator's own helpers."""

from lexiscope.llm import line_dedup, quality, simhash_dedup

NAMES = "score", "held_out", "predicted", "_id", "_row", "_dropped", "_bytes", "_kept"


def test_filters_return_a_callers_columns(spark):
    rows = [(i, t, *range(len(NAMES))) for i, t in enumerate(["red green blue yellow\nsame line here", "one two three four\nsame line here", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in NAMES))
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(map(tuple, quality.accepted(docs, labels).collect()), key=str) == sorted(rows, key=str)  # unfitted: all score 0.5
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1].text == "one two three four" and out[0] == rows[0] and out[2] == rows[2]
    kept = simhash_dedup.one_of_each_group(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2}
