"""Rows and columns as callers have them: repeated rows, nulls in different places, maps, dotted names."""

import pytest
from lexiscope.llm import line_dedup, mixing, quality, simhash_dedup
from pyspark.sql import functions as F

ODD = "`a.b` int, tags map<string,int>, `_mix_size` int, `_k1` int, `_number` int, `x``y` string"
LINE, OTHER = "the quick brown fox jumps over the lazy dog", "nine grey geese go south when autumn has come"


@pytest.fixture
def docs(spark):
    rows = [(i, s, t, i, {"k": i}, i, i, i, str(i)) for i, (s, t) in enumerate([("s", f"{LINE}\nalpha one two"), ("s", f"{LINE}\nbeta three four"), ("r", f"{OTHER}\ngamma"), ("r", None), (None, "")])]
    return spark.createDataFrame(rows, f"doc_id long, source string, text string, {ODD}")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_stages_return_odd_columns(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert plain(quality.accepted(docs, labels).collect()) == plain(docs.collect())
    assert plain(simhash_dedup.one_of_each_group(docs.filter("doc_id < 4")).collect()) == plain(docs.filter("doc_id < 4").collect())
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()}[1] == "beta three four"
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {(r.doc_id, r["a.b"], r.tags["k"], r["_mix_size"]) for r in mixed.collect()} <= {(i, i, i, i) for i in range(3)}


@pytest.mark.parametrize("ident", [7, None])
def test_one_of_repeated_rows_keeps_its_lines(spark, ident):
    rows = [(ident, f"{LINE}\nsolo line of this row")] * 3 + [(9, f"{LINE}\nother ends here"), (9, f"{LINE}\nother ends here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    decided = line_dedup.line_decisions(docs).collect()
    assert len(decided) == 10 and sum(r.kept for r in decided) == 3
    assert sorted(r.copies for r in decided if r.kept) == [2, 3, 5]
    texts = [r.text for r in line_dedup.dedup_lines(docs).collect()]
    assert len(texts) == 5
    assert sorted(t for t in texts if t) == sorted([f"{LINE}\nsolo line of this row", "other ends here"])


def test_one_of_rows_that_differ_elsewhere_keeps_its_lines(spark):
    docs = spark.createDataFrame([(1, LINE, "a"), (1, LINE, "b"), (2, OTHER, "c")], "doc_id long, text string, source string")
    out = line_dedup.dedup_lines(docs).collect()
    assert sorted(r.source for r in out) == ["a", "b", "c"] and sorted(r.text for r in out) == ["", OTHER, LINE]


def test_many_equal_rows_are_told_off_in_runs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "RUN", 4)
    for n in (3, 4, 5, 8, 9):
        docs = spark.createDataFrame([(1, LINE)] * n, "doc_id long, text string")
        assert sorted(r.kept for r in line_dedup.line_decisions(docs).collect()) == [False] * (n - 1) + [True]


def test_nulls_at_different_places_are_different_rows(spark):
    docs = spark.createDataFrame([(1, None, "x y z"), (1, "x y z", None)], "doc_id long, source string, text string")
    out = mixing.mixed_documents(docs).collect()
    assert out and {(r.source, r.text) for r in out} == {(None, "x y z")}
    assert simhash_dedup.one_of_each_group(docs).count() == 2


def test_equal_rows_leave_one(spark):
    row = (1, {"k": 1}, "one two three four")
    docs = spark.createDataFrame([row] * 4 + [(2, None, "one two three four"), (None, None, "a b c d e f g")], "doc_id long, tags map<string,int>, text string")
    kept = simhash_dedup.one_of_each_group(docs)
    assert plain(kept.collect()) == plain([row, (None, None, "a b c d e f g")])
    assert simhash_dedup.one_of_each_group(docs.filter(F.lit(False))).count() == 0
