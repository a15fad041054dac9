"""Tables of the line operator are deleted once they have been read, so that few lie on disk at a time."""

from lexiscope.llm import line_dedup as ld
from pyspark.sql import functions as F


def test_texts_and_minima_are_gone_before_lines_are_compared(spark, monkeypatch):
    held, there, plain, drop = set(), {}, ld.materialize, ld.discard

    def written(df, name):
        there[name] = set(held)
        held.add(name)
        out = plain(df, name)
        out._called = name
        return out

    def dropped(*tables):
        held.difference_update(t._called for t in tables)
        drop(*tables)

    monkeypatch.setattr(ld, "materialize", written)
    monkeypatch.setattr(ld, "discard", dropped)
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("one line of some words that is much like the others "), "id").alias("text"))
    assert ld.line_decisions(docs).filter("kept").count() == 1
    assert not {"lines", "line-signatures", "line-trigrams", "line-buckets", "line-centres"} & there["hub-pairs"]
    assert not {"line-spots", "bucket-hubs", "line-meetings"} & there["line-pairs"]
