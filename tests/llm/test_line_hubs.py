"""Pairs of a crowded bucket: hubs connect most lines, and what is left is still compared whole."""

import random

import pytest
from lexiscope.llm import line_dedup as ld
from pyspark.sql import functions as F

SYLLABLES = "ba re mi tol ken dor su vi lan pe gra hu ost il fen qua zor ty nem".split()


def made(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 5))) for _ in range(n)]


def changed(rng, line, share):
    return ["".join(rng.choice(SYLLABLES) for _ in range(3)) if rng.random() < share else w for w in line]


@pytest.fixture
def joined(monkeypatch):
    """The numbers of pairs that joins on buckets give, before any is verified."""
    seen, plain = [], ld._unasked

    def counted(met, asked):
        seen.append(met.count())
        return plain(met, asked)

    monkeypatch.setattr(ld, "_unasked", counted)
    return seen


def test_variants_of_one_line_make_few_pairs(spark, joined):
    rng = random.Random(8)
    line = made(rng, 60)
    texts = [" ".join(line)] + [" ".join(changed(rng, line, 0.1)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert ld.line_decisions(docs).count() == len(texts)
    assert sum(joined) <= 10 * len(texts)


def test_short_lines_with_one_word_in_common_make_no_pairs(spark, joined):
    rng = random.Random(9)
    texts = [f"extraordinarilylongishword {w}" for w in {"".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 14)) for _ in range(120)}]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    decided = ld.line_decisions(docs).collect()
    assert all(r.kept for r in decided)
    assert sum(joined) <= len(texts)


@pytest.mark.parametrize("hubs", [1, 8])
def test_groups_are_those_of_all_pairs_in_buckets(spark, monkeypatch, hubs):
    monkeypatch.setattr(ld, "HUBS", hubs)
    rng = random.Random(10)
    texts = []
    for n in (5, 9, 30, 80):
        base = made(rng, n)
        texts += [" ".join(changed(rng, base, share)) for share in (0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = ld.materialize(ld.line_table(docs), "lines")
    marks = ld.materialize(ld.signatures(lines), "marks")
    keyed = ld._banded(marks, 0).unionByName(ld._banded(ld.trigram_signatures(lines), 1))
    marked = ld.candidate_texts(lines, lines.select("line"))
    end = lambda e: marked.select(*(F.col(c).alias(c + e) for c in ("line", "norm", "chars", "fp")))
    pairs = keyed.select("key", F.col("line").alias("line_a")).join(keyed.select("key", F.col("line").alias("line_b")), "key").filter("line_a < line_b")
    pairs = pairs.groupBy("line_a", "line_b").agg(F.count("*").alias("n")).join(end("_a"), "line_a").join(end("_b"), "line_b")
    pairs = pairs.filter(ld._near("_a", "_b") & ((ld._bits("_a", "_b") <= ld.CLOSE) | (F.col("n") > 1))).withColumns({"one": F.col("norm_a"), "two": F.col("norm_b")})
    want = ld.connected_components(ld.materialize(pairs.filter(ld.edit_similar()), "linked"), "line_a", "line_b")
    assert sorted(map(tuple, ld.line_groups(lines, marks).collect())) == sorted(map(tuple, want.collect()))
