"""Collocations against plain Python, and their suffix arrays."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from lexiscope.llm import collocations as co
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def brute(rows, longest, least, most, covered=50):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text or ""):
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in candidates.items()):
                continue
            score, _, l, r = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, phrase.decode(), -a, l, r, total[lang], -score) for i, (score, a, phrase, l, r) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["a", "B", "b", "ça", "new", "York", "york", "x-y", " ", "\x1c", "中文", "of", "the"] + [f"w{i}" for i in range(20)]
    between = [" "] * 8 + ["  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "!?", " \x0c "]
    text = lambda: "".join(rng.choice(words) + rng.choice(between) for _ in range(rng.randrange(30)))
    return [(rng.choice(["en", "fr", None, "und", ""]), rng.choice([text(), text(), "the new york times of a", None, "", " . "])) for _ in range(n)]


@pytest.mark.parametrize(("longest", "least", "most", "shard"), [(3, 3, 2000, 6_000_000), (3, 2, 5, 100), (2, 4, 2000, 300), (5, 2, 2000, 1000)])
def test_brute_force(spark, monkeypatch, longest, least, most, shard):
    monkeypatch.setattr(co, "SHARD", shard)
    rows = made(200) + [("rep", "one two three four five six")] * 4
    df = spark.createDataFrame([(*r, 1, {"k": 1}) for r in rows], "lang string, text string, n int, `a.b` map<string,int>").repartition(3)
    got = co.collocations(df, longest, least, most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {kind for name, kind in got.dtypes if name not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(rows, longest, least, most)


def test_full_bit_table_changes_nothing(spark, monkeypatch):
    """With every bit set, all n-grams are counted, and the result is the same."""
    monkeypatch.setattr(co, "_bits", lambda frequent, n: np.full(4, 2**64 - 1, np.uint64))
    rows = made(120, 2)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, co.collocations(df, 3, 3).collect())) == brute(rows, 3, 3, 2000)


def test_shared_keys_take_another_salt(spark, monkeypatch):
    """Words whose keys collide under the first salts get keys of their own before they are used; else it raises."""
    real = co.word_key
    monkeypatch.setattr(co, "word_key", lambda lang, word, salt: F.length(word).cast("long") if salt < 2 else real(lang, word, salt))
    rows = made(60, 3)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, co.collocations(df, 3, 3).collect())) == brute(rows, 3, 3, 2000)
    monkeypatch.setattr(co, "word_key", lambda lang, word, salt: F.length(word).cast("long"))
    with pytest.raises(ValueError, match="salts"):
        co.collocations(df, 3, 3)


def test_empty_and_odd_texts(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    df = spark.createDataFrame([("en", None), (None, ""), ("en", ".,;"), ("en", "x " * 200_000), ("fr", "y" * 500_000)], "lang string, text string")
    assert sorted(map(tuple, co.collocations(df).collect())) == [("en", 1, "x x x", 199_998, 200_000, 199_999, 200_000, 999_985)] == brute([("en", "x " * 200_000)], 3, 10, 2000)


def test_keys_agree(spark):
    words = ["a", "ça", "中文" * 20, "x" * 100, ""]
    df = spark.createDataFrame([(w,) for w in words], "word string").withColumn("w1", co.word_key(F.lit("en"), F.col("word"), 3)).withColumn("w2", F.lit(7).cast("long") - F.col("w1") % 1000)
    rows = df.withColumn("h", co.folded([F.col("w1"), F.col("w2"), F.col("w1")])).collect()
    keys = co._keys("en", [r.word.encode() for r in rows], 3)
    assert keys.view(np.int64).tolist() == [r.w1 for r in rows]
    two = np.array([r.w2 for r in rows], np.int64).view(np.uint64)
    assert co.folded([keys, two, keys]).view(np.int64).tolist() == [r.h for r in rows]
    table = co._bits(df.select("w1", "w2"), 2)
    assert co._hits(table, co.folded([keys, two])).all() and sum(int(x).bit_count() for x in table) == len(words)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 5])
def test_suffix_array(depth):
    rng = np.random.default_rng(depth)
    for size in (0, 1, 2, 50, 400):
        ids = rng.integers(-1, 4, size).astype(np.int32)
        listed, suffix = ids.tolist(), {}
        for i in range(size):
            if listed[i] >= 0:
                rest = listed[i:]
                suffix[i] = (rest[: rest.index(-1)] if -1 in rest else rest)[:depth]
        order, agree = co.suffix_array(ids, depth)
        assert sorted(order.tolist()) == sorted(suffix)
        found = [suffix[i] for i in order.tolist()]
        assert found == sorted(found)
        same = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert agree.tolist() == [0 if i == 0 else same(found[i - 1], found[i]) for i in range(len(found))]
        want = Counter(tuple(s) for s in suffix.values() if len(s) == depth)
        places, begins = co.intervals(ids, depth)
        counts = np.diff(np.append(begins, len(places))).tolist()
        assert {tuple(listed[p : p + depth]): c for p, c in zip(places[begins].tolist(), counts, strict=True)} == want and len(counts) == len(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_sql(spark):
    import duckdb
    from lexiscope.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLES['op12_collocations']})").fetchall())
    assert len(want) > 100 and sorted(map(tuple, QUERIES["op12_collocations"](spark, SF).collect())) == want
