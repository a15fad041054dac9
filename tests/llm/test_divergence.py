"""Source divergence against plain Python, and its schedule."""

import os
import random
import re
from collections import Counter, defaultdict

import pytest
from lexiscope.llm import source_divergence as sd
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=3, top=200):
    rows = [((lang or ""), (source or ""), (text or "")) for text, lang, source in rows]
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for a, s in counts if a == lang]
        total = Counter()
        for s in sources:
            total.update(counts[lang, s])

        def shares(c, kept=kept):
            whole = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // whole for t in kept}

        q, p = shares(total), {s: shares(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def made(n, sources, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "γάμμα", "ÉTÉ", "x", "don't", "a1b", "中文", "Z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    return [(" ".join(rng.choice(words) for _ in range(rng.randrange(12))) or None, rng.choice(["en", "fr", None, ""]), rng.choice([None, *map(str, range(sources))])) for _ in range(n)]


@pytest.mark.parametrize(("sources", "block", "held", "top"), [(1, 4096, 400_000, 200), (2, 7, 5, 3), (5, 7, 400_000, 2), (6, 20, 9, 200)])
def test_brute_force(spark, monkeypatch, sources, block, held, top):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "HELD", held)
    monkeypatch.setattr(sd, "MEETINGS", 2)
    rows = made(150, sources) + [("only here", "xx", "one"), (None, "yy", "a"), ("", "yy", "b"), ("!!", "yy", None)] + [("same row again", "en", "0")] * 4
    df = spark.createDataFrame([(*r, 1, 2, {"k": 1}) for r in rows], "text string, lang string, source string, seat int, n int, `a.b` map<string,int>").repartition(3)
    got = sd.divergence(df, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == brute(rows, top=top)


def test_empty_and_large_counts(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert sd.divergence(empty).count() == 0
    n, total = 10**13, 3 * 10**13
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("t"), F.lit(7).cast("long").alias("v")).select(sd.share("n", "t", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + 7)


@pytest.mark.parametrize("seats", [2, 3, 4, 7, 20, 101])
def test_every_pair_meets_once(spark, seats):
    """All pairs meet exactly once, no seat twice in a round, one of two is the host, and hosting is even."""
    even = seats + seats % 2
    df = spark.range(seats).select(F.col("id").cast("int").alias("seat"), F.explode(F.sequence(F.lit(0), F.lit(even - 2))).alias("round"))
    rows = df.select("seat", "round", sd.opponent(F.col("seat"), F.col("round"), F.lit(even)).alias("to")).withColumn("host", sd.is_host(F.col("seat"), F.col("to"))).filter(f"to < {seats}").collect()
    assert sorted((r.seat, r.to) for r in rows) == [(a, b) for a in range(seats) for b in range(seats) if a != b]
    by = {(r.seat, r.to): r for r in rows}
    assert all(by[b, a].round == r.round and by[b, a].host != r.host for (a, b), r in by.items())
    assert len({(r.seat, r.round) for r in rows}) == len(rows)
    hosted = Counter(r.seat for r in rows if r.host)
    assert max(hosted.values()) <= (seats + 1) // 2 + 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_sql(spark):
    import duckdb
    from lexiscope.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = sorted(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({ORACLES['op11_source_divergence']})").fetchall())
    assert sorted(map(tuple, QUERIES["op11_source_divergence"](spark, SF).collect())) == want
