"""SimHash, embedding and line near-duplicates, and Hamming search, against brute force."""

import random

import numpy as np
import pytest
from lexiscope.llm import embedding_dedup as ed
from lexiscope.llm import graph
from lexiscope.llm import hamming_search as hs
from lexiscope.llm import line_dedup as ld
from lexiscope.llm import simhash_dedup as sd
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def roots(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r.node: r.root for r in graph.connected_components(df, "a", "b").collect()}
    want = roots(140, edges)
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert graph.connected_components(df.limit(0), "a", "b").count() == 0


def test_fingerprint_definition():
    import xxhash

    assert sd.fingerprint(None) == sd.fingerprint(" \t\n") == 0
    assert sd.fingerprint("A b") == xxhash.xxh64_intdigest(b"a b", 42)
    text = "É A B c\x0bd d d"
    words = ["É", "a", "b", "c", "d", "d", "d"]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 5)
    assert sd.fingerprint(text) == want


def test_spark_hash_is_the_same(spark):
    import xxhash

    assert spark.sql("select xxhash64('a b c')").first()[0] % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_covering_code():
    cover = sd.Covering(2)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    y = x.copy()
    for k in range(2):
        y ^= np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
    row, anchor, home = cover.anchors(x)
    homes = dict(zip(row[home].tolist(), anchor[home].tolist()))
    assert len(homes) == home.sum() == 200
    row, anchor, _ = cover.anchors(y)
    pairs = set(zip(row.tolist(), anchor.tolist()))
    assert len(pairs) == len(row) and all((i, homes[i]) in pairs for i in range(200))


def test_simhash_groups(spark):
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.choice([0, 1, 2, 3, 40, 300]))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            if copy and rng.random() < 0.6:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(900, None), (900, None), (None, "alpha beta")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    fps = [sd.fingerprint(t) for _, t in rows]
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = roots(len(rows), linked)
    low = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    want = sorted(((i, f"{f:016x}", low.get(r)) for (i, _), f, r in zip(rows, fps, root)), key=str)
    assert sorted(map(tuple, sd.near_duplicates(df).collect()), key=str) == want
    assert sd.near_duplicates(df.limit(0)).count() == 0


def test_forest_is_linear():
    n = 300
    base = np.uint64(0x0123456789ABCDEF)
    fps = np.array([base ^ (np.uint64(1) << np.uint64(i % 60)) for i in range(n)], np.uint64)
    a, b = sd._forest(np.zeros(n, np.int64), fps, np.ones(n, bool), 2)
    assert len(a) == n - 1


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 16)), base[:5] * 3, base[:3]]))]
    odd = [(200, None), (201, [0.0] * 16), (202, [float("nan")] + [1.0] * 15), (203, [None] + [1.0] * 15), (204, []), (205, [1.0] * 8), (206, [2.0] * 8), (207, [float("inf")] * 16), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, key int")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    good = [(i, unit(v)) for i, v in rows + [odd[5], odd[6], odd[8]]]
    linked = [(a, b) for a in range(len(good)) for b in range(a) if len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.95]
    root = roots(len(good), linked)
    low = {}
    for (i, _), r in zip(good, root):
        low[r] = min(low.get(r, i), i)
    degree = [sum(k in e for e in linked) for k in range(len(good))]
    want = [(i, d, low[r], i == low[r]) for (i, _), d, r in zip(good, degree, root)] + [(i, 0, i, True) for i, _ in odd if i in (200, 201, 202, 203, 204, 207)]
    for block in (7, None):
        assert sorted(map(tuple, ed.near_duplicates(df, block=block).collect())) == sorted(want)
    assert ed.near_duplicates(df.limit(0)).count() == 0


def test_quantisation_bound_is_rigorous():
    rng = np.random.default_rng(1)
    x = ed.unit(rng.normal(size=(200, 32)))
    q = ed.Quantised(x)
    approx = (q.q.astype(float) @ q.q.astype(float).T) * q.scale**2
    bound = (q.part + q.error)[:, None] * q.error[None, :] + q.error[:, None] * q.part[None, :]
    assert (np.abs(x @ x.T - approx) <= bound + 1e-12).all()


def test_hamming_top_k(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(64) for _ in range(150)]
    codes += [c ^ 1 << rng.randrange(64) for c in codes[:60]] + codes[:3] * 15
    rows = [(i, c - (1 << 64) if c >> 63 else c) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows + [(None, 5), (999, None)], "vec_id long, code long")
    asked = df.filter("vec_id % 25 = 0 or vec_id is null")
    got = {}
    for r in hs.top_k(df, asked, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.vec_id))
    for q in range(0, len(codes), 25):
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in enumerate(codes) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, d, i) for k, (d, i) in enumerate(near)]
    assert hs.top_k(df.limit(0), asked.limit(0), 5).count() == 0
    few = df.filter("vec_id < 3")
    assert hs.top_k(few, few.limit(1), 5).count() == 2


def test_sign_codes(spark):
    df = spark.createDataFrame([([1.0, -1.0, 0.0, None, float("nan"), 2.0],), (None,), ([],), ([0.0] * 63 + [1.0, -3.0],)], "v array<double>")
    assert [r[0] for r in df.select(hs.sign_code(F.col("v"))).collect()] == [0b100001, None, None, -(1 << 63)]


@pytest.fixture(scope="module")
def line_docs(spark):
    rng = random.Random(9)
    base = [[rng.choice(WORDS) for _ in range(rng.choice([1, 3, 12, 60, 200]))] for _ in range(40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(base))
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = rng.choice(["new", "Other", ""])
            lines.append(rng.choice([" ", ", ", "  "]).join(line) + rng.choice(["", ".", " !"]))
        docs.append((i, "\n".join(lines), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "\n \n...", "x"), (7, docs[7][1], "x"), (None, "only here once or twice", "x"), (103, "only here once or twice", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, line string")


def similar_pairs(lines):
    """All pairs of lines with an edit similarity of 0.8 or more, without any filter."""
    import duckdb

    con = duckdb.connect()
    con.execute("create table t (i int, x varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(lines)))
    near = "levenshtein(a.x, b.x) <= 0.2 * greatest(length(a.x), length(b.x)) + 1e-9"
    return con.execute(f"select a.i, b.i from t a join t b on a.i > b.i where {near}").fetchall()


def test_lines_against_brute_force(spark, line_docs):
    table = ld.line_table(line_docs).collect()
    text = {r.line: r.norm for r in table}
    marks = {r.line: (r.chars, r.copies) for r in ld.signatures(ld.line_table(line_docs)).collect()}
    assert marks == {k: (len(t), sum(r.line == k for r in table)) for k, t in text.items()}
    lines = sorted(text)
    linked = similar_pairs([text[k] for k in lines])
    assert linked
    group = dict(zip(lines, (lines[r] for r in roots(len(lines), linked))))
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.line_no)
    first, count = {}, {}
    for r in table:
        g = group[r.line]
        first[g] = min(first.get(g, key(r)), key(r))
        count[g] = count.get(g, 0) + 1
    want = sorted(((r.doc_id, r.line_no, group[r.line], count[group[r.line]], key(r) == first[group[r.line]]) for r in table), key=str)
    assert sorted(map(tuple, ld.line_decisions(line_docs).collect()), key=str) == want


def test_signature_is_the_weighted_majority(spark, line_docs):
    import xxhash

    table = ld.materialize(ld.line_table(line_docs), "lines")
    norm = {r.line: r.norm for r in table.collect()}
    for r in ld.candidate_texts(table, table.select("line")).collect():
        words = norm[r.line].split(" ")
        hashes = [(len(w), xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
        assert r.norm == norm[r.line]
        assert r.fp % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(n * (h >> b & 1) for n, h in hashes) > sum(map(len, words)))


def test_bounds_never_accept_what_the_distance_rejects(spark):
    rng = random.Random(12)
    rows = []
    for n in (1, 3, 30, 60, 400):
        for share in (0.0, 0.1, 0.15, 0.2, 0.25, 0.4):
            one = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 12))) for _ in range(n)]
            two = [w for w in one if rng.random() > share / 2]
            two = ["x" * len(w) if rng.random() < share / 2 else w for w in two]
            rows.append((" ".join(one), " ".join(two)))
    df = spark.createDataFrame(rows, "one string, two string")
    exact = F.levenshtein("one", "two") <= F.floor(F.greatest(F.length("one"), F.length("two")) * 0.2 + 1e-9)
    got = df.select(ld.edit_similar().alias("got"), exact.alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and len({r.got for r in got}) == 2


def test_deduped_documents(spark, line_docs):
    kept = {(r.doc_id, r.line_no) for r in ld.line_decisions(line_docs).collect() if not r.kept}
    out = sorted(((r.doc_id, r.text) for r in ld.dedup_lines(line_docs).collect()), key=str)
    want = sorted(((r.doc_id, None if r.text is None else "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in kept)) for r in line_docs.collect()), key=str)
    assert out == want
    assert ld.dedup_lines(line_docs.limit(0)).count() == 0


def test_very_long_lines(spark):
    long = " ".join(WORDS[i * 7 % 20] + str(i % 97) for i in range(9000))
    docs = spark.createDataFrame([(1, long), (2, long.replace("alpha0", "other")), (3, "short")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in ld.line_decisions(docs).collect()} == {1: True, 2: False, 3: True}
