"""HTML extraction, the classifier, the secret scan and the pipeline."""

import os
import random
import zlib

import numpy as np
import pytest
from lexiscope.llm import html_text as ht
from lexiscope.llm import quality as ql
from lexiscope.llm import secret_scan as ss
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_lines():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        shared = ht.common_lines(a, b)
        assert sum(shared) == lcs_length(a, b)
        rest = iter(b)
        assert all(x in rest for x, s in zip(a, shared) if s)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<nav>menu</nav><article><h1>T&amp;C &lt;x&gt;</h1><p>a\n  b&nbsp;c<br>d</p><p> </p></article><footer>f</footer>", ["T&C <x>", "a b c d"]),
        ('<body><div class="page with-sidebar"><div id="menu">m</div><main><p>one<div class="ad">buy</div><p>two</main></div>', ["one", "two"]),
        ('<article><p>x</p><section class="comments"><article><p>no</p></article></section><aside>s</aside><form>f</form></article>', ["x"]),
        ("<article><script>var t='</p>';</script><style>p{}</style><p>ok<b>ay</b></p><!-- <p>no</p> --></article>", ["okay"]),
        ("<article><p>open<p>never closed &am", ["open", "never closed &am"]),
        ('<article><header><h1>Title</h1></header><p style="display:none">no</p><ul><li>i<li>j</ul></article>', ["Title", "i", "j"]),
        ('<article><p>Banner ads are discussed</p><div role="alert">no</div></article>', ["Banner ads are discussed"]),
        ("<header>site</header><p>a</p>", ["a"]),
        ("", []),
        (None, []),
        ("plain &amp; text", ["plain & text"]),
    ],
)
def test_blocks(html, want):
    assert ht.blocks(html) == want


def test_differencing(spark):
    rows = [(i, f"http://h{i % 2}.org/a/{i:03d}?q={i}", f"<div>Menu of {i % 2}</div><p>story {i} has enough words of its own</p><div>About {i % 2}</div>") for i in range(30)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://solo.org/", "<p>only</p>"), (103, "http://twins.org/a", "<p>same page</p>"), (104, "http://twins.org/b", "<p>same page</p>"), (102, "http://solo2.org/", "<p>only</p>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    for parts in (1, 5):
        got = sorted(((r.page_id, r.text, r.n_chars) for r in ht.extract_text(df.repartition(parts)).collect()), key=str)
        want = [(i, f"story {i} has enough words of its own") for i in range(30)] + [(100, ""), (101, ""), (102, "only"), (102, "only"), (103, "same page"), (104, "same page")]
        assert got == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert ht.extract_text(df.limit(0)).count() == 0


def test_nearest_path():
    near = ht._nearest("/a/bc", {"path": "/a/x", "hashes": [1]}, {"path": "/a/bd", "hashes": [2]})
    assert near == [[2], [1]] and ht._nearest("/", None, None) == []


def test_names_inside_an_article():
    html = '<article><h1>T</h1><section class="search results"><p>found things</p></section><p class="social">a social matter</p><div id="related-work">earlier work</div><div class="ad">buy</div><div class="related-posts"><a href="/x">more posts</a></div></article>'
    assert ht.blocks(html) == ["T", "found things", "a social matter", "earlier work"]
    assert ht.blocks("<p data-x=\"a\" b'>text</p><p title='<b>'>more</p>") == ["text", "more"]
    assert ht.blocks('<div><a href="/a">one</a> <a href="/b">two</a></div><p>A story with <a href="/c">a link</a> in it.</p>') == ["A story with a link in it."]


@pytest.mark.parametrize("part", ["<a ", '<a ="', "<a href='", "<!", "</", "<div class='ad'>", '<div class="page nav">x', "<script>", "<", "&", "<b><p>", "<!--", "<nav><div class=ad><span class=share>"])
def test_odd_pages_take_linear_time(part):
    import time

    began = time.process_time()
    ht.blocks(part * (1_000_000 // len(part)))
    assert time.process_time() - began < 20


def test_differencing_against_brute_force(spark):
    """All pages of a host are paired with the nearest of all others, and aligned."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        path = "/" + "/".join(rng.choice("abc") for _ in range(3)) + f"/{i:02d}"
        frame = [f"<div>frame {rng.randrange(3)} {k}</div>" for k in range(2)]
        body = "".join(f"<p>line {rng.randrange(40)} of it</p>" for _ in range(rng.randrange(1, 6)))
        page = frame[0] + (f"<article>{body}</article>" if rng.random() < 0.3 else body) + frame[1]
        rows.append((i, f"https://h{rng.randrange(2)}.org{path}", page))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    host = lambda url: url.split("/")[2]
    path = lambda url: "/" + url.split("/", 3)[3]
    want = {}
    for i, url, page in rows:
        found = ht.parse(page)
        others = sorted((path(u), k, p) for k, u, p in rows if k != i and host(u) == host(url))
        lower = [x for x in others if x[:2] < (path(url), i)][-1:]
        upper = [x for x in others if x[:2] > (path(url), i)][:1]
        near = sorted(lower + upper, key=lambda x: -len(os.path.commonprefix([x[0], path(url)])))
        longest = max(len(os.path.commonprefix([x[0], path(url)])) for x in others)
        assert len(os.path.commonprefix([near[0][0], path(url)])) == longest
        shared = set()
        for _, _, other in near:
            flags = ht.common_lines([t for t, _, _ in found], [t for t, _, _ in ht.parse(other)])
            if sum(len(t) for (t, _, _), s in zip(found, flags) if s) < 0.8 * sum(len(t) for t, _, _ in found):
                shared = {k for k, s in enumerate(flags) if s}
                break
        article = any(kind == ht.ARTICLE for _, kind, _ in found)
        want[i] = "\n\n".join(t for k, (t, kind, _) in enumerate(found) if (kind == ht.ARTICLE if article else k not in shared))
    assert {r.page_id: r.text for r in ht.extract_text(df).collect()} == want
    assert any(w.count("line") < page.count("line") for w, (_, _, page) in zip(want.values(), rows))


def test_network_gradient():
    """The learned step goes downhill: the loss falls on a task that only local byte patterns solve."""
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "cat", "sat"]) for _ in range(rng.randrange(1, 200))).encode() for _ in range(60)]
    bad = [b" ".join([w + b"!!" if rng.random() < 0.5 else w for w in t.split()] + [b"zz!!"]) for t in good]
    labels = np.array([1] * 60 + [0] * 60, np.float32)
    net = ql.ByteConvNet().fit(good + bad, labels, steps=60)
    scores = net.scores(good + bad)
    assert ((scores >= 0.3) == labels).mean() > 0.95


def test_scores_do_not_depend_on_batches():
    net = ql.ByteConvNet()
    net.out[:] = np.linspace(-1, 1, len(net.out))
    net.prepare()
    rng = random.Random(3)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 5, 123, 124, 128, 129, 1000, 5000)]
    one = np.concatenate([net.scores([t]) for t in texts])
    assert np.allclose(net.scores(texts), one)
    saved, ql.PIECE = ql.PIECE, ql.HALF_CHUNK
    try:
        assert np.allclose(net.scores(texts), one)
    finally:
        ql.PIECE = saved


def test_quality_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(i, "fine words here" if i % 2 else "BUY!! NOW!! BUY!!", 9) for i in range(40)] + [(50, None, 9), (51, "", 9), (None, "x", 9), (1, "fine words here", 9)], "doc_id long, text string, score int")
    rows = ql.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.score for r in ql.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert ql.quality_scores(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    rows = ql.quality_scores(read("documents"), read("labels")).filter("held_out").join(read("labels"), "doc_id").select("predicted", "quality").collect()
    hits = [r.predicted == r.quality for r in rows]
    clean = [r.predicted for r in rows if r.quality == 1]
    assert len(hits) > 500 and np.mean(hits) > 0.97 and np.mean(clean) > 0.99


def test_secret_features(spark):
    rows = spark.createDataFrame([(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x'), (2, "see /docs/user/manual12.html now"), (3, None), (4, ""), (5, "nothing here"), (6, "a1b2c3d4e5f6a7b8 9988776655443322")], "doc_id long, text string")
    got = {(r.doc_id, r.finding_no): r for r in ss.features(ss.candidates(rows)).collect()}
    assert set(got) == {(1, 0), (2, 0), (6, 0), (6, 1)}
    a, b = got[1, 0], got[2, 0]
    assert (a.length, a.hex_only, a.assigned, a.quoted, a.word_for, a.path_like) == (40, 1, 1, 1, 1, 0)
    assert a.candidate == "04dbebab91ab85687d33eeaaf9ac699e1188f962" and a.before.endswith('token = "') and a.behind == '" x'
    assert b.path_like == 1 and b.dictionary > 0.2 and got[6, 1].digits_only == 1 and got[6, 0].transitions == 15 / 16


def test_secret_forest(spark):
    rows = ss.labelled_findings(800, seed=99)
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows)], "doc_id long, text string, score string")
    found = ss.scan(df).collect()
    hits = [r.is_secret == bool(rows[r.doc_id][1]) for r in found]
    assert {r.doc_id for r in found} >= {i for i, (_, y) in enumerate(rows) if y} and np.mean(hits) > 0.93
    assert ss.scan(df.limit(0)).count() == 0


def test_forest_columns_match_python(spark):
    forest = ss.train(spark, ss.labelled_findings(300))
    table = ss.features(ss.candidates(spark.createDataFrame(list(enumerate(t for t, _ in ss.labelled_findings(100, seed=5))), "doc_id long, text string")))

    def walk(tree, row):
        while not isinstance(tree, float):
            tree = tree[2] if row[ss.FEATURES[tree[0]]] <= tree[1] else tree[3]
        return tree

    for r in table.select("*", *(ss.as_column(t).alias(f"t{i}") for i, t in enumerate(forest))).collect():
        assert [r[f"t{i}"] for i in range(len(forest))] == [walk(t, r) for t in forest]


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [k for k, _ in cp.STAGES] == ["quality", "line_dedup", "simhash_dedup", "mixing", "sentencepiece"]
    sizes = [docs.count()]
    from lexiscope.llm.runtime import materialize

    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        sizes.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
    run = cp.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


def test_one_document_of_each_group(spark):
    import corpus_pipeline as cp

    text = "one two three four five six seven"
    rows = [(3, text), (1, text), (1, text), (9, "something else entirely here"), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in cp.near_copies(spark, df, SF).collect()) == [1, 4, 9]
