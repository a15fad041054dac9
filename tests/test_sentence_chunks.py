"""Boundaries that tasks find, and rows that share their keys."""

from collections import Counter

from lexiscope.functions import chunks
from lexiscope.operators import sentences as st
from test_sentences import Brute, made


def test_kernels():
    parts, marked = chunks.chunks_of("“Dr. ** Smith,\tno. 7;) x.) “ ;".encode())
    assert [p.decode() for p in parts] == ["“Dr.", "Smith,", "no.", "7;)", "x.)"] and [i for i, _ in marked] == [0, 2, 4]
    text = b"Dr. A came.)  He left.\tSo"
    assert chunks.ends_of(text) == [4, 14, 23, 25] and chunks.ends_of(b"") == [0]
    assert chunks.sentences_of(text, [0]) == [(0, b"Dr. A came.)"), (1, b"He left."), (2, b"So")]


def test_texts_are_split_in_place_and_rows_of_one_key_stay_apart(spark):
    texts = made(300, 2)
    model, brute = st.learn(spark.createDataFrame([(t,) for t in texts], "text string")), Brute(texts)
    rows = [(1, "Dr. Smith saw it. Yes."), (1, "It was so. We met Dr. Zweig. Ok."), (None, "Dr. Smith left. So."), (None, None)]
    found = st.split(spark.createDataFrame(rows, "id int, text string"), ["id"], model)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert any(len(brute.split(t)) < t.count(". ") + 1 for _, t in rows[:3])
    want = Counter((i, s) for i, t in rows for s in brute.split(t))
    assert Counter((r.id, r.sentence) for r in found.collect()) == want
