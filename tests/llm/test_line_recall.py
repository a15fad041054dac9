"""Lines of an edit similarity of 0.8 or more link, whatever their words' signatures."""

import random

from lexiscope.llm import line_dedup as ld

SYLLABLES = "ba re mi tol ken dor su vi lan pe gra hu ost il fen qua zor ty nem".split()


def made(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def test_one_changed_letter_or_word(spark):
    pairs = [("copyright 2023 foo inc", "copyright 2024 foo inc"), ("tavern on the green hill road", "tavern on the green hill roads")]
    docs = spark.createDataFrame([(10 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    assert {r.doc_id for r in ld.line_decisions(docs).collect() if not r.kept} == {1, 11}


def test_recall_at_the_threshold(spark):
    rng = random.Random(4)
    rows = []
    for n in (5, 10, 20, 50, 100):
        for _ in range(40):
            line = made(rng, n)
            other, budget = list(line), 0.19 * len(" ".join(line))
            for at in rng.sample(range(n), n):
                if len(line[at]) + 2 <= budget:
                    other[at] = "x" * len(line[at])
                    budget -= len(line[at])
            rows += [(len(rows), " ".join(line)), (len(rows) + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dropped = {r.doc_id for r in ld.line_decisions(docs).collect() if not r.kept}
    changed = [i for i, t in rows if i % 2 and t != rows[i - 1][1]]
    assert len(set(changed) & dropped) >= 0.95 * len(changed)


def test_words_put_before_a_very_long_line(spark):
    rng = random.Random(6)
    line = made(rng, 9000)
    docs = spark.createDataFrame([(1, " ".join(line)), (2, " ".join(made(rng, 420) + line))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in ld.line_decisions(docs).collect()} == {1: True, 2: False}
