"""Learned sentences against plain Python, on cases that matter, and against SQL."""

import math
import os
import random
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
import regex
from lexiscope.operators import sentences as st
from lexiscope.plans.frames import Corpus

SF = "/root/testdata/sf0.001"
SPACES, CLOSERS = " \t\n\x0b\x0c\r", "\"')]}»”’*"


def core(chunk):
    return chunk.lstrip("\"'([{«“‘*").rstrip(CLOSERS + ",;:")


def word(c):
    bare = c.rstrip(".!?")
    return st.NUMBER if regex.fullmatch(r"[+-]?[0-9][0-9.,]*", bare) else bare.lower()


def case(c):
    return "U" if regex.match(r"\p{Lu}", c) else "L" if regex.match(r"\p{Ll}", c) else "-"


def stop(chunk):
    c = core(chunk)
    if chunk.rstrip(CLOSERS)[-1:] in tuple(",;:") or not c or c[-1] not in ".!?":
        return "-"
    return "!" if c[-1] in "!?" else "e" if c.endswith("..") else "." + word(c)


def chunks_of(text):
    return [c for c in regex.split(f"[{SPACES}]+", text or "") if core(c)]


class Brute:
    """The same model, token by token."""

    def __init__(self, texts):
        with_stop, without, events = Counter(), Counter(), []
        for text in texts:
            chunks = chunks_of(text)
            for before, chunk in zip([None, *chunks], chunks, strict=False):
                c = core(chunk)
                (with_stop if c.endswith(".") else without)[word(c)] += 1
                events.append((stop(before) if before else "", word(c), case(c)))
        seen, total, stops = with_stop + without, len(events), sum(with_stop.values())
        xlog = lambda n, p: n * math.log(max(p, 1e-300)) if n > 0 else 0.0
        binomial = lambda k, n, p: xlog(k, p) + xlog(n - k, 1 - p)
        lettered = lambda w: regex.search(r"\p{L}", w) and w != st.NUMBER

        def pair(a, b, both):
            free = binomial(both, a, b / total) + binomial(b - both, total - a, b / total)
            return -2 * (free - binomial(both, a, both / a) - binomial(b - both, total - a, (b - both) / (total - a) if total > a else 0.0))

        self.abbreviations = set()
        for w, k in with_stop.items():
            if lettered(w):
                letters, n = len(w) - w.count("."), seen[w]
                score = -2 * (binomial(k, n, stops / total) - binomial(k, n, 0.99)) * math.exp(-letters) * (w.count(".") + 1) * letters ** -without[w]
                if score >= 0.3:
                    self.abbreviations.add(w)
        special = lambda w: w in self.abbreviations or w == st.NUMBER or regex.fullmatch(r"\p{L}", w)
        self.flags, begins, pairs, breaks = defaultdict(set), Counter(), Counter(), 0
        for before, w, k in events:
            place = "middle" if before == "-" else "unknown" if before == "e" or before[:1] == "." and special(before[1:]) else "begin"
            self.flags[w] |= {k, (k, place)}
            if place == "begin" and before:
                begins[w] += 1
                breaks += 1
            if place == "unknown" and before != "e" and lettered(w):
                pairs[before[1:], w] += 1
        self.starters = {w for w, n in begins.items() if lettered(w) and n >= 5 and total * n > seen[w] * breaks and pair(breaks, seen[w], n) >= 30}
        self.pairs = {(a, b) for (a, b), n in pairs.items() if n >= 2 and total * n > seen[a] * seen[b] and pair(seen[a], seen[b], n) >= 7.88}

    def ends(self, last, first):
        before, c = stop(last), core(first)
        w, k, flags = word(c), case(c), self.flags.get(word(c), set())
        if before in ("!", "-"):
            return True
        yes = k == "U" and "L" in flags and ("U", "middle") not in flags
        no = k == "L" and ("U" in flags or ("L", "begin") not in flags)
        begins = yes or k == "U" and w in self.starters
        left = before[1:]
        initial = bool(regex.fullmatch(r"\p{L}", left))
        if before == "e":
            return begins
        if (left, w) in self.pairs:
            return False
        if left in self.abbreviations:
            return begins and not initial
        if left == st.NUMBER:
            return not no
        return not no and not (k == "U" and "L" not in flags) if initial else True

    def split(self, text):
        found = [s for s in regex.split(f"(?<=[.!?][{regex.escape(CLOSERS)}]*[{SPACES}]+)(?=[^{SPACES}])", (text or "").replace(st.CUT, ""), flags=regex.V0) if s]
        out, now = [], ""
        for i, s in enumerate(found):
            now += s
            if i + 1 == len(found) or self.ends(s.split()[-1], found[i + 1].split()[0]):
                out.append(now.strip(SPACES))
                now = ""
        return [s for s in out if s]


def made(n, seed=1):
    rng = random.Random(seed)
    words = ["the", "cell", "growth", "was", "seen", "patients", "with", "Smith", "Vienna", "élan", "e.g", "mg", "3.5", "10", "no", "A", "B"]
    special = ["Dr. Smith", "J. R. Smith", "e.g. the cell", "approx. ten", "Fig. 2", "etc., and", "No. 7 was", "in vol. ix", "(cf. Jones)", "... and", "... The", "p. 12."]
    texts = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(4)):
            body = [rng.choice(words if rng.random() < 0.75 else special) for _ in range(rng.randrange(1, 9))]
            first = rng.choice(["The", "However,", "We", "It", "“They", "then"])
            out.append(" ".join([first, *body]) + rng.choice([".", ".", ".", "!", "?", ".”", "...", ".)", ""]))
        texts.append(rng.choice([" ", "  ", "\n", " \t"]).join(out))
    return texts + ["", None, "   ", ". . .", "?!", "a.b. c", f"x.{st.CUT} Y", "One.Two. Three"]


def test_against_python(spark):
    texts = made(400)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    brute, model = Brute(texts), st.learn(df)
    words = {r.word: r for r in model.words.collect()}
    assert {w for w, r in words.items() if r.abbreviation} == brute.abbreviations and {"dr", "approx", "cf"} <= brute.abbreviations
    assert {w for w, r in words.items() if r.starter} == brute.starters and "however" in brute.starters
    assert {tuple(r) for r in model.pairs.collect()} == brute.pairs and brute.pairs
    got = defaultdict(dict)
    for r in st.split(df, ["id"], model).collect():
        got[r.id][r.sentence_no] = r.sentence
    want = {i: brute.split(t) for i, t in enumerate(texts)}
    assert {i: [s for _, s in sorted(got[i].items())] for i in want} == want
    assert any("Dr. Smith" in s and s.count(".") > 2 for x in want.values() for s in x)


def test_other_texts_than_those_learned_from(spark):
    texts = made(300, 2)
    model, brute = st.learn(spark.createDataFrame([(t,) for t in texts], "text string")), Brute(texts)
    new = ["We met Dr. Zweig today. It rained.", "Dr. who? Dr. Unseen. unknown words. 12. Then 7. then", "A. Zeta came. B. zeta went. Ok"]
    df = spark.createDataFrame(list(enumerate(new)), "id int, text string")
    got = {(r.id, r.sentence) for r in st.split(df, ["id"], model).collect()}
    assert got == {(i, s) for i, t in enumerate(new) for s in brute.split(t)} and (0, "We met Dr. Zweig today.") in got


def test_empty_table_and_saved_model(spark, tmp_path):
    empty = spark.createDataFrame([], "id int, text string")
    model = st.learn(empty)
    assert model.words.count() == 0 and st.split(empty, ["id"], model).count() == 0
    model.save(str(tmp_path / "m"))
    again = st.SentenceModel.load(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([(1, "One. Two e. f."), (2, None), (3, " ")], "id int, text string")
    assert sorted(r.sentence for r in st.split(df, ["id"], again).collect()) == ["One.", "Two e. f."]


def test_corpus_counts_learned_sentences(spark):
    texts = made(120, 3)
    keys = [("c", "s", str(i // 3), i % 3, t) for i, t in enumerate(texts)]
    passages = spark.createDataFrame(keys, "corpus string, subset string, document_id string, passage_no int, text string")
    plain = Corpus(passages.select("corpus", "subset", "document_id").distinct(), passages.filter(f"coalesce(instr(text, '{st.CUT}'), 0) = 0"))
    learned, brute = replace(plain, sentence_model=st.learn(passages)), Brute(texts)
    want = Counter()
    for *_, document, _, t in keys:
        want[document] += len(brute.split(t)) if st.CUT not in (t or "") else 0
    sizes = {r.document_id: r for r in learned.document_sizes().collect()}
    assert {k: r.sentences for k, r in sizes.items()} == want
    assert {k: (r.passages, r.chars, r.tokens) for k, r in sizes.items()} == {r.document_id: (r.passages, r.chars, r.tokens) for r in plain.document_sizes().collect()}
    assert learned.exploded("sentence").count() == sum(want.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["s03_sentence_model_words", "m09_learned_sentences_per_document_stats"])
def test_sql(spark, name):
    import duckdb
    from lexiscope.plans.sentence_queries import ORACLES, QUERIES

    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()), key=str)


def test_last_chunks_take_time_in_proportion(spark):
    import time

    long = "x" * 150_000
    df = spark.createDataFrame([(1, f"{long} b. One {long}.\t“ ”Two.) \u2028 Dr.\r\n C. and"), (2, "* ' \"; Dr. ** Smith\tcame.;) \x0b(x.) Y")], "id int, text string")
    start = time.time()
    got = {(r.id, r.at): r.chunk for r in df.select("id", st.F.posexplode(st._cut(st.F.col("text"))).alias("at", "s")).select("id", "at", st._last(st.F.col("s")).alias("chunk")).collect()}
    assert time.time() - start < 20
    assert got == {(1, 0): "b.", (1, 1): f"{long}.", (1, 2): "”Two.)", (1, 3): "Dr.", (1, 4): "C.", (1, 5): "and", (2, 0): "Dr.", (2, 1): "(x.)", (2, 2): "Y"}
    brute = Counter()
    for r in df.collect():
        chunks = chunks_of(r.text)
        for before, chunk in zip([None, *chunks], chunks, strict=False):
            brute[stop(before) if before else "", word(core(chunk)), core(chunk).endswith("."), case(core(chunk))] += 1
    assert {(r.before, r.word, r.period, r.case): r.n for r in st.context_counts(df).collect()} == brute


def test_no_shuffle_carries_the_texts(spark):
    passages = spark.createDataFrame([("c", "s", "d", i, t) for i, t in enumerate(made(60, 4))], "corpus string, subset string, document_id string, passage_no int, text string")
    sizes = replace(Corpus(passages.select("corpus", "subset", "document_id").distinct(), passages), sentence_model=st.learn(passages)).passage_sizes()
    plan = sizes._jdf.queryExecution().optimizedPlan().toString()
    joins = plan.count("Join LeftOuter")
    assert joins == 1 and "segment" not in plan.split("Join LeftOuter")[0]
