import random

import pytest
from lexiscope.operators import terminology as tm
from lexiscope.sources import terminologies as src

SCHEMA = "seq long, ui string, name string, tree_numbers array<string>, parent_ids array<string>, mapped_ui_ids array<string>, alt_ids array<string>"


def terms(spark, rows, **kw):
    full = [(i, ui, name, t, p, m, a) for i, (ui, name, t, p, m, a) in enumerate(rows)]
    return tm.Terminology(spark.createDataFrame(full, SCHEMA), **kw)


def test_supplements_map_to_tree(spark):
    t = terms(spark, [("R1", "Root", ["A01"], [], [], []), ("D1", "Desc", ["A01.001"], [], [], []), ("S1", "s1", [], [], ["D1"], []), ("S2", "s2", [], [], ["D1"], [])], aliases=("MESH",))
    ids = spark.createDataFrame([("x", "all", "S1", 2), ("x", "all", "S2", 1)], "target string, scope string, id string, n long")
    (row,) = tm.branch_coverage(ids, t, t.branch_weights()).collect()
    assert (row.key, row["count"], row.annotation_count, row.terminology_total) == ("R1", 2.0, 3.0, 4.0)


def test_override_drops_empty_parents(spark):
    t = terms(spark, [("R1", "Root", ["C01"], [], [], []), ("D1", "One", ["C01.001"], [], [], []), ("D2", "Two", ["C01.002"], [], [], []), ("O1", "Other", ["D08.001"], [], [], []), ("S1", "s1", [], [], ["D1", "O1", "D2"], []), ("S2", "s2", [], [], ["O1"], [])])
    topics = spark.createDataFrame([("One", "Topic One"), ("Two", "Topic Two")], "term string, topic string")
    got = {(r.ui, r.key): round(r.w, 6) for r in t.anchor_weights(topics).collect()}
    assert got == {("D1", "Topic One"): 1.0, ("D2", "Topic Two"): 1.0, ("S1", "Topic One"): 0.5, ("S1", "Topic Two"): 0.5}
    ids = spark.createDataFrame([("x", "all", "S1", 1), ("x", "all", "S2", 1)], "target string, scope string, id string, n long")
    rows = {r.key: (r["count"], r.terminology_total, r.annotation_proportion) for r in tm.branch_coverage(ids, t, t.anchor_weights(topics), topics.selectExpr("topic AS key")).collect()}
    assert rows == {"Topic One": (0.5, 1.5, 0.25), "Topic Two": (0.5, 1.5, 0.25)}


def test_missing_ids_stay_in_the_denominator(spark):
    t = terms(spark, [("R1", "Root", [], [], [], []), ("T1", "Term", [], ["R1"], [], ["OLD2"])], prefix="R")
    ids = spark.createDataFrame([("x", "all", "T1", 1), ("x", "all", "OLD2", 1), ("x", "all", "OLD:1", 1)], "target string, scope string, id string, n long")
    (row,) = tm.branch_coverage(ids, t, t.branch_weights()).collect()
    assert (row["count"], row.annotation_count, round(row.annotation_proportion, 6)) == (1.0, 2.0, 0.666667) or row.key == "R1"
    s = tm.coverage_summary(ids, t).first()
    assert (s.n_input_ids, s.n_unique_ids, s.n_missing_ids) == (3, 2, 1)


def test_depth_and_cycle(spark):
    t = terms(spark, [("R", "r", [], [], [], []), ("A", "a", [], ["R"], [], []), ("B", "b", [], ["A", "gone"], [], []), ("X", "x", [], ["Y"], [], []), ("Y", "y", [], ["X"], [], [])])
    assert {r.ui: r.depth for r in t.depths().collect()} == {"R": 1, "A": 2, "B": 3, "X": 1, "Y": 1}


def brute(rows, overrides):
    by = {r[0]: r for r in rows}
    marks = {}
    for ui, topic in overrides.items():
        for n in by[ui][2]:
            marks.setdefault(n, set()).add(topic)

    def weights(ui):
        if ui in overrides:
            return {overrides[ui]: 1.0}
        if ui not in by:
            return {}
        found = []
        for n in by[ui][2]:
            parts = n.split(".")
            hits = [t for k in range(len(parts), 0, -1) for t in marks.get(".".join(parts[:k]), ())]
            if hits:
                found.append(hits)
        if found:
            out = {}
            for hits in found:
                for t in hits:
                    out[t] = out.get(t, 0) + 1 / len(hits) / len(found)
            return out
        parents = by[ui][3] or by[ui][4]
        if not parents:
            return {} if overrides else {by[ui][1]: 1.0}
        each = [w for p in parents if (w := weights(p)) or not overrides]
        out = {}
        for w in each:
            for k, v in w.items():
                out[k] = out.get(k, 0) + v / len(each)
        return out

    return {(ui, k): round(v, 9) for ui in by for k, v in weights(ui).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_anchor_weights_against_recursion(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(24):
        parents = rng.sample([f"c{j}" for j in range(i)] + ["gone"], min(i, rng.randint(0, 3))) if i else []
        trees = [".".join(["T"] + [str(rng.randint(0, 1)) for _ in range(rng.randint(1, 3))])] if rng.random() < 0.3 else []
        rows.append((f"c{i}", f"name {i}", trees, parents, [], []))
    for overrides in ({}, {f"c{k}": f"topic {k % 2}" for k in rng.sample(range(24), 4)}):
        t = terms(spark, rows)
        topics = spark.createDataFrame([(f"name {ui[1:]}", topic) for ui, topic in overrides.items()] or [("none", "none")], "term string, topic string")
        got = {(r.ui, r.key): round(r.w, 9) for r in t.anchor_weights(topics).collect()}
        assert got == pytest.approx(brute(rows, overrides))


def test_obo(spark, tmp_path):
    (tmp_path / "x.obo").write_text('format-version: 1.2\n\n[Term]\nid: CL:1\nname: cell\nalt_id: CL:9\nsynonym: "a \\"b\\"" EXACT []\n\n[Term]\nid: CL:2\nname: t cell\nis_a: CL:1 ! cell\n\n[Term]\nid: CL:3\nname: old\nis_obsolete: true\n\n[Typedef]\nid: part_of\n')
    rows = {r.ui: r for r in src.read_obo(spark, str(tmp_path / "x.obo")).collect()}
    assert set(rows) == {"CL:1", "CL:2"} and rows["CL:2"].parent_ids == ["CL:1"] and rows["CL:1"].alt_ids == ["CL:9"] and len(rows["CL:1"].synonyms) == 1
    assert [r.ui for r in src.roots(src.read_obo(spark, str(tmp_path / "x.obo"), True)).collect()].count("CL:1") == 1


def test_mesh(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        "<DescriptorRecordSet><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Top</String></DescriptorName><TreeNumberList><TreeNumber>A01</TreeNumber></TreeNumberList></DescriptorRecord>"
        "<DescriptorRecord><DescriptorUI>D2</DescriptorUI><DescriptorName><String>Low</String></DescriptorName><TreeNumberList><TreeNumber>A01.5</TreeNumber></TreeNumberList></DescriptorRecord></DescriptorRecordSet>"
    )
    (tmp_path / "s.xml").write_text(
        "<SupplementalRecordSet><SupplementalRecord><SupplementalRecordUI>C1</SupplementalRecordUI><SupplementalRecordName><String>Sup</String></SupplementalRecordName>"
        "<HeadingMappedToList><HeadingMappedTo><DescriptorReferredTo><DescriptorUI>*D2</DescriptorUI></DescriptorReferredTo></HeadingMappedTo></HeadingMappedToList></SupplementalRecord></SupplementalRecordSet>"
    )
    rows = {r.ui: r for r in src.read_mesh(spark, str(tmp_path / "d.xml"), str(tmp_path / "s.xml")).collect()}
    assert rows["D2"].parent_ids == ["D1"] and rows["D1"].parent_ids == [] and rows["C1"].mapped_ui_ids == ["D2"]


def test_topic_maps():
    assert src.topic_terms("A: [x, y]\nB: [z]") == {"x": "A", "y": "A", "z": "B"}
    with pytest.raises(ValueError):
        src.topic_terms("A: [x]\nB: [x]")
    with pytest.raises(ValueError):
        src.name_topics('{"J": []}')


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_kept_tables_are_read_again_and_follow_changes(spark, tmp_path, monkeypatch):
    """Equal concepts and topics read what was kept; a changed edge, prefix or topic builds anew; a dead writer leaves nothing."""
    home, built = f"file://{tmp_path}/home", []
    for name in ("_index", "_depths", "_top_ancestors", "_branch_weights", "_depth_weights", "_anchor_weights"):
        real = getattr(tm.Terminology, name)
        monkeypatch.setattr(tm.Terminology, name, lambda self, *a, real=real, name=name: built.append(name) or real(self, *a))
    schema = "seq long, ui string, name string, tree_numbers array<string>, parent_ids array<string>, mapped_ui_ids array<string>, alt_ids array<string>"
    rows = [(1, "A", "a", [], [], [], ["x"]), (2, "B", "b", [], ["A"], [], []), (3, "C", "c", [], ["B", "A"], [], []), (4, "D", "d", ["T1"], [], [], [])]
    make = lambda rows, **kw: tm.Terminology(spark.createDataFrame(rows, schema), home=home, **kw)
    topics = spark.createDataFrame([("b", "two")], "term string, topic string")
    results = lambda t, topics=topics: [rows_of(x) for x in (t.index, t.depths(), t.top_ancestors(), t.branch_weights(), t.depth_weights(), t.anchor_weights(topics))]
    plain = tm.Terminology(spark.createDataFrame(rows, schema))
    want = results(plain)
    built.clear()
    assert results(make(rows)) == want and sorted(set(built)) == ["_anchor_weights", "_branch_weights", "_depth_weights", "_depths", "_index", "_top_ancestors"]
    built.clear()
    assert results(make(rows[::-1])) == want and not built
    changed = [*rows[:2], (3, "C", "c", [], ["B"], [], []), rows[3]]
    assert results(make(changed)) == results(tm.Terminology(spark.createDataFrame(changed, schema))) != want and built
    built.clear()
    other = spark.createDataFrame([("b", "zwei")], "term string, topic string")
    assert rows_of(make(rows).anchor_weights(other)) == [(ui, "zwei", w) for ui, _, w in want[5]] and built == ["_anchor_weights"]
    built.clear()
    make(rows, prefix="p").depths()
    assert "_depths" in built

    def die(self):
        raise KeyboardInterrupt

    monkeypatch.setattr(tm.Terminology, "_depths", die)
    with pytest.raises(KeyboardInterrupt):
        make(rows[:2]).depths()
    monkeypatch.undo()
    assert rows_of(make(rows[:2]).depths()) == [("A", 1), ("B", 2)]


def test_a_name_of_many_concepts_is_never_one_row(spark):
    t = terms(spark, [(f"C{i}", "  Same  name" if i % 2 else "same Name", [], [], [], []) for i in range(40)] + [("C1", "same name", [], [], [], []), ("D", "other", [], [], [], []), (None, "other", [], [], [], []), ("E", None, [], [], [], [])])
    rows = spark.createDataFrame([("SAME NAME", 1), ("Other", 2), ("none", 3), (None, 4), ("SAME NAME", 5)], "term string, n int")
    found = t.named(rows, "term")
    assert found.columns == ["term", "n", "share", "ui"]
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = [("SAME NAME", n, 1 / 40, f"C{i}") for n in (1, 5) for i in range(40)] + [("Other", 2, 1.0, "D")]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    weights = spark.createDataFrame([(f"C{i}", "k", 0.5) for i in range(40)] + [("D", "z", 1.0)], "ui string, key string, w double")
    assert sorted((r.term, r.key, round(r.w, 9)) for r in t.topic_weights(rows, "term", weights).collect()) == [("Other", "z", 1.0), ("SAME NAME", "k", 0.5)]
