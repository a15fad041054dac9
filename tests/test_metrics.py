import json
import math
import tarfile

import pytest
from lexiscope.operators import metadata as md
from lexiscope.operators import statistics as st
from lexiscope.operators.metrics import METRICS, metric
from lexiscope.plans import battery as bt
from lexiscope.plans.frames import LEAF, Corpus
from lexiscope.plans.targets import AnnotationFilter, target_frame
from pyspark.sql import functions as F

TARGETS = {"t": [("k", "train")], "none": [("k", "absent")]}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("k", "train", "doc1"), ("k", "train", "doc2"), ("k", "train", "doc3")], "corpus string, subset string, document_id string")
    passages = spark.createDataFrame([("k", "train", "doc1", 0, "cell chemical"), ("k", "train", "doc2", 0, "Cell_cell. Été!")], "corpus string, subset string, document_id string, passage_no int, text string")
    leaf = lambda i, m="exact": (i, "R", m)
    rows = [
        ("k", "train", "doc1", "cell", [(0, 4)], "Cell", [], None, [], []),
        ("k", "train", "doc1", "chemical", [(5, 13)], "Chemical", [leaf("1"), leaf("2", "related")], "x(1;2)", ["alternative"], ["exact", "related"]),
        ("k", "train", "doc2", "cell", [(0, 2), (3, 4)], "Cell", [leaf(None, "NIL")], "NIL", [], ["NIL"]),
        ("k", "train", "doc2", "cell", [(0, 4)], None, [leaf("1")], "1", [], ["exact"]),
    ]
    schema = f"corpus string, subset string, document_id string, text string, spans array<struct<start:int,end:int>>, label string, links array<{LEAF}>, link_key string, link_relations array<string>, match_types array<string>"
    return Corpus(docs, passages, spark.createDataFrame(rows, schema))


def run(spark, corpus, name, scopes=None, where=None):
    rows = METRICS[name].run(corpus, target_frame(spark, TARGETS), scopes or {}, where).collect()
    return {(r.target, r.scope): r for r in rows}


def test_counts(spark, corpus):
    value = lambda n, **k: {t: r.value for (t, _), r in run(spark, corpus, n, **k).items()}
    assert value("document_count") == {"t": 3, "none": 0}
    assert value("token_count") == {"t": 5, "none": 0}
    assert value("sentence_count") == {"t": 3, "none": 0}
    assert value("identifier_count") == {"t": 4, "none": 0}
    assert value("unique_identifiers") == {"t": 3, "none": 0}
    assert value("unique_tokens") == {"t": 3, "none": 0}


def test_zero_documents_and_scopes(spark, corpus):
    got = run(spark, corpus, "annotations_per_document_stats", {"cell": ["Cell"], "empty": []})
    assert set(got) == {("t", "all"), ("t", "cell"), ("none", "all"), ("none", "cell")}
    all_, cell, none = got["t", "all"], got["t", "cell"], got["none", "all"]
    assert (all_.mean, all_.min, all_.median, all_.max, all_["count"]) == (pytest.approx(4 / 3), 0, 2, 2, 3)
    assert cell.mean == pytest.approx(2 / 3) and none["count"] == 0 and none.mean is None
    unique = run(spark, corpus, "unique_identifiers_per_document_stats")["t", "all"]
    assert unique.max == 2 and unique.mean == pytest.approx(4 / 3)


def test_degrees_and_distributions(spark, corpus):
    assert run(spark, corpus, "ambiguity_degree_stats")["t", "all"].max == 3
    assert run(spark, corpus, "variation_degree_stats")["t", "all"].max == 1
    rows = METRICS["label_distribution"].run(corpus, target_frame(spark, TARGETS), {}).collect()
    assert {r.key: (r["count"], r.proportion) for r in rows} == {"Cell": (2, 0.5), "Chemical": (1, 0.25), "null": (1, 0.25)}


@pytest.mark.parametrize(
    ("where", "n"),
    [
        (AnnotationFilter(), 4), (AnnotationFilter(labels=frozenset()), 0), (AnnotationFilter(labels=frozenset({"Cell"})), 2), (AnnotationFilter(relations=frozenset()), 3),
        (AnnotationFilter(relations=frozenset({"distributive"})), 3), (AnnotationFilter(match_types=frozenset({"exact"})), 2), (AnnotationFilter(match_types=frozenset()), 1),
    ],
)
def test_filters(spark, corpus, where, n):
    assert run(spark, corpus, "mention_count", where=where)["t", "all"].value == n


def test_repeated_listing_counts_twice(spark, corpus):
    targets = target_frame(spark, {"t": [("k", "train"), ("k", "train")]})
    assert METRICS["document_count"].run(corpus, targets).first().value == 6


def test_registry_rejects_duplicates():
    with pytest.raises(ValueError):
        metric("token_count")(lambda *a: None)
    with pytest.raises(ValueError):
        AnnotationFilter.of({"match_types": ["nearly"]})


def test_describe(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 9)] + [("b", 5.0)], "k string, value double")
    got = {r.k: r for r in st.describe(df, ["k"]).collect()}
    assert (got["a"].mean, got["a"].median, got["a"]["count"]) == (3.5, 2.0, 4) and got["a"].stdev == pytest.approx(3.69684550, abs=1e-8)
    assert got["b"].stdev is None and got["b"].max == 5.0


def test_overlap_with_null_member(spark, corpus):
    targets = target_frame(spark, {"t": [("k", "train")], "u": [("k", None)]})
    pairs = spark.createDataFrame([("t", "u")], "target1 string, target2 string")
    (r,) = METRICS["identifier_overlap"].run(corpus, targets, pairs).collect()
    assert (r.n1, r.n2, r.n_intersection, r.jaccard) == (3, 3, 3, 1.0)


def frames(spark):
    journals = spark.createDataFrame([("1", "J1", ["Term One"]), ("2", "J2", ["Term One", "Term Two"]), ("3", "J3", [])], "journal_id string, name string, mesh_topics array<string>")
    weights = spark.createDataFrame([("Term One", "Root A", 1.0), ("Term Two", "Root B", 1.0)], "term string, key string, w double")
    names = spark.createDataFrame([("J3", ["Fallback A", "Fallback B"])], "name string, topics array<string>")
    return journals, weights, names


def test_journal_audits(spark):
    journals, weights, names = frames(spark)
    articles = spark.createDataFrame([("k", "s", str(i), j, j, "2000", None) for i, j in enumerate(["2", "2", "3", "3", "3"])], "corpus string, subset string, document_id string, journal string, journal_id string, pub_year string, mesh_topics array<string>")
    profile = md.journal_profile(journals, weights, names, False)
    assert {r.key: r.total for r in md.journal_totals(articles, journals, profile).collect()} == {"Root A": 1.0, "Root B": 1.0, "Fallback A": 1.5, "Fallback B": 1.5}
    assert {r.term: r.total for r in md.journal_term_totals(articles, journals).collect()} == {"Term One": 1.0, "Term Two": 1.0}


def test_article_audit_sources(spark):
    journals, weights, names = frames(spark)
    rows = [("a", "1", ["Term Two", "Nowhere"]), ("b", "3", []), ("c", "1", None), ("d", "9", ["Nowhere"]), ("e", "1", ["Term Two"])]
    articles = spark.createDataFrame([("k", "s", d, j, j, None, m) for d, j, m in rows], "corpus string, subset string, document_id string, journal string, journal_id string, pub_year string, mesh_topics array<string>")
    profile = md.journal_profile(journals, weights, names, True)
    got = {r.document_id: r for r in md.article_audit(articles, weights, profile).collect()}
    assert {k: r.source for k, r in got.items()} == {"a": "article_mesh+journal_mesh", "b": "journal_name", "c": "journal_mesh", "d": "unknown", "e": "article_mesh"}
    assert got["a"].weights == {"Root A": 0.5, "Root B": 0.5} and got["a"].own_weights == {"Root B": 0.5} and got["d"].weights == {"Unknown": 1.0}
    assert {r.key: r.total for r in md.article_totals(articles, weights, profile, False).collect()} == {"Root B": 1.5}
    assert {r.term: r.total for r in md.unmapped_terms(articles, weights).collect()} == {"Nowhere": 1.5}


YAML = """
corpora: {k: [{reader: memory, subset: train}]}
bundles: {t: [[k, train]], u: [[k]]}
entity_scopes: {cell: {labels: [Cell]}, every: {include_all: true}}
metrics:
  - {result: n, metric: document_count, bundles: [t, u]}
  - {result: labels, metric: label_distribution, bundles: [t]}
  - {result: filtered, metric: mention_count, bundles: [t], filter: cell}
  - {result: same, metric: mention_overlap, pairs: [[t, u]]}
"""


def test_battery(spark, corpus, tmp_path):
    bt.READERS["memory"] = lambda spark, corpus, subset, kept=corpus: kept
    b = bt.Battery.from_yaml(YAML)
    out = bt.payload(b.run(spark), {m["result"]: m["metric"] for m in b.metrics})
    assert {x["result_name"]: x["value"] for x in out["t"] if x["result_name"] != "labels"} == {"n": 3, "filtered": 2}
    labels = next(x for x in out["t"] if x["result_name"] == "labels")
    assert labels["scopes"]["cell"]["value"] == {"Cell": 1.0} and labels["details"]["total"] == 4
    assert out["t|u"][0]["value"] == 1.0
    path = tmp_path / "out.json"
    text = bt.write_json({"a": math.nan, "b": [1]}, str(path))
    assert bt.differences(json.loads(text), {"a": math.nan, "b": [1.0]}) == ["/b/0: int and float"]
    for bad in (YAML.replace("metric: document_count", "metric: nothing"), YAML.replace("bundles: [t, u]", "bundles: [z]"), YAML.replace("reader: memory", "reader: gone"), YAML.replace("result: labels", "result: n")):
        with pytest.raises(ValueError):
            bt.Battery.from_yaml(bad)


TERMS = """
corpora: {k: [{reader: memory, subset: train}]}
bundles: {t: [[k]]}
terminologies: {cells: {reader: obo, path: PATH, prefix: CL, aliases: [CL]}}
metrics:
  - {result: tops, metric: high_level_concept_counts, bundles: [t], terminology: cells}
  - {result: depths, metric: concept_depth_counts, bundles: [t], terminology: cells}
"""


def test_battery_with_terminology(spark, tmp_path):
    obo = tmp_path / "c.obo"
    obo.write_text("format-version: 1.2\n\n[Term]\nid: CL:1\nname: root\n\n[Term]\nid: CL:2\nname: child\nis_a: CL:1 ! root\n")
    leaf = "array<struct<identifier:string,resource:string,match_type:string>>"
    mentions = spark.createDataFrame([("k", "train", "a", "Cell", [("2", "CL", "exact"), ("X", "Other", "exact")])], f"corpus string, subset string, document_id string, label string, links {leaf}")
    b = bt.Battery.from_yaml(TERMS.replace("PATH", str(obo)))
    out = bt.payload(b.run(spark, Corpus(mentions, mentions, mentions)), {m["result"]: m["metric"] for m in b.metrics})
    got = {x["result_name"]: x["value"] for x in out["t"]}
    assert [(r["key"], r["terminology_total"], r["terminology_proportion"]) for r in got["tops"]] == [("CL:1", 2.0, 0.5)]
    assert [(r["depth"], r["count"], r["share"]) for r in got["depths"]] == [(1, 0.0, 0.0), (2, 1.0, 1.0)]
    for bad in (TERMS.replace("reader: obo", "reader: gone"), TERMS.replace(", terminology: cells}", "}")):
        with pytest.raises(ValueError):
            bt.Battery.from_yaml(bad)
    with pytest.raises(ValueError, match="unknown terminology"):
        bt.Battery({}, {"t": [("k", None)]}, [{"result": "x", "metric": "concept_depth_counts", "bundles": ["t"], "terminology": "none"}]).run(spark, Corpus(mentions, mentions, mentions))


def test_streaming_profile(spark, tmp_path):
    from lexiscope.streaming import refresh

    folder, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    schema = "source string, text string"
    for k in range(2):
        spark.createDataFrame([("a", "One. Two three."), ("b", None)], schema).write.mode("append").parquet(folder)
        refresh.refresh(spark, folder, schema, ledger, str(tmp_path / "cp")).awaitTermination()
    rows = {r.source: (r.documents, r.chars, r.sentences, r.tokens) for r in refresh.current(spark, ledger).collect()}
    assert rows == {"a": (2, 30, 4, 6), "b": (2, 0, 0, 0)}


def test_unpacking(tmp_path):
    from lexiscope.sources import acquisition as aq

    (tmp_path / "a.txt").write_text("x")
    with tarfile.open(tmp_path / "ok.tar.gz", "w:gz") as t:
        t.add(tmp_path / "a.txt", "in/a.txt")
    with tarfile.open(tmp_path / "bad.tar", "w") as t:
        t.add(tmp_path / "a.txt", "../escaped.txt")
    target = str(tmp_path / "out")
    assert aq.ensure_ready(target, [str(tmp_path / "ok.tar.gz")], ["in/a.txt"]) and not aq.ensure_ready(target, [], ["in/a.txt"])
    with pytest.raises(ValueError):
        aq.unpack(str(tmp_path / "bad.tar"), target)


def test_text_functions(spark):
    from lexiscope.functions import text as tx

    row = spark.range(1).select(
        tx.tokens(F.lit("Ab_c été, 12!")).alias("t"), tx.dedupe(F.array(F.lit(" a  b "), F.lit("a b"), F.lit(" "))).alias("d"), tx.iri_concept(F.lit("http://x/y#GO_1")).alias("i"), tx.issn(F.lit("1234-567x")).alias("s"),
        tx.tree_prefixes(F.lit("a.b.c")).alias("p"), tx.tokens(F.lit(None).cast("string")).alias("n"),
    ).first()
    assert row.t == ["ab", "c", "été", "12"] and row.d == ["a b"] and row.i == "GO:1" and row.s == "1234567X" and row.p == ["a.b.c", "a.b", "a"] and row.n == []


def test_report_and_cli(spark, tmp_path, capsys):
    from lexiscope.cli import main
    from lexiscope.plans.report import page

    frame = spark.createDataFrame([("a<b", 1.5), (None, None)], "k string, v double")
    out = page("T&C", {"summary": {"one": frame}, "own": {"two": frame}, "counts": {}})
    assert "a&lt;b" in out and out.count("<section") == 2 and "T&amp;C" in out
    (tmp_path / "a.json").write_text('{"x": [1, NaN]}')
    (tmp_path / "b.json").write_text('{"x": [2, NaN]}')
    assert main(["diff", str(tmp_path / "a.json"), str(tmp_path / "a.json")]) == 0
    assert main(["diff", str(tmp_path / "a.json"), str(tmp_path / "b.json")]) == 1 and "/x/0: 1 and 2" in capsys.readouterr().out
    assert main([]) == 2


def test_saved_corpus(spark, corpus, tmp_path):
    from lexiscope.plans.frames import load, save

    save(corpus, str(tmp_path / "c"))
    back = load(spark, str(tmp_path / "c"))
    assert back.documents.count() == 3 and back.annotations.filter("subset = 'train'").count() == 4 and set(back.passages.columns) == set(corpus.passages.columns)


def test_reconcile_and_identifiers(spark):
    schema = "document_id string, pub_year string, journal string"
    old = spark.createDataFrame([("a", "1999", "J. Name"), ("b", None, None)], schema)
    got = {r.document_id: (r.pub_year, r.journal) for r in md.reconcile(old, spark.createDataFrame([("a", "2000", "j name"), ("b", "2001", "K"), ("c", "2002", "L")], schema), "document_id").collect()}
    assert got == {"a": ("1999", "J. Name"), "b": ("2001", "K"), "c": ("2002", "L")}
    with pytest.raises(Exception, match="journals differ"):
        md.reconcile(old, spark.createDataFrame([("a", None, "Other")], schema), "document_id").collect()
    ids = "identifiers map<string,array<string>>"
    journals = spark.createDataFrame([(1, {"nlm": ["5"], "issn": ["x"]}), (2, {"issn": ["x", "y"]})], f"journal_id long, {ids}")
    wanted = spark.createDataFrame([("p", {"issn": ["y"]}), ("q", {"issn": ["x"]}), ("r", {"nlm": ["5"], "issn": ["y"]})], f"key string, {ids}")
    assert {r.key: r.journal_id for r in md.match_journal_identifiers(wanted, journals).collect()} == {"p": 2, "r": 1}


def test_truth_values():
    from lexiscope.functions.text import as_bool

    assert as_bool(" Yes") and not as_bool("0")
    with pytest.raises(ValueError):
        as_bool("maybe")


def test_deviation_of_large_values(spark):
    from lexiscope.operators.statistics import describe

    df = spark.createDataFrame([("a", 1e9 + 0.1), ("a", 1e9 + 0.2), ("a", 1e9 + 0.3), ("b", 5.0)], "k string, value double")
    got = {r.k: r for r in describe(df, ["k"]).collect()}
    assert abs(got["a"].stdev - 0.1) < 1e-6 and got["b"].stdev is None and got["a"]["count"] == 3
