"""A summary gives what its corpus gives, for every metric, and reads it once."""

import pytest
from lexiscope.operators import summaries as sm
from lexiscope.operators.metrics import METRICS
from lexiscope.plans import battery as bt
from lexiscope.plans.frames import LEAF, Corpus
from lexiscope.plans.targets import AnnotationFilter, target_frame
from pyspark.sql import functions as F

TARGETS = {"t": [("k", "train")], "twice": [("k", "train"), ("k", "train"), ("k", None)], "none": [("k", "absent")]}
SCOPES = {"cell": ["Cell"], "both": ["Cell", "Chemical"], "empty": []}


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([("k", s, f"d{i}") for i in range(5) for s in ("train", "dev")], "corpus string, subset string, document_id string")
    texts = [("train", "d0", "cell chemical. Cell"), ("train", "d1", "Cell_cell. Été!"), ("train", "d1", ""), ("dev", "d0", "cell chemical. Cell"), ("dev", "d2", None)]
    passages = spark.createDataFrame([("k", s, d, i, t) for i, (s, d, t) in enumerate(texts)], "corpus string, subset string, document_id string, passage_no int, text string")
    leaf = lambda i, m="exact", r="R": (i, r, m)
    rows = []
    for subset, doc in (("train", "d0"), ("train", "d1"), ("train", "d1"), ("dev", "d4")):
        rows += [
            ("k", subset, doc, "cell", [(0, 4)], "Cell", [], None, [], []),
            ("k", subset, doc, "chemical x", [(5, 13)], "Chemical", [leaf("1"), leaf("2", "related")], "x(1;2)", ["alternative"], ["exact", "related"]),
            ("k", subset, doc, "cell", [(0, 2), (3, 4)], "Chemical", [leaf(None, "NIL", "<NIL>")], "NIL", [], ["NIL"]),
            ("k", subset, doc, "Cell" + doc, [(0, 4)], None, [leaf("1"), leaf(None, "NIL", "<NIL>")], "1", [], ["exact"]),
            ("k", subset, doc, None, [], "Cell", [leaf("3", r=None)], "3", [], ["exact"]),
        ]
    schema = f"corpus string, subset string, document_id string, text string, spans array<struct<start:int,end:int>>, label string, links array<{LEAF}>, link_key string, link_relations array<string>, match_types array<string>"
    return Corpus(docs, passages, spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def summary(corpus):
    return sm.summarised(corpus, SCOPES)


def rows(df):
    return sorted((str(sorted(r.asDict().items())) for r in df.collect()))


def run(spark, source, name, where=None):
    found, targets = METRICS[name], target_frame(spark, TARGETS)
    scopes = SCOPES if found.scoped and not where else {}
    if found.kind == "cross":
        return rows(found.run(source, targets, spark.createDataFrame([("t", "twice")], "target1 string, target2 string"), scopes, where))
    return rows(found.run(source, targets, scopes, where))


def test_every_metric_of_a_corpus_follows_from_its_summary(spark, corpus, summary):
    assert set(sm.NEEDS) == set(METRICS)
    wrong = [m for m in METRICS if run(spark, corpus, m) != run(spark, summary, m)]
    assert not wrong


def test_filters_and_other_scopes(spark, corpus, summary):
    where = AnnotationFilter(labels=frozenset({"Chemical"}), match_types=frozenset({"exact", "related"}))
    for name in ("mention_count", "identifier_redundancy_stats", "label_distribution", "mention_overlap"):
        assert run(spark, corpus, name, where) == run(spark, summary, name, where)
    with pytest.raises(ValueError):
        run(spark, summary, "annotations_per_document_stats", where)
    targets, late = target_frame(spark, TARGETS), {"late": ["Chemical"]}
    stats = METRICS["annotations_per_document_stats"].run
    assert rows(stats(summary, targets, late)) == rows(stats(corpus, targets, late))
    with pytest.raises(ValueError):
        METRICS["unique_mentions_per_document_stats"].run(summary, targets, late)


def test_summaries_of_disjoint_documents_add_up(spark, corpus, summary):
    cut = lambda c: Corpus(*(df.filter(c) for df in (corpus.documents, corpus.passages, corpus.annotations)))
    both = sm.summarised(cut("document_id < 'd1'"), SCOPES).union(sm.summarised(cut("document_id >= 'd1'"), SCOPES))
    for part in sm.PARTS:
        assert rows(getattr(both, part)) == rows(getattr(summary, part))
    with pytest.raises(ValueError):
        both.union(sm.summarised(corpus, {}))


def test_a_battery_reads_its_annotations_once(spark, corpus, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def marked(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = Corpus(corpus.documents, corpus.passages, corpus.annotations.mapInArrow(marked, corpus.annotations.schema))
    metrics = ["mention_count", "identifier_count", "mention_length_stats", "annotations_per_document_stats", "unique_mentions_per_document_stats", "ambiguity_degree_stats", "label_distribution"]
    battery = bt.Battery({"k": []}, TARGETS, [{"result": m, "metric": m, "bundles": list(TARGETS)} for m in metrics], {k: v for k, v in SCOPES.items() if v})
    plain = {k: rows(v) for k, v in battery.run(spark, corpus).items()}
    shared = {k: rows(v) for k, v in battery.run(spark, watched, summary=battery.summary(watched)).items()}
    assert shared == plain and seen.value == corpus.annotations.count()


def test_a_corpus_without_documents(spark, corpus):
    none = Corpus(*(df.filter("false") for df in (corpus.documents, corpus.passages, corpus.annotations)))
    empty = sm.summarised(none, SCOPES)
    assert all(run(spark, none, m) == run(spark, empty, m) for m in ("mention_count", "annotations_per_document_stats", "token_length_stats", "label_distribution", "token_overlap"))
    empty.discard()


def test_parts_that_were_not_asked_for(spark, corpus):
    small = sm.summary_for(corpus, ["token_length_stats", "unique_tokens"])
    assert small.profiles is None and small.mentions is None
    assert {r.unit for r in small.units.select(F.col("unit")).distinct().collect()} == {"token"}
    with pytest.raises(ValueError):
        METRICS["document_length_stats"].run(small, target_frame(spark, TARGETS))
