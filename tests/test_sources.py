from lexiscope.sources import corpora as c
from lexiscope.sources import terminologies as t
from lexiscope.sources.links import Grammar, leaves, relations
from pyspark.sql import functions as F

BIOC = """<?xml version="1.0"?><collection><source>x</source><date/><key/>
<document><id>d1</id><infon key="pmid">7</infon><passage><infon key="type">title</infon><offset>0</offset><text>cell chemical</text>
<annotation id="a1"><infon key="type">Cell</infon><infon key="identifier">CL:1|CL:2</infon><location offset="0" length="4"/><text>cell</text></annotation>
<annotation id="a2"><infon key="type">Gone</infon><location offset="5" length="8"/><text>chemical</text></annotation></passage></document>
<document><id>d1</id><passage><offset>0</offset><text>later one</text></passage></document>
<document><id>d2</id><passage><offset>0</offset><text>cell</text>
<annotation id="b1"><infon key="type">Cell</infon><infon key="identifier">-</infon><location offset="0" length="2"/><location offset="3" length="1"/><text>ce l</text></annotation></passage></document>
</collection>"""


def test_bioc_last_duplicate_and_links(spark, tmp_path):
    (tmp_path / "x.xml").write_text(BIOC)
    grammar = Grammar(formats=(("|", "alternative", False),), nil=frozenset({"-"}))
    got = c.read_bioc(spark, str(tmp_path / "x.xml"), "k", label_map={"Gone": None}, grammar=grammar)
    texts = {r.document_id: r.text for r in got.passages.collect()}
    assert texts == {"d1": "later one", "d2": "cell"}
    (row,) = got.annotations.collect()
    assert [(s.start, s.end) for s in row.spans] == [(0, 2), (3, 4)]
    assert [(x.identifier, x.resource, x.match_type) for x in row.links] == [(None, "<NIL>", None)]
    whole = c.read_bioc(spark, str(tmp_path), "k", label_map={"Gone": None}, grammar=grammar, whole_folder=True)
    assert whole.documents.count() == 3
    links = {r.mention_id: [x.identifier for x in r.links] for r in whole.annotations.collect()}
    assert links == {"a1": ["1", "2"], "b1": [None]}


def test_pubtator(spark, tmp_path):
    (tmp_path / "p.txt").write_text("12|t|A title\n12|a|An abstract.\n12\t2\t7\ttitle\tThing\tD1\n12\t11\t19\tabstract\tThing\t-1\n\n13|t|B\n13|a|C\n")
    got = c.read_pubtator(spark, str(tmp_path / "p.txt"), "k", grammar=Grammar(nil=frozenset({"-1"}), resource="MESH"))
    assert sorted((r.document_id, r.passage_no, r.text, r.offset) for r in got.passages.collect()) == [("12", 0, "A title", 0), ("12", 1, "An abstract.", 8), ("13", 0, "B", 0), ("13", 1, "C", 2)]
    rows = {r.text: r for r in got.annotations.collect()}
    assert rows["title"].passage_no == 0 and rows["abstract"].passage_no == 1
    assert rows["title"].links[0].resource == "MESH" and rows["abstract"].links[0].match_type == "NIL"


def test_standoff_rejects(spark, tmp_path):
    (tmp_path / "PMID-5.txt").write_text("one two")
    (tmp_path / "PMID-5.ann").write_text("T1\tX 0 3\tone\nT2\tX 4 7\tTWO\nT3\tX 0 1;2 3\to n\nbad\n")
    got, rejected = c.read_standoff(spark, str(tmp_path), "k")
    assert [(r.document_id, r.text) for r in got.annotations.collect()] == [("5", "one")]
    assert sorted(r.reason for r in rejected.collect()) == ["discontinuous span", "not three fields", "text differs from the span's"]


def test_knowtator(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "o").mkdir()
    (tmp_path / "t" / "11.txt").write_text("alpha beta")
    (tmp_path / "o" / "11.txt.knowtator.xml").write_text(
        '<annotations><annotation><mention id="m1"/><span start="0" end="5"/><span start="6" end="6"/><spannedText>alpha</spannedText></annotation>'
        '<classMention id="m1"><mentionClass id="http://x/GO_0001">n</mentionClass></classMention></annotations>'
    )
    got = c.read_knowtator(spark, str(tmp_path / "t"), {"GO": str(tmp_path / "o")}, "k", label_map={"GO": None})
    (row,) = got.annotations.collect()
    assert (row.document_id, row.text, row.label, row.links[0].identifier, row.links[0].resource) == ("11", "alpha", None, "GO:0001", "GO")


def test_grammar_nested(spark):
    g = Grammar(formats=((";", "related_set", True), ("|", "alternative", False)), qualifiers={"~": "related"}, nil=frozenset({"nil"}), resource="R")
    rows = spark.createDataFrame([("a;b|c",), ("~a",), ("~a;b",), ("nil",), ("X:1",)], "t string").select("t", leaves(F.col("t"), g).alias("l"), relations(F.col("t"), g).alias("r")).collect()
    got = {r.t: ([(x.identifier, x.resource, x.match_type) for x in r.l], r.r) for r in rows}
    assert got["a;b|c"] == ([("a", "R", None), ("b", "R", None), ("c", "R", None)], ["related_set", "alternative"])
    assert got["~a"] == ([("a", "R", "related")], [])
    assert got["~a;b"] == ([("a", "R", None), ("b", "R", None)], ["related_set"])
    assert got["nil"] == ([(None, "<NIL>", None)], [])
    assert got["X:1"] == ([("1", "X", None)], [])


def test_inferred_labels(spark):
    rows = spark.createDataFrame([("CHEBI:1|gene:2",), ("CVCL_9",), ("nothing",)], "_identifier string")
    assert sorted((r.label, r._identifier) for r in c.infer_labels(rows).collect()) == [("cell_line", "CVCL:CVCL_9"), ("chemical", "CHEBI:1,gene:2")]


def test_resplit(spark):
    import pytest

    from lexiscope.plans.frames import Corpus

    docs = spark.createDataFrame([("k", "all", "a"), ("k", "all", "b")], "corpus string, subset string, document_id string")
    corpus = Corpus(docs, docs.selectExpr("*", "0 AS passage_no", "'t' AS text"))
    splits = lambda rows: spark.createDataFrame(rows, "document_id string, subset string")
    assert sorted((r.document_id, r.subset) for r in c.resplit(corpus, splits([("a", "x"), ("b", "y")])).documents.collect()) == [("a", "x"), ("b", "y")]
    for bad in ([("a", "x"), ("a", "y"), ("b", "y")], [("a", "x")], [("a", "x"), ("b", "x"), ("c", "x")]):
        with pytest.raises(ValueError):
            c.resplit(corpus, splits(bad))
    assert c.resplit(corpus, splits([("a", "x"), ("c", "x")]), require_all=False, allow_unknown=True).documents.count() == 1


def test_obo_ids_keep_their_zeros(spark, tmp_path):
    (tmp_path / "z.obo").write_text("[Term]\nid: GO:10\nname: ten\nalt_id: GO:100\nis_a: GO:0 ! root\nis_a: GO:110\nsynonym: \"0 1\" EXACT []\n")
    (row,) = t.read_obo(spark, str(tmp_path / "z.obo")).collect()
    assert (row.ui, row.alt_ids, row.parent_ids, row.synonyms) == ("GO:10", ["GO:100"], ["GO:0", "GO:110"], ["0 1"])


def test_pubtator_is_cut_at_blank_lines(spark, tmp_path):
    """The same records whatever the line ends and blank lines, and many tasks for one large file."""
    block = lambda i: f"{i}|t|Title {i}\n{i}|a|Abstract\n{i}\t0\t5\tTitle\tK\tX:{i}\n"
    whole = "\n".join(block(i) for i in range(4000))
    for name, text in (("plain", whole), ("odd", "\n\n" + whole.replace("\n\n", "\n \t\n\n\n") + "\n\n\n"), ("cr", whole.replace("\n", "\r\n"))):
        (tmp_path / name).write_bytes(text.encode())
        got = c.read_pubtator(spark, str(tmp_path / name), "k")
        assert {r.document_id for r in got.documents.collect()} == set(map(str, range(4000)))
        assert sorted(map(tuple, got.annotations.select("document_id", "mention_id", "passage_no", "text").collect())) == sorted((str(i), f"{i}_2", 0, "Title") for i in range(4000))
        assert got.passages.count() == 8000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        assert c.read_pubtator(spark, str(tmp_path / "plain"), "k").documents.rdd.getNumPartitions() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
