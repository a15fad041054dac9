import pytest
from lexiscope.operators import records as r
from lexiscope.sources import payloads

STORE = "record_id long, identifiers map<string,array<string>>, title string, tags array<string>"
NEW = "identifiers map<string,array<string>>, title string, tags array<string>"
FIELDS = {"title": "strict_case_insensitive", "tags": "set_union"}


def test_upsert(spark):
    store = spark.createDataFrame([(1, {"PMID": ["5"]}, "A", ["x"]), (2, {"DOI": ["d"]}, "B", None)], STORE)
    rows = spark.createDataFrame([({"PMID": ["5"], "DOI": ["e"]}, "a", ["y", "x"]), ({"PMID": ["9"]}, "C", ["z"])], NEW)
    out = {x.record_id: x for x in r.upsert(store, rows, FIELDS).collect()}
    assert out[1].identifiers == {"DOI": ["e"], "PMID": ["5"]} and out[1].title == "A" and out[1].tags == ["x", "y"]
    assert out[2].title == "B" and out[3].title == "C" and len(out) == 3
    clash = spark.createDataFrame([({"PMID": ["5"], "DOI": ["d"]}, None, None)], NEW)
    with pytest.raises(r.ConflictError):
        r.upsert(store, clash, FIELDS)
    with pytest.raises(Exception, match="title"):
        r.upsert(store, spark.createDataFrame([({"PMID": ["5"]}, "other", None)], NEW), FIELDS).collect()
    assert r.get(store, "DOI", "d").first().record_id == 2
    assert r.problems(store.unionByName(store.limit(1))).first().problem == "duplicate record id"


def test_store_file(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"format_version": 1, "next_record_id": 2, "records": [{"record_id": 1, "identifiers": {"PMID": ["5"]}, "data": {"title": "A"}}]}')
    assert r.read_store(spark, str(tmp_path / "s.json"), "title:string").first().title == "A"
    (tmp_path / "t.json").write_text('{"format_version": 7, "records": []}')
    with pytest.raises(Exception, match="format version"):
        r.read_store(spark, str(tmp_path / "t.json"), "title:string").collect()


def test_pubmed(spark, tmp_path):
    (tmp_path / "p.xml").write_text(
        '<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article><Journal><ISSN IssnType="Print">1111-2222</ISSN><JournalIssue><PubDate><MedlineDate>1999 Jan-Feb</MedlineDate></PubDate></JournalIssue>'
        "<Title>Long</Title></Journal></Article><MedlineJournalInfo><MedlineTA>Short</MedlineTA><NlmUniqueID>10</NlmUniqueID><ISSNLinking>3333-4444</ISSNLinking></MedlineJournalInfo>"
        '<MeshHeadingList><MeshHeading><DescriptorName UI="D1">Mice</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>'
        '<PubmedData><ArticleIdList><ArticleId IdType="pubmed">77</ArticleId><ArticleId IdType="pmc">PMC8</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>'
    )
    row = payloads.read_pubmed(spark, str(tmp_path / "p.xml")).first()
    assert row.identifiers == {"pmid": ["77"], "pmcid": ["PMC8"]} and row.pub_year == "1999" and row.journal == "Short"
    assert row.journal_identifiers == {"nlm": ["10"], "issn": ["1111-2222", "3333-4444"]} and row.mesh_topics == ["Mice"]


def test_crossref(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"message": {"items": [{"DOI": "10.1/X", "container-title": ["J"], "ISSN": ["1"], "issued": {"date-parts": [[2001, 2]]}}]}}')
    row = payloads.read_crossref(spark, str(tmp_path / "c.json")).first()
    assert row.identifiers == {"doi": ["10.1/x"]} and row.pub_year == "2001" and row.journal == "J"


def test_equal_rows_are_one_and_others_conflict(spark):
    import pytest
    from lexiscope.operators.records import ConflictError, upsert

    kind = "identifiers map<string,array<string>>, name string"
    store = spark.createDataFrame([(1, {"PMID": ["1"]}, "one")], f"record_id long, {kind}")
    update, new = ({"PMID": ["1"]}, "uno"), ({"PMID": ["9"]}, "nine")
    out = upsert(store, spark.createDataFrame([update, update, new, new], kind), {"name": "replace"})
    assert sorted((r.record_id, r.name) for r in out.collect()) == [(1, "uno"), (2, "nine")]
    with pytest.raises(ConflictError):
        upsert(store, spark.createDataFrame([new, ({"PMID": ["9"]}, "other")], kind), {"name": "replace"})
