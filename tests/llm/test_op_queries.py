"""The registered op queries on the smallest tables: columns, one row per row of the table, contract facts."""

import hashlib
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
CONTRACT = {
    "op1_mixing": ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    "op2_simhash_dedup": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op4_html_text": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op5_token_counts": ("documents", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
    "op6_embedding_dedup": ("embeddings", ["vec_id", "n_links", "component_id", "kept"]),
    "op9_quality": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op10_sentencepiece": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op13_byte_bpe": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
}


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, name):
    from lexiscope.llm.queries import QUERIES

    table, columns = CONTRACT[name]
    frame = QUERIES[name](spark, SF)
    assert frame.columns == columns
    rows = frame.collect()
    whole = spark.read.parquet(f"{SF}/{table}.parquet").collect()
    key = columns[0]
    assert sorted(r[key] for r in rows) == sorted(r[key] for r in whole)
    if name == "op10_sentencepiece":
        text = {r.doc_id: r.text for r in whole}
        assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in rows if "▁" not in text[r.doc_id])
    if name == "op13_byte_bpe":
        text = {r.doc_id: r.text for r in whole}
        assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in rows)
    if name == "op1_mixing":
        assert sum(r.taken for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.02)


def test_searches_and_scans(spark):
    import duckdb
    from lexiscope.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    want = sorted(con.sql(f"SELECT query_id, rank, vec_id, distance FROM ({ORACLES['op8_hamming_search']})").fetchall())
    assert sorted(tuple(r) for r in QUERIES["op8_hamming_search"](spark, SF).collect()) == want
    lines = QUERIES["op3_line_dedup"](spark, SF)
    assert lines.columns == ["doc_id", "line_no", "line_group", "copies", "kept"]
    assert lines.filter("kept").count() == lines.select("line_group").distinct().count()
    scan = QUERIES["op7_secret_scan"](spark, SF)
    assert scan.columns == ["doc_id", "finding_no", "length", "candidate_sha256", "score", "is_secret"] and scan.count() > 0
