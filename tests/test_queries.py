"""Registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
SOME = [
    "m03_sentence_count", "m12_annotations_per_1000_tokens_stats", "m14_unique_identifiers_per_document_stats", "m24_sentence_redundancy_stats", "m29_variation_degree_stats", "m37_identifier_resource_distribution",
    "b01_metadata_battery", "b02_terminology_battery", "m42_article_mesh_topic_distribution", "m44_token_overlap", "m48_high_level_concept_counts_by_topic", "m49_concept_depth_counts", "t06_anchor_weights_by_tree", "a05_article_topic_audit", "d02_corpus_summary", "d10_topic_heat_map",
]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_entry_has_unique_results(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=str)
    want = sorted((tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()), key=str)
    assert got == want
