"""Articles are read once for their topics: counted by journal, number and topic, not placed one by one."""

from lexiscope.operators import metadata as md
from lexiscope.plans.targets import target_frame

SCHEMA = "corpus string, subset string, document_id string, journal_id string, mesh_topics array<string>"
ROWS = [("c", "a", "1", "J", ["T", "U"]), ("c", "a", "2", "J", ["U", "T"]), ("c", "b", "3", None, ["T"]), ("c", "b", "4", "J", []), ("c", "b", "5", "K", None), ("c", "b", "6", "K", ["no", None])]


def test_topics_of_articles_are_counted(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    articles = spark.createDataFrame(ROWS, SCHEMA).coalesce(1).mapInArrow(seen, SCHEMA)
    listed = md.article_terms(articles)
    assert {tuple(r) for r in listed.collect()} == {
        ("c", "a", "J", 2, "T", 2), ("c", "a", "J", 2, "U", 2), ("c", "b", None, 1, "T", 1), ("c", "b", "J", 1, None, 1), ("c", "b", "K", 1, None, 1), ("c", "b", "K", 2, "no", 1), ("c", "b", "K", 2, None, 1),
    }
    weights = spark.createDataFrame([("T", "x", 1.0), ("T", "y", 3.0), ("U", "x", 2.0)], "term string, key string, w double")
    profile = spark.createDataFrame([("J", "z", 1.0, "journal_mesh")], "journal_id string, key string, w double, source string")
    rows = md.article_topic_distribution(listed, target_frame(spark, {"a": [("c", "a")], "all": [("c", None)]}), weights, profile).collect()
    assert {(r.target, r.key): (r["count"], r.proportion) for r in rows} == {
        ("a", "x"): (1.25, 0.625), ("a", "y"): (0.75, 0.375),
        ("all", "x"): (1.5, 0.25), ("all", "y"): (1.5, 0.25), ("all", "z"): (1.0, round(1 / 6, 8)), ("all", "Unknown"): (2.0, round(2 / 6, 8)),
    }
    assert read.value == len(ROWS)
