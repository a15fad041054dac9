"""Groups of near copies whose rows share an id or have none."""

from lexiscope.llm import simhash_dedup as sd


def test_groups_without_ids_stay(spark):
    texts = ["alpha beta gamma delta", "one two three four five", "red green blue"]
    rows = [(None, t, i) for i, t in enumerate(texts)] + [(5, "north south", 3), (5, "east west up", 4), (5, "east west up", 4), (9, texts[0], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(sd.one_of_each_group(df).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(9, texts[0], 5), (None, texts[1], 1), (None, texts[2], 2), (5, "north south", 3), (5, "east west up", 4)], key=str)
    assert sd.one_of_each_group(df.limit(0)).count() == 0
