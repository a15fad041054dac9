"""A summary's annotations are shuffled once, by document."""

from lexiscope.operators import summaries as sm


def test_figures_take_one_shuffle(spark):
    leaf = "array<struct<identifier:string,resource:string,match_type:string>>"
    rows = [("c", "s", "d", "x", "A", [("1", "r", "exact")]), ("c", "s", "d", "x", "B", [(None, "r", "NIL"), ("1", "r", "exact")]), ("c", "s", "d", None, "A", [])]
    df = spark.createDataFrame(rows, f"corpus string, subset string, document_id string, text string, label string, links {leaf}")
    found = sm._figures(df, {"a": ["A"], "b": ["B"]})
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1
    (row,) = found.collect()
    want = {("annotations", None, "A", 2), ("annotations", None, "B", 1), ("mentions", "all", None, 1), ("mentions", "a", None, 1), ("mentions", "b", None, 1), ("identifiers", "all", None, 2), ("identifiers", "a", None, 1), ("identifiers", "b", None, 2)}
    assert {tuple(x) for x in row.figures} == want and len(row.figures) == len(want)


def test_values_of_a_document_are_grouped_once_for_all_scopes(spark):
    """A value is one row of its document, not one for each of its labels and scopes."""
    leaf = "array<struct<identifier:string,resource:string,match_type:string>>"
    df = spark.createDataFrame([("c", "s", "d", "x", "A", [("1", "r", "exact")])], f"corpus string, subset string, document_id string, text string, label string, links {leaf}")
    plan = sm._figures(df, {"a": ["A"], "b": ["B"]})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2 and plan.count("Generate ") == 1
