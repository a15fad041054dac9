"""Line dedup of rows that share an id or have none."""

import pytest
from lexiscope.llm import line_dedup as ld


@pytest.mark.parametrize("ident", [None, 4])
def test_lines_of_rows_that_share_an_id(spark, ident):
    rows = [(1, "shared opening line of these texts"), (ident, "alpha one\nshared opening line of these texts"), (ident, "quite other things\nnobody else wrote this here"), (ident, "more words again\nbirds fly south in autumn"), (ident, "solo\nbirds fly south in autumn")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.text for r in ld.dedup_lines(df).collect()]
    assert any("nobody else wrote this here" in t for t in out)
    assert "alpha one" in "\n".join(out) and "solo" in "\n".join(out)
    assert sum("birds fly south" in t for t in out) == 1
    assert sum("shared opening" in t for t in out) == 1
