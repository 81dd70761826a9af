import pytest

from chorale.llm import licenses


@pytest.mark.parametrize(("text", "label"), [("MIT No Attribution", "mit-0"), ("see the licence for details", "licensed"), ("licence file", "licensed")])
def test_prefilters_let_every_spelling_through(spark, text, label):
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert any(label in str(v).split(",") for v in row.asDict().values())
