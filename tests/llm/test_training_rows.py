from pyspark.sql import functions as F

from sensorium.llm import toxicity

from .test_contracts import case


def test_one_row_of_a_labelled_id(spark):
    docs = [(1, f"text {k}") for k in range(50)] + [(2, "b"), (3, "c"), (4, None)]
    marks = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(case(spark, docs), marks, F.lit(True), "doc_id", "text", 3).collect()
    assert sorted(r.y for r in rows) == [0, 0, 1]
    assert [r.text.decode() for r in rows if r.y] in [[t] for d, t in docs if d == 1]
    again = toxicity.training_rows(case(spark, docs[::-1]), marks, F.lit(True), "doc_id", "text", 3).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
