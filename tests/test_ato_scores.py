"""Tax office scores: each side is one row for each document before they meet."""

from taxloom.operators import evaluation as ev


def test_truth_is_not_copied_for_each_model(spark):
    read = spark.createDataFrame([("a", 1, "date", "01/02/2024"), ("b", 1, "date", "x"), ("b", 2, "shop", "y"), (None, 1, "date", "01/02/2024"), ("a", 3, "date", "01/02/2024")], "model string, doc_id int, field string, value string")
    true = spark.createDataFrame([(1, "date", "01/02/2024"), (2, "shop", "y"), (4, "date", "01/02/2024")], "doc_id int, field string, value string")
    out = ev.ato_scores(read, true)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(map(tuple, out.collect())) == [("a", 1, 1, 1.0), ("b", 1, 1, 0.0), ("b", 2, 0, 0.0)]
