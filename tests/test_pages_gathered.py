"""Pages are dealt out once, before their words are made."""

import __spark_entry__ as entry


def test_words_of_pages_are_not_moved(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # tables meet by sorting, only the few kinds of words are sent to all
    try:
        df = entry.queries()["e10_statement_pages"](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and all("hashpartitioning(l_orderkey" in x for x in moved)
