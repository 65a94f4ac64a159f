"""Work expenses of statements: a text is read once for a row."""

import datetime

from taxloom.operators import handlers as h
from taxloom.plans import handler_queries as hq


def test_lines_of_a_statement_are_read_once(spark, tmp_path):
    rows = [(k, k, 100.0 + k, datetime.datetime(2024, 1, 1 + k)) for k in range(12)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    out = hq.work_expenses(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # One pattern to find the lines, one for each of their three parts.
    assert plan.count("{5,50}") == 4
    assert plan.count(r"citylink") == 1
    got = out.collect()
    assert {r.doc_id for r in got} <= {0, 4, 8} and [r.nth for r in got if r.doc_id == 0] == [0, 1]


def test_statements_without_expenses(spark):
    texts = [("01/03/2024 Hotel Sydney -$20.00\n02/03/2024 Nothing much -5.00\n03/03/2024 Uber ride 7.00",), ("none",), (None,)]
    rows = h.read(spark.createDataFrame(texts, "text string"), "bank_statement").select("transactions", "work_expenses").collect()
    assert [tuple(e) for e in rows[0].work_expenses] == [("01/03/2024", "Hotel Sydney", -20.0, 1.5, "accommodation", 0.75)]
    assert len(rows[0].transactions) == 3
    assert [tuple(r) for r in rows[1:]] == [(None, None), (None, None)]
