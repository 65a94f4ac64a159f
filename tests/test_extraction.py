"""Rules are tried once, and only where they can match."""

import re

from pyspark.sql import functions as F

from taxloom.operators import extraction as ex
from taxloom.sources.views import view


def test_needed_words_are_in_what_a_pattern_matches():
    for rule in ex.RULES:
        assert all(re.match(r"[a-z0-9]", x) for x in ex.needed(rule.pattern))
    assert ex.needed(r"(?:receipt\s+(?:no|number)|rcpt\s+no)[\s:]*(\d+)") == []
    assert ex.needed(r"(?:abn|australian\s+x)[\s:]*(\d)") == ["abn", "australian"]
    assert ex.needed("abc|def") == ex.needed("(?:abc)?x") == ex.needed("(?i)abc") == []
    assert ex.needed("litres?:") == ["litre"]


def test_each_rule_is_tried_once(spark):
    rows = spark.createDataFrame([(1, "fuel_receipt", "TOTAL: $5.00")], "doc_id int, doc_type string, text string")
    plan = ex.extract(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= len(ex.RULES)


def test_lower_rules_read_where_higher_ones_find_nothing(spark):
    rules = [ex.Rule("x", 9, "one:(.)"), ex.Rule("x", 5, "two:(.)", valid="^[a-c]$"), ex.Rule("x", 5, "(?:two|six):(.)", ("other",))]
    texts = [("other", "ONE:p two:a"), ("other", "one:  two:a"), ("other", "two:z"), ("unknown", "two:z"), ("other", "six:q"), ("other", None)]
    got = [r.v for r in ex.extract(spark.createDataFrame(texts, "doc_type string, text string").coalesce(1), rules).select(F.col("x.value").alias("v")).collect()]
    assert got == ["p", "a", "z", None, "q", None]


def test_receipts_run_in_methods_that_java_compiles(spark):
    view(spark, "/root/testdata/sf0.001", "receipts")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
