"""Words found in one pass."""

from pyspark.sql import functions as F

from taxloom.operators import classification as cl
from taxloom.operators import registry as reg
from taxloom.operators import words as w


def test_words_are_found_as_contains_finds_them(spark):
    words = ["ing", "bank", "tax", "tax invoice", "invoice", "mcdonald's", "7-eleven", "a.b", "bar", "bars", "oice x", "é", "k"]
    texts = ["", "opening tax invoice x", "taxing mcdonald's bars", "7-elevening axb a.b é", "bank", None, "ba bar", "K tax invoic"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, low string").select("low", F.col("low").isNull().alias("none"), w.among(words, w.present(F.col("low"), words)).alias("got"))
    for r in rows.collect():
        assert r.got == (None if r.none else [x for x in words if x in r.low])


def test_no_words_are_found_where_none_are_asked(spark):
    assert spark.range(1).select(w.present(F.lit("a"), []).alias("x")).first().x == []


def test_evidence_looks_for_words_once(spark):
    rows = spark.createDataFrame([(1, "Hotel check-in, check out; room 12 or suite, 3 nights for guest. Booking, reservation; motel resort check-out")], "doc_id int, text string")
    out = cl.evidence(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert out.first().evidence == ["Keywords: booking, check-in, check-out", "Format patterns: 7", "Australian businesses: ing (0.80)"]


def test_a_keyword_of_two_businesses_counts_for_both(spark):
    known = (reg.Business("a", "A", "x", "y", ("shop", "")), reg.Business("b", "B", "x", "y", ("SHOP", "shopping")))
    got = spark.createDataFrame([("a shop",), ("none",)], "t string").coalesce(1).select(reg.matches(F.col("t"), known).alias("m")).collect()
    assert [[m.name for m in r.m] for r in got] == [["A", "B"], ["A"]]
