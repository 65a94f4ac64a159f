"""Words that one automaton finds in the texts of a batch."""

import random

from pyspark.sql import functions as F

from taxloom.operators import batch_run as br
from taxloom.operators import classification as cl
from taxloom.operators import compliance as co
from taxloom.operators import registry as reg
from taxloom.operators import words as w

SHAPE = "doc_id long, doc_type string, highlights_detected boolean, text string"


def test_masks_tell_what_contains_finds(spark):
    rng = random.Random(5)
    words = list(dict.fromkeys("".join(rng.choice("abé ") for _ in range(rng.randrange(7))) for _ in range(400)))
    texts = [None, "", *("".join(rng.choice("abéc ") for _ in range(n)) for n in (1, 3, 255, 256, 257, 1500) for _ in range(4))]
    rows, held = w.sought(spark.createDataFrame([(t,) for t in texts], "low string"), {"low": words})
    got = rows.select("low", *[F.expr(held["low"].has(x)).alias(f"w{k}") for k, x in enumerate(words)], held["low"].count(words).alias("n"), held["low"].listed(words).alias("listed")).collect()
    assert len(got) == len(texts) and len(words) > 2 * w.BITS
    for r in got:
        own = [r.low is not None and x in r.low for x in words]
        assert [r[f"w{k}"] for k in range(len(words))] == [x if r.low is not None else False for x in own] and r.n == sum(own)


def test_the_surest_business_is_the_same_by_either_way(spark):
    texts = ["", None, "Westpac closing balance, Shell and shell", "corner cafe", "JB HI-FI woolworths woolworths", "kmart target coles supermarket", "seven-eleven 7-eleven ing"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("low", F.lower("text"))
    for r in reg.with_best(rows, "low", "m").withColumn("old", reg.best(F.col("text"))).collect():
        assert r.m == r.old


def test_the_words_of_all_steps_are_looked_for_at_once(spark):
    plan = br.graded(spark.createDataFrame([], SHAPE), 2024)._jdf.queryExecution()
    assert plan.executedPlan().toString().count("ArrowEvalPython [") == 1
    assert "regexp_extract_all" not in plan.optimizedPlan().toString()


def test_a_null_text_is_of_no_type(spark):
    r = cl.classify(spark.createDataFrame([(1, None)], "doc_id int, text string")).first()
    assert (r.predicted, r.score) == ("other", 0.0)


def test_larger_registries_are_looked_for_by_pattern(spark):
    known = tuple(reg.Business(f"b{k}", f"B{k}", "x", "y", (f"shop{k}q",)) for k in range(w.MOST_SOUGHT + 1))
    docs = spark.createDataFrame([("other", "at shop77q", {"supplier_name": ""}), ("other", "none", {"supplier_name": "Shop5q"})], "doc_type string, text string, fields map<string, string>")
    assert [r.seen.name for r in co.assess(docs, 2024, known).select("seen").collect()] == ["B77", "B5"]
