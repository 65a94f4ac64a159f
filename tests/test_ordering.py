"""Places by ranges against sorting, first failures by their plan, and answers cleaned up against plain Python."""

import random
import re

from pyspark.sql import functions as F

from taxloom.operators import batch, ordering, texts


def test_places_equal_sorting(spark):
    rng = random.Random(4)
    rows = [(rng.choice("aaab") if rng.random() < 0.95 else None, rng.choice([rng.randrange(50), rng.randrange(10_000), None]), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "model string, position long, id long").repartition(5)
    want, seen = {}, {}
    for m, p, k in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        seen[m] = seen.get(m, 0) + 1
        want[k] = seen[m]
    for pieces in (2, 64):
        assert {r.id: r.place for r in ordering.places(df, "model", "position", pieces=pieces, tie="id").collect()} == want
    assert ordering.places(df.filter("false"), "model", "position").count() == 0


def test_first_failures_are_limited_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("concat('m', id % 3) as model", "id as position", "false as success", "'E: x' as error")
    plan = batch.first_failures(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and batch.first_failures(df).count() == 15


def plainly_cleaned(text):
    t = re.sub(r"\b(\w+)(?:\s+\1){2,}", r"\1", text, flags=re.I | re.A)
    t = re.sub(r"\b((?:\w+\s+){1,3})(?:\1){2,}", r"\1", t, flags=re.I | re.A)
    t = re.sub(r"\b(\w{1,5})\s+(?:\1\s+){4,}", "", t, flags=re.I | re.A)
    for p in (r"Thank you.*$", r"Visit.*costco\.au.*$", r"Member #\d+.*$", r"\d{2}/\d{2}/\d{4}.*Thank.*$"):
        if re.search(p, t, re.I | re.S | re.A):
            t = re.sub(p, "", t, count=0, flags=re.I | re.S | re.A).strip(" ")
            break
    t = re.sub(r"\s+", " ", t, flags=re.A)
    return (t[:1000] + "..." if len(t) > 1000 else t).strip(" ")


def test_answers_are_cleaned_as_by_plain_python(spark):
    rng = random.Random(6)
    words = ["total", "Total", "ab", "cd", "x", "12/03/2024", "Thank", "you", "Visit", "costco.au", "Member #77", "$5.00", "\n", "größer", "the bill"]
    rows = []
    for k in range(600):
        parts = []
        while len(parts) < rng.randrange(1, 60):
            parts += [rng.choice(words)] * rng.choice([1, 1, 1, 2, 3, 6])
        rows.append((k, rng.choice(["", " "]) + " ".join(parts)))
    rows.append((600, "word " * 10 + "other thing " * 400))
    got = {r.id: r.c for r in spark.createDataFrame(rows, "id long, text string").select("id", texts.cleanup(F.col("text")).alias("c")).collect()}
    for k, t in rows:
        assert got[k] == plainly_cleaned(t), t
