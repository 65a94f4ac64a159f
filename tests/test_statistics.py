"""Student's t against closed forms and quantiles, Welch's test against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from taxloom.functions import statistics as st
from taxloom.operators import comparison

#: Two-sided 5 % and 1 % quantiles of Student's t.
QUANTILES = {(1, 0.05): 12.706204736174698, (2, 0.05): 4.302652729911275, (5, 0.05): 2.5705818366147395, (10, 0.05): 2.2281388519649385, (30, 0.05): 2.0422724563012373, (100, 0.05): 1.9839715184496334, (1, 0.01): 63.65674116287399}


def tail(t, n):
    """Two-sided tail for whole degrees of freedom: a finite sum of powers of the cosine."""
    theta = math.atan(abs(t) / math.sqrt(n))
    c, s = math.cos(theta), math.sin(theta)
    if n == 1:
        return 1 - 2 * theta / math.pi
    term, total = (c, c) if n % 2 else (1.0, 1.0)
    for k in range(3 if n % 2 else 2, n - 1, 2):
        term *= (k - 1) / k * c * c
        total += term
    return 1 - (2 / math.pi * (theta + s * total) if n % 2 else s * total)


def test_tails_against_closed_forms(spark):
    rows = [(t, float(n)) for n in (1, 2, 3, 4, 7, 10, 29, 30, 101, 500, 2001) for t in (0.0, 0.01, 0.5, 1.0, 1.96, 2.5, -3.3, 6.0)]
    got = spark.createDataFrame(rows, "t double, df double").select("t", "df", st.two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        assert abs(r.p - tail(r.t, int(r.df))) < 1e-11, r


def test_quantiles(spark):
    for alpha in (0.05, 0.01):
        rows = [(float(n),) for n, a in QUANTILES if a == alpha]
        for r in spark.createDataFrame(rows, "df double").select("df", st.quantile(alpha, F.col("df")).alias("t")).collect():
            assert abs(r.t - QUANTILES[int(r.df), alpha]) < 1e-9 * max(1, r.t) and abs(tail(r.t, int(r.df)) - alpha) < 1e-12, r


def test_many_degrees_of_freedom_approach_the_normal_law(spark):
    rows = [(t, 10.0**k) for t in (0.3, 1.0, 1.96, 4.0) for k in (5, 6, 7)]
    for r in spark.createDataFrame(rows, "t double, df double").select("t", "df", st.two_sided(F.col("t"), F.col("df")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.t / math.sqrt(2)), abs=0.4 / r.df + 1e-8)


def test_welch_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(m, rng.gauss(mu, sd), None if k % 5 == 0 else rng.random()) for m, mu, sd, n in (("a", 1.0, 0.5, 12), ("b", 1.6, 1.5, 30), ("c", 1.1, 0.4, 25)) for k in range(n)] + [("d", 1.0, None)]
    got = {(r.metric, r.model1, r.model2): r for r in comparison.significance(spark.createDataFrame(rows, "model string, x double, y double"), ["x", "y"]).collect()}
    assert set(got) == {(m, a, b) for m in "xy" for a, b in ("ab", "ac", "ad", "bc", "bd", "cd")}
    for (metric, a, b), r in got.items():
        u, v = ([row["xy".index(metric) + 1] for row in rows if row[0] == m and row["xy".index(metric) + 1] is not None] for m in (a, b))
        assert (r.n1, r.n2) == (len(u), len(v))
        if min(len(u), len(v)) < 2:
            assert r.t is None and r.p_value is None and not r.significant
            continue
        mean, var = lambda z: sum(z) / len(z), lambda z: sum((x - sum(z) / len(z)) ** 2 for x in z) / (len(z) - 1)
        s, w = var(u) / len(u), var(v) / len(v)
        assert r.t == pytest.approx((mean(u) - mean(v)) / math.sqrt(s + w), abs=1e-9)
        assert r.df == pytest.approx((s + w) ** 2 / (s * s / (len(u) - 1) + w * w / (len(v) - 1)), abs=1e-8)
        lo, hi = sorted((tail(r.t, math.floor(r.df)), tail(r.t, math.ceil(r.df))))
        assert lo - 1e-12 <= r.p_value <= hi + 1e-12 and r.significant == (r.p_value < 0.05)
        assert (r.low <= 0 <= r.high) == (not r.significant) and r.low < r.difference < r.high


def test_fairness(spark):
    rows = [("ok", True, True, True), ("half", True, None, False)]
    got = {r.name: (round(r.score, 6), r.bias_risk, len(r.issues)) for r in comparison.fairness(spark.createDataFrame(rows, "name string, identical_pipeline boolean, standardized_prompts boolean, same_confidence_thresholds boolean")).collect()}
    assert got == {"ok": (1.0, "low", 0), "half": (0.333333, "medium", 2)}
