"""Student's t as column expressions: tails by the incomplete beta function, quantiles by bisection, Welch's test from moments."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' coefficients for g = 7, good to about fifteen digits.
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
#: Steps of the continued fraction and of the bisection at most.
STEPS, HALVINGS = 400, 90
_TINY = 1e-300


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of a half or more."""
    y = x - 1.0
    terms = sum((F.lit(c) / (y + float(k)) for k, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(terms)


def _apart_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method; it stands still once a step changes nothing."""
    first = 1.0 / _apart_from_zero(1.0 - (a + b) * x / (a + 1.0))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"), F.lit(False).alias("done"))

    def half(s: Column, step: Column) -> Column:
        """One half of a step: a struct of c, d, h and the factor on h."""
        d = 1.0 / _apart_from_zero(1.0 + step * s["d"])
        c = _apart_from_zero(1.0 + step / s["c"])
        return let(F.struct(c.alias("c"), d.alias("d")), lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), (s["h"] * n["c"] * n["d"]).alias("h"), (n["c"] * n["d"]).alias("by")))

    def step(s: Column, k: Column) -> Column:
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        after = let(half(s, even), lambda e: half(e, odd))
        moved = let(after, lambda n: F.struct(n["c"].alias("c"), n["d"].alias("d"), n["h"].alias("h"), (F.abs(n["by"] - 1.0) < 3e-16).alias("done")))
        return F.when(s["done"], s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), a and b a half or more, x from 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x))
    near = let(F.struct(a.alias("a"), b.alias("b"), x.alias("x"), front.alias("f")), lambda v: F.when(v["x"] < (v["a"] + 1.0) / (v["a"] + v["b"] + 2.0), v["f"] * _fraction(v["a"], v["b"], v["x"]) / v["a"]).otherwise(1.0 - v["f"] * _fraction(v["b"], v["a"], 1.0 - v["x"]) / v["b"]))
    return F.when(x <= 0.0, F.lit(0.0)).when(x >= 1.0, F.lit(1.0)).otherwise(near)


def two_sided(t: Column, df: Column) -> Column:
    """The probability that Student's t with df degrees of freedom lies as far from 0 as t, on either side."""
    return incomplete_beta(df / 2.0, F.lit(0.5), df / (df + t * t))


def quantile(tail: float, df: Column) -> Column:
    """The t that is exceeded on either side with probability `tail` in all; df of 1 or more."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(float(1 << 20)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2.0
        return let(middle, lambda m: F.when(two_sided(m, df) > tail, F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2.0)


def welch(n1: Column, mean1: Column, var1: Column, n2: Column, mean2: Column, var2: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom from two samples' counts, means and variances; null where a sample has fewer than two or nothing varies."""
    a, b = var1 / n1, var2 / n2
    told = (n1 > 1) & (n2 > 1) & (a + b > 0)
    return F.when(told, (mean1 - mean2) / F.sqrt(a + b)), F.when(told, (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)))
