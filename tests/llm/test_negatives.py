import math
import random

import numpy as np
import pytest

from taxloom.llm import negatives as n


def brute(rows, every=50, k=5, m=3):
    """Anchors, positives and negatives by all pairs, with Python's integers."""
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (label, [float(x) * 256 for x in v])
        best[i] = min(best.get(i, row), row)
    own = {i: ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(x) for x in v]) for i, (label, v) in best.items()}
    out = []
    for a in own:
        if a % every:
            continue
        score = {b: sum(x * y for x, y in zip(own[a][1], own[b][1], strict=False)) for b in own if b != a}
        order = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in order if own[b][0] == own[a][0]][:k]:
            fit = [b for b in order if own[b][0] != own[a][0] and 50 * score[p] <= 100 * score[b] <= 95 * score[p]][:m]
            out += [(a, p, r + 1, b, score[p], score[b]) for r, b in enumerate(fit)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.5) for r in rows], "vec_id long, embedding array<float>, label int, part string, score double").repartition(3)


def vectors(rng, n_rows, wide=8, centres=5):
    middle = [[rng.gauss(0, 1) for _ in range(wide)] for _ in range(centres)]
    return [(i, [float(np.float32(0.5 * x + rng.gauss(0, 0.3))) for x in rng.choice(middle)], rng.randrange(4)) for i in range(n_rows)]


@pytest.mark.parametrize("group,block,pivots", [(2048, 16_384, 8), (2, 40, 16), (3, 1000, 1)])
def test_equal_to_all_pairs(spark, group, block, pivots):
    rows = vectors(random.Random(4), 600)
    got = sorted(map(tuple, n.hard_negatives(frame(spark, rows), every=10, group=group, block=block, pivots=pivots).collect()))
    assert got and got == brute(rows, every=10)


def test_a_third_of_all_rows_is_one_vector_of_one_label(spark):
    rng = random.Random(8)
    rows = vectors(rng, 200) + [(1000 + i, [0.5] * 8, 1) for i in range(100)] + [(2000 + i, [0.45] * 8, 2) for i in range(30)]
    got = sorted(map(tuple, n.hard_negatives(frame(spark, rows), every=25, group=2, block=50, pivots=8).collect()))
    assert got and got == brute(rows, every=25)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = vectors(rng, 120)
    rows += [rows[50], rows[50], (50, rows[3][1], 3), (100, rows[4][1], 0)]  # repeated ids, also with other vectors
    rows += [(200, None, 1), (250, [0.1] * 8, None), (300, [0.1] * 7 + [None], 1), (350, [float("nan")] * 8, 1), (400, [float("inf")] * 8, 1), (None, [0.1] * 8, 1)]
    rows += [(450, [], 2), (500, [0.9, 0.4], 2), (550, [0.5] * 12, 1), (-50, [0.4] * 8, 1), (600, [0.0] * 8, 9), (651, rows[7][1], 1)]
    got = sorted(map(tuple, n.hard_negatives(frame(spark, rows), pivots=8).collect()))
    assert got and got == brute(rows)
    assert n.hard_negatives(frame(spark, rows).filter("false")).count() == 0
    assert n.hard_negatives(frame(spark, rows).filter("vec_id = 50")).count() == 0


def test_huge_components_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1, 2, 3]) * 2.0**20 for _ in range(4)], i % 2) for i in range(60)]
    got = sorted(map(tuple, n.hard_negatives(frame(spark, rows), every=20, pivots=4).collect()))
    assert got and got == brute(rows, every=20)
    assert n.products(np.array([[1e30]]), np.array([[1e30], [-1e30]])).tolist() == [[n._LONG, -n._LONG]]


def test_rows_are_copied_only_where_they_may_serve(spark):
    """Two far clusters: what the bounds keep apart is not copied, and nothing is lost."""
    rng = random.Random(5)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.01) + (3 if (i % 2 == k) else 0))) for k in range(2)], 1) for i in range(400)]
    from taxloom.llm.shared import Scratch

    with Scratch(spark) as scratch:
        own = scratch.cut(n.prepared(frame(spark, rows), "vec_id", "embedding", "label"))
        space = n.space_of(own, 8)
        cells = scratch.cut(n._celled(own.select("vec_id", "label", "vec"), space, False))
        anchors = scratch.cut(n._celled(own.filter("vec_id % 10 < 2"), space, True)).withColumn("part", n.F.col("label"))
        far = n._kth(anchors, cells.withColumn("part", n.F.col("label")), space, 6)
        left = anchors.join(far, ["part", "cell"]).withColumn("near", n.F.lit(0.0)).select("part", "cell", "away", "near", "far", "vec_id", "vec")
        _, met = n._met(left, cells.withColumn("part", n.F.col("label")).select("part", "vec_id", "label", "vec"), space, 8, 1000, scratch)
        groups = n._groups(left, 8).agg(n.F.max(n.F.col("first") + n.F.col("span"))).first()[0]
        assert groups > 4 and 0 < met.count() < 0.75 * 400 * groups
