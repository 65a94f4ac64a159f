"""Transactions against highlights: one by one in short statements, by keys in long ones, both as pair by pair."""

from taxloom.operators import texts as tx

WORDS = ["uber trip home", "Uber  trip", "bank", "hotel bill sydney", "bill hotel", None, ""]
AMOUNTS = ["12", "345", "-12", "", None, "7", "1234"]


def test_short_and_long_statements_alike(spark):
    txns = [(s, k, WORDS[(k + (s or 0)) % 7], AMOUNTS[(k * 3 + (s or 0)) % 7], k % 9 / 10) for s in (1, 2, 3, None) for k in range(6 + (s or 0) * 4)]
    marks = [(s, k, WORDS[(k * 2 + s) % 7], ["1234512", "77", "9-12", "", None][(k + s) % 5], "yg"[k % 2]) for s in (1, 2, 4) for k in range(s, 3 + s * 2)]

    def matches(t, m):
        both = set((t[2] or "").lower().split()) & set((m[2] or "").lower().split())
        return t[0] is not None and t[0] == m[0] and (len(both) >= 2 or (t[3] is not None and m[3] is not None and t[3] in m[3]))

    want = []
    for t in txns:
        m = min((m for m in marks if matches(t, m)), key=lambda m: m[1], default=None)
        want.append((str(t[0]), t[1], round(min(t[4] + 0.3, 1.0) if m else t[4], 6), m is not None, m and m[4]))
    left = spark.createDataFrame(txns, "s int, ord int, description string, amount string, work_score double")
    right = spark.createDataFrame(marks, "s int, ord int, description string, amount string, color string")
    assert 0 < sum(w[3] for w in want) < len(want)
    for few, most in ((64, 4096), (0, 0), (5, 4096), (64, 11)):
        rows = tx.enhanced(left, right, "s", few, most).collect()
        got = [(str(r.s), r.ord, round(r.work_score, 6), r.highlighted, r.highlight_color) for r in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
