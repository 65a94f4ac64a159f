"""Benchmark scores: each side moves once, and each field yields what joins field by field would."""

from pyspark.sql import functions as F

from taxloom.operators import evaluation as ev

READ = [
    ("a", 1, "supplier_name", " ACME "), ("a", 1, "date", "01-02-2024"), ("a", 1, "total_amount", "$1,000.004"),
    ("b", 1, "supplier_name", ""), ("b", 1, "total_amount", "12x"), ("b", 1, "total_amount", "12X"), ("b", 1, "total_amount", None),
    ("a", 2, "invoice_number", "7"), ("a", 2, "address", "here"),
    ("a", 3, None, "x"), (None, 1, "date", "01/02/2024"), ("a", 9, "date", "1"), ("a", None, "date", "1"),
    ("b", 4, "date", "1"), ("b", 4, "date", "2"),
]
TRUE = [
    (1, "supplier_name", "acme"), (1, "date", "01/02/2024"), (1, "total_amount", "1000"), (1, "total_amount", "12x "),
    (2, "supplier_name", ""), (2, "date", None), (2, "date", "1"), (2, "abn", "5"),
    (3, "abn", "1"), (4, "date", "2"), (4, "date", "2"), (4, None, "2"), (7, "date", "1"), (None, "date", "1"),
]


def _alike(name, a, b):
    a, b = ((v.strip().lower() if v else None) for v in (a, b))
    if a is None or b is None:
        return a is b
    if name == "date":
        return a.replace("/", "").replace("-", "") == b.replace("/", "").replace("-", "")
    if name == "total":
        try:
            return abs(float(a.replace("$", "").replace(",", "")) - float(b.replace("$", "").replace(",", ""))) < 0.01
        except ValueError:
            pass
    return a == b


def _frames(spark):
    return spark.createDataFrame(READ, "model string, doc_id int, field string, value string"), spark.createDataFrame(TRUE, "doc_id int, field string, value string")


def test_scores_are_those_of_joins_by_field(spark):
    want = []
    for model, doc in {(m, d) for m, d, _, _ in READ if d in {t[0] for t in TRUE if t[0]}}:
        for name, field in ev.SROIE.items():
            read = [v for m, d, f, v in READ if m is not None and (m, d, f) == (model, doc, field)] or [None]
            true = [v for d, f, v in TRUE if (d, f) == (doc, field)] or [None]
            want += [(str(model), doc, name, float(_alike(name, a, b))) for a in read for b in true]
    got = [(str(r.model), r.doc_id, r.name, r.f1) for r in ev.sroie_scores(*_frames(spark)).collect()]
    assert sorted(got) == sorted(want)


def test_leaderboard_reads_scores_once(spark):
    scores = ev.sroie_scores(*_frames(spark))
    out = ev.sroie_leaderboard(scores)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    rows = {(r.name, r.model): r for r in out.collect()}
    for name in ("overall", *ev.SROIE):
        own = scores if name == "overall" else scores.filter(F.col("name") == name)
        means = sorted((-r.f1, str(r.model), r.model) for r in own.groupBy("model").agg(F.avg("f1").alias("f1")).collect())
        assert [(rows[name, m].place, rows[name, m].f1) for _, _, m in means if m] == [(k, -f) for k, f, m in sorted((rows[name, m].place, f, m) for f, _, m in means if m)]
