from pyspark.sql import functions as F

from taxloom.operators import banking, batch, comparison, evaluation, spatial

TXNS = [("15/06/2024", "BP Fuel Station", -85.5, "fuel", 0.9), ("16/06/2024", "Wilson Parking", -12.0, "parking", 0.8), ("17/06/2024", "Uber Trip", -25.3, "transport", 0.7), ("18/06/2024", "Officeworks Supplies", -156.8, "office_supplies", 1.0), ("19/06/2024", "McDonald's Lunch", -18.5, "meals", 0.6), ("20/06/2024", "Salary Payment", 5000.0, None, None), ("21/06/2024", "Deloitte Consulting", -2500.0, "professional_services", 0.9), ("22/06/2024", "Telstra Phone Bill", -89.9, "communications", 0.7)]
STATEMENT = """ANZ Bank Account Statement
Account: 123-456 789012345
Date        Description                    Amount
15/06/2024  BP Fuel Station Melbourne     -85.50
16/06/2024  Wilson Parking Flinders St    -12.00
17/06/2024  Salary Payment                +5000.00
18/06/2024  Uber Trip to Airport          -25.30
19/06/2024  Officeworks Office Supplies  -156.80
20/06/2024  Client Lunch - Restaurant     -68.90
21/06/2024  Deloitte Consulting Fee       -2500.00
22/06/2024  Telstra Phone Bill            -89.90
23/06/2024  CityLink Toll                 -8.20

Opening Balance: $2,456.78"""


def test_work_expenses(spark):
    rows = [(k, d, t, a) for k, (d, t, a, _, _) in enumerate(TXNS)]
    df = banking.categorized(spark.createDataFrame(rows, "ord int, date string, description string, amount double"))
    got = {r.description: (r.category, round(r.confidence, 9)) for r in df.collect()}
    assert got == {t: (c, s) for _, t, _, c, s in TXNS if c}
    total = next(r for r in banking.expense_summary(df).collect() if r.category is None and r.ato_category is None)
    assert total.n == 7 and total.total_amount == 2888.0 and abs(total.average_confidence - 0.8) < 1e-9


def test_statement(spark):
    rows = banking.statement_lines(spark.createDataFrame([(1, STATEMENT), (2, ""), (3, None)], "id int, text string")).collect()
    assert len(rows) == 9 and round(sum(r.amount for r in rows if r.amount < 0), 2) == -2946.6
    assert sum(r.amount > 0 for r in rows) == 1


def test_field_metrics(spark):
    fields = [("supplier_name", "Woolworths", "woolworths"), ("date", "25/03/2024", "25/03/2024"), ("total_amount", "45.67", "$45.67"), ("gst_amount", "4.15", "$4.15"), ("abn", "88000014675", "88 000 014 675"), ("address", "123 Test St, Sydney NSW", "123 test st, sydney nsw"), ("invoice_number", "INV-12345", "inv-12345")]
    read = spark.createDataFrame([("m", 1, f, a, 0.5) for f, a, _ in fields], "model string, doc_id int, field string, value string, confidence double")
    true = spark.createDataFrame([(1, f, b) for f, _, b in fields], "doc_id int, field string, value string")
    r = evaluation.match_rates(evaluation.paired(read, true)).first()
    assert r.exact_match == 1.0 and abs(r.fuzzy_match - 6 / 7) < 1e-12
    p = evaluation.prf(read, true).first()
    assert (p.precision, p.recall, p.f1) == (1.0, 1.0, 1.0)
    c = evaluation.confidence_correlation(evaluation.paired(read, true), ["model"]).first()
    assert c.correlation == 0.0


def test_model_comparison(spark):
    rows = [("internvl3", 0.85, 0.87, 0.83, 0.9, 2.3, 100, 230.0, 0.1), ("llama32_vision", 0.82, 0.84, 0.8, 0.88, 1.8, 100, 180.0, 0.1)]
    df = spark.createDataFrame(rows, "model string, average_f1 double, average_precision double, average_recall double, production_ready_rate double, average_processing_time double, total_documents int, total_processing_time double, awk_fallback_rate double")
    got = {r.model: r for r in comparison.rankings(df).collect()}
    assert round(got["internvl3"].overall_score, 9) == 1.9 and round(got["llama32_vision"].overall_score, 9) == 1.1
    assert got["internvl3"].overall_rank == 1 and got["internvl3"].rank_processing_speed == 2
    p = comparison.parity(df).first()
    assert p.status == "fair" and round(p.f1_std, 7) == 0.0212132 and round(p.time_cv, 6) == 0.172465
    d = comparison.pairwise(df).first()
    assert not d.significant_performance and not d.significant_speed
    assert comparison.deployment(comparison.rankings(df)).filter("overall_rank = 1").first().status == "ready"


def test_efficiency_and_grades(spark):
    base, ratio, level = batch.efficiency(F.lit(2.5), F.lit(1.2))
    assert tuple(spark.range(1).select(base, ratio, level).first()) == (5.0, 2.0, "excellent")
    got = [r[0] for r in spark.createDataFrame([(0.9,), (0.7,), (0.5,), (0.3,), (0.1,)], "s double").select(batch.grade(F.col("s"))).collect()]
    assert got == ["excellent", "good", "fair", "poor", "very_poor"]


def greedy(boxes):
    left = sorted(boxes, key=lambda b: (-b["width"] * b["height"], b["ord"]))
    out, used = [], set()
    for i, s in enumerate(left):
        if i in used:
            continue
        group = [s]
        used.add(i)
        for j in range(i + 1, len(left)):
            o = left[j]
            near = ((s["x"] + s["width"] // 2) - (o["x"] + o["width"] // 2)) ** 2 + ((s["y"] + s["height"] // 2) - (o["y"] + o["height"] // 2)) ** 2 < 100
            over = not (s["x"] + s["width"] < o["x"] or o["x"] + o["width"] < s["x"] or s["y"] + s["height"] < o["y"] or o["y"] + o["height"] < s["y"])
            if j not in used and (near or over):
                group.append(o)
                used.add(j)
        out.append((len(group), min(g["x"] for g in group), min(g["y"] for g in group), sum(g["width"] * g["height"] for g in group)))
    return sorted(out)


def test_merge_against_a_plain_loop(spark):
    import random

    rng = random.Random(2)
    boxes = [{"image_id": i, "ord": k, "x": rng.randrange(300), "y": rng.randrange(300), "width": rng.randrange(5, 90), "height": rng.randrange(5, 60), "confidence": 0.5, "color": rng.choice(["blue", "pink"])} for i in range(20) for k in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(boxes, "image_id int, ord int, x int, y int, width int, height int, confidence double, color string")
    rows = spatial.merged(df).collect()
    for i in range(20):
        assert sorted((r.members, r.x, r.y, r.area) for r in rows if r.image_id == i) == greedy([b for b in boxes if b["image_id"] == i])


def test_the_best_model_of_a_tie_is_the_first_name_whatever_the_last_bits(spark):
    rows = [("b", 0.1 + 0.2), ("a", 0.3), ("c", 0.2999999)]
    got = comparison.best_by_f1(spark.createDataFrame(rows, "model string, average_f1 double")).collect()
    assert [(r.model, r.average_f1) for r in got] == [("a", 0.3)]
