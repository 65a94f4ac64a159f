from pyspark.sql import functions as F

from taxloom.operators import classification, compliance, confidence, extraction, registry, texts

RECEIPT = "STORE: woolworths metro\nDATE: 25/03/2024\nABN: 88 000 014 675\nSUBTOTAL: $41.52\nGST: $4.15\nTOTAL: $45.67"


def one(spark, text, *columns, **more):
    df = spark.createDataFrame([(text, *more.values())], ["text", *more])
    return df.select(*columns).first()


def test_rules(spark):
    df = spark.createDataFrame([(1, "business_receipt", RECEIPT), (2, "fuel_receipt", "BP\n40.5 litres at 189.9 c/l Diesel: max"), (3, "other", ""), (4, "bank_statement", "BSB: 062-001 account number: 12345678")], "doc_id int, doc_type string, text string")
    got = {(r.doc_id, r.field): (r.value, round(r.confidence, 6)) for r in extraction.long_form(extraction.extract(df)).collect()}
    assert got[1, "supplier"] == ("Woolworths Metro", 0.9)
    assert got[1, "date"][0] == "25/03/2024" and got[1, "total"][0] == "45.67" and got[1, "abn"][0] == "88 000 014 675"
    assert got[2, "litres"][0] == "40.50" and got[2, "supplier"][0] == "Bp"
    assert got[4, "bsb"][0] == "062-001" and got[4, "account_number"][0] == "12345678"
    assert not [k for k in got if k[0] == 3]
    assert one(spark, "mcdonald's o'neil-smith", extraction.title(F.col("text")))[0] == "Mcdonald'S O'Neil-Smith"
    assert len(extraction.RULES) == 35
    assert [r.priority for r in extraction.rules_for("business_receipt", "total")] == [20, 18, 17, 15, 10, 9]


def test_recognition(spark):
    for text, name in (("Woolworths", "Woolworths"), ("JB HIFI", "JB Hi-Fi"), ("Bunnings", "Bunnings Warehouse"), ("Local Cafe", None)):
        m = one(spark, text, registry.best(F.col("text")).alias("m")).m
        assert (m.name if m else None) == name
    assert abs(one(spark, "Shell", registry.best(F.col("text")).alias("m")).m.confidence - 0.9) < 1e-9


def test_compliance(spark):
    fields = {"supplier_name": "Woolworths", "date": "25/03/2024", "total_amount": "45.67", "gst_amount": "4.15", "abn": "88000014675", "invoice_number": "INV-12345"}
    rows = [("business_receipt", "", fields), ("bank_statement", "", {"account_number": "12345678", "bsb": "062-001"}), ("unknown", "", {})]
    df = spark.createDataFrame(rows, "doc_type string, text string, fields map<string,string>")
    a, b, c = compliance.assess(df, 2024).collect()
    assert a.passed and abs(a.compliance_score - (0.3 * 1 + 0.25 * 1 + 0.2 * 0.95 + 0.15 * 0.8 + 0.1)) < 1e-9
    assert abs(b.completeness - 2 / 3) < 1e-9 and b.formats == 1.0 and b.business_score == 0.0 and b.specific == 1.0
    assert c.completeness == 0.5 and c.formats == 1.0


def test_confidence(spark):
    df = spark.createDataFrame([(0.9, 0.8, True, {"date": "1", "total_amount": "2", "supplier_name": "s", "gst_amount": "1", "abn": "x", "n": "y"}), (0.2, 0.9, False, {})], "c double, ato double, ok boolean, fields map<string,string>")
    f = F.col("fields")
    q = confidence.extraction_quality(f)
    b = confidence.business_recognition(F.lit("coles sydney abn gst"), f, F.lit(True))
    out = df.select(q.alias("q"), b.alias("b"), *[c.alias(k) for k, c in confidence.assess(F.col("c"), q, F.col("ato"), F.col("ok"), b, f).items()]).collect()
    assert abs(out[0].q - (0.6 + 0.4 * 3.5 / 5)) < 1e-9 and abs(out[0].b - 0.9) < 1e-9
    assert abs(out[0].overall - (0.225 + 0.35 * 0.88 + 0.2 + 0.135)) < 1e-9 and out[0].grade == "good" and out[0].production_ready and not out[0].flags
    assert out[1].overall <= 0.4 and {"low_classification_confidence", "ato_compliance_failed", "insufficient_fields"} <= set(out[1].flags)


def test_classification(spark):
    df = spark.createDataFrame([("Tax Invoice invoice number abn supplier customer gst invoice due date terms subtotal professional services",), ("nothing here",), ("",)], "text string")
    got = [r.predicted for r in classification.classify(df).collect()]
    assert got == ["tax_invoice", "other", "other"]


def test_texts(spark):
    assert one(spark, "total total total total is  5\nThank you for coming", texts.cleanup(F.col("text")))[0] == "total is 5"
    assert one(spark, "x " + "ab cd " * 400, F.length(texts.cleanup(F.col("text"))))[0] <= 1003
    bank = one(spark, "ANZ account statement balance: Australia and New Zealand", F.get(texts.primary_bank(F.col("text")), 0).alias("b")).b
    assert bank.bank == "ANZ Bank" and bank.confidence == 1.0
    h = one(spark, "BP Fuel Station -85.50", texts.highlighted(F.col("text")).alias("h"), texts.work_score(F.col("text")).alias("w"))
    assert h.h.amount == "-85.50" and h.h.description == "BP Fuel Station" and h.w.category == "fuel"
    items = texts.line_items(spark.createDataFrame([(1, "Widget blue 2 $10.50 $21.00\nfoot 7\n")], "id int, text string")).collect()
    assert [(i.description, i.quantity, i.unit_price, i.line_total) for i in items] == [("Widget blue", 2.0, 10.5, 21.0)]
    assert one(spark, "1,234.50 then $99", texts.last_amount(F.col("text")))[0] == 99.0
    assert one(spark, "hilton room", texts.route(F.col("text"), F.lit("tax_invoice")))[0] == "accommodation_extraction_prompt"


def test_stages_of_long_texts_are_left_to_methods_that_java_compiles(spark):
    from taxloom.sources import views

    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    views.view(spark, "/root/testdata/sf0.001", "page_words")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
