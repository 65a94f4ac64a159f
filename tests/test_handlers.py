import pytest
from pyspark.sql import functions as F

from taxloom.operators import fallback, handlers, registry, texts

STATEMENT = """Commonwealth Bank
Account holder: Jane Citizen
BSB: 062-001
Account number: 12345678
Statement period: 01/03/2024 to 31/03/2024
Opening balance: $1,234.56
05/03/2024 BP Fuel Station -$45.60
06/03/2024 Salary payment $2000.00
07/03/2024 x -$1.00
Closing balance: $900.00
Account type: savings"""
FUEL = "Shell Coles Express\n12 Main St Richmond VIC 3121\nDATE: 16/03/2023\nUnleaded 91\n40.00 L @ $1.85 per litre\nPump 4\nTOTAL: $74.00"
SHOP = "The Pen Shop\nBlue pen pack 12.50\nUSB cable $19.95\nnet amount $32.45\nGST: $3.25\nTOTAL: $35.70\nPaid by EFTPOS\nReceipt no: R-77"
INVOICE = "Acme Consulting Pty Ltd\n12 Hill Rd Perth WA 6000\nABN 51 004 085 616\nInvoice No: INV-9\nInvoice date: 01/02/2024\nBill to: Jane Doe\nnet: $100\nGST: $10\nTOTAL: $110\nnet 30 days"


def read(spark, kind, text):
    return handlers.checked(handlers.read(spark.createDataFrame([(1, text)], "doc_id int, text string"), kind), kind).first()


def test_statement(spark):
    r = read(spark, "bank_statement", STATEMENT)
    assert (r.bank_name, r.account_holder.split("\n")[0], r.bsb, r.account_number) == ("Commonwealth Bank", "Jane Citizen", "062-001", "12345678")
    assert (r.statement_period_from, r.statement_period_to, r.opening_balance, r.closing_balance, r.account_type) == ("01/03/2024", "31/03/2024", 1234.56, 900.0, "savings")
    assert [(t.date, t.amount) for t in r.transactions] == [("05/03/2024", -45.6), ("06/03/2024", 2000.0)]
    assert [(e.expense_category, e.work_score, e.confidence) for e in r.work_expenses] == [("fuel", 1.5, 0.75)]
    assert r.issues == []


def test_fuel(spark):
    r = read(spark, "fuel_receipt", FUEL)
    assert (r.station_name, r.fuel_type, r.litres, r.price_per_litre, r.pump_number, r.location) == ("Shell", "unleaded 91", 40.0, 1.85, "4", "3121, VIC")
    assert r.issues == []
    r = read(spark, "fuel_receipt", FUEL.replace("74.00", "600.00"))
    assert r.issues == ["Total amount $600.00 outside reasonable range ($5.0-$500.0)", "Calculated total $74.00 differs significantly from stated total $600.00"]


def test_shop(spark):
    r = read(spark, "business_receipt", SHOP)
    assert (r.business_name, r.payment_method, r.receipt_number, r.subtotal, r.total_amount) == ("The Pen Shop", "eftpos", "R-77", 32.45, 35.7)
    assert [(i.description, i.amount) for i in r["items"]] == [("Blue pen pack", 12.5), ("USB cable", 19.95), ("net amount", 32.45)]
    assert [(i.business_category, i.likelihood) for i in r.categorized_items] == [("office_supplies", 0.9), ("computer_equipment", 0.9), ("other", 0.3)]
    assert r.issues == ["Missing required field: date", "Items total $64.90 differs significantly from receipt total $35.70"]


def test_invoice(spark):
    r = read(spark, "tax_invoice", INVOICE)
    assert (r.supplier_name, r.supplier_abn, r.invoice_number, r.invoice_date, r.subtotal, r.service_type, r.payment_terms) == ("Acme Consulting Pty Ltd", "51 004 085 616", "INV-9", "01/02/2024", 100.0, "consulting", "Net 30 days")
    assert r.supplier_address.startswith("Acme Consulting Pty Ltd, 12 Hill Rd Perth WA 6000")
    assert r.issues == ["Document should contain 'Tax Invoice' text"]


def test_highlights_override_by_confidence(spark):
    rows = handlers.read(spark.createDataFrame([(1, FUEL), (2, FUEL.replace("TOTAL: $74.00", "")), (3, FUEL)], "doc_id int, text string"), "fuel_receipt")
    marks = spark.createDataFrame([(1, 0, "Total: $80.00", 0.9), (1, 1, "Total: $81.00", 0.5), (2, 0, "Pump 9", 0.6), (2, 1, "Total $75.00", 0.3)], "doc_id int, ord long, text string, confidence double")
    got = {r.doc_id: r for r in handlers.enriched(rows, marks, "fuel_receipt").collect()}
    assert (got[1].total_amount, got[1].correction) == (74.0, "corrected_from_calculation")
    assert (got[2].total_amount, got[2].pump_number, got[2].correction) == (75.0, "4", None)
    assert (got[3].total_amount, got[3].correction) == (74.0, None)


def test_gst_is_derived(spark):
    rows = spark.createDataFrame([(1, 100.0, None, 110.0), (2, 100.0, 3.0, 110.0), (3, 100.0, 10.0, None), (4, None, 1.0, 11.0)], "doc_id int, subtotal double, gst_amount double, total_amount double")
    got = {r.doc_id: (r.gst_amount, r.total_amount, r.correction) for r in handlers.corrected(rows, "tax_invoice").collect()}
    assert got == {1: (10.0, 110.0, "calculated_gst"), 2: (10.0, 110.0, "corrected_gst"), 3: (10.0, 110.0, "calculated_total"), 4: (1.0, 11.0, None)}


def test_duplicates_keep_highlighted_lines_in_place(spark):
    rows = spark.createDataFrame([(1, 0, "a", False), (1, 1, "b", False), (1, 2, "a", True), (1, 3, "a", False)], "doc_id int, ord long, description string, highlighted boolean")
    got = sorted((r.place, r.ord, r.description, r.highlighted) for r in handlers.deduplicated(rows, [F.col("description")]).collect())
    assert got == [(0, 2, "a", True), (1, 1, "b", False)]


def test_registry(spark):
    assert len(registry.default()) == 100 and len(registry.industry_words()) == 33 and len(registry.aliases()) == 8
    one = spark.createDataFrame([("woolworths", "bank_statement", {"abn": "88 000 014 675"}), ("shell", "fuel_receipt", {"litres": "1"}), ("corner cafe", "meal_receipt", {})], "name string, kind string, fields map<string,string>")
    got = [r[0] for r in one.select(registry.context_issues(F.col("name"), F.col("kind"), F.col("fields"))).collect()]
    assert got[0] == ["Document type 'bank_statement' unusual for retail_supermarket business"]
    assert got[1] == ["Missing fuel-specific fields: fuel_type, price_per_litre"]
    assert got[2] == ["Business 'corner cafe' not found in Australian business registry"]
    rows = spark.createDataFrame([("88000014675",), ("1",), (None,)], "abn string")
    assert sorted(str(r.registered_name) for r in registry.by_abn(rows, registry.as_frame(spark)).collect()) == ["None", "None", "Woolworths Group Limited"]


@pytest.mark.parametrize("fields,bad,grade", [({}, True, "very_poor"), ({"a": "xyz", "b": "foo", "total_amount": "3"}, True, "poor"), ({k: "value" for k in "abcdefgh"}, False, "excellent"), ({"date": "1/2", "a": "xx", "b": "yy"}, True, "poor"), ({**{k: "value" for k in "abcd"}, "total_amount": "$50.00"}, False, "fair")])
def test_fallback(spark, fields, bad, grade):
    df = spark.createDataFrame([(fields,)], "fields map<string,string>")
    assert tuple(df.select(fallback.insufficient(F.col("fields")), fallback.preliminary_grade(F.col("fields"))).first()) == (bad, grade)


def test_answers(spark):
    df = spark.createDataFrame([("bank statement with diesel",), ("A Tax Invoice",), ("??",)], "text string")
    assert [r.v.document_type for r in df.select(texts.classify_answer(F.col("text")).alias("v")).collect()] == ["fuel_receipt", "tax_invoice", "unknown"]
    assert [r.v.confidence for r in df.select(texts.classify_answer_plainly(F.col("text")).alias("v")).collect()] == [0.85, 0.85, 0.5]
