"""What is known of each document type: description, tax category, expected fields, whether GST must be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Description, tax category, fields that such documents have, whether GST is required, and their use in business.
METADATA = {
    "fuel_receipt": ("Vehicle fuel expenses and receipts", "Work-related car expenses", ["date", "fuel_type", "litres", "total_amount", "station_name"], True, "Vehicle operation costs"),
    "tax_invoice": ("GST tax invoices with ABN identification", "Business expenses", ["date", "abn", "supplier", "total_amount", "gst_amount"], True, "Professional services and supplies"),
    "business_receipt": ("General business purchase receipts", "Business expenses", ["date", "merchant", "items", "total_amount"], False, "Office supplies and general business purchases"),
    "bank_statement": ("Australian bank account statements", "Financial records", ["account_number", "bsb", "transactions", "balance"], False, "Business account transaction records"),
    "meal_receipt": ("Food and entertainment expense receipts", "Meal entertainment expenses", ["date", "restaurant", "amount", "meal_type"], True, "Business meals and client entertainment"),
    "accommodation": ("Travel accommodation expenses", "Work-related travel expenses", ["date", "hotel", "nights", "total_amount"], True, "Business travel accommodation"),
    "travel_document": ("Flight tickets and travel documentation", "Work-related travel expenses", ["date", "airline", "destination", "ticket_price"], True, "Business travel transportation"),
    "parking_toll": ("Parking and toll road expenses", "Work-related car expenses", ["date", "location", "duration", "amount"], False, "Vehicle operation costs"),
    "professional_services": ("Legal, accounting, and consulting services", "Professional fees", ["date", "service_provider", "hours", "rate", "total_amount"], True, "Professional advisory services"),
    "equipment_supplies": ("Office equipment and supply purchases", "Business equipment", ["date", "supplier", "items", "quantities", "total_amount"], True, "Business equipment and office supplies"),
    "other": ("Recognized business document of unclear type", "Unclassified business expense", ["date", "merchant", "amount"], False, "Requires manual classification"),
    "unknown": ("Document with no clear classification patterns", "Unknown", [], False, "Requires manual review"),
}
#: Types that are no expense of a business.
NO_EXPENSE = ["unknown", "bank_statement"]


def known(spark: SparkSession) -> DataFrame:
    """The types as rows: doc_type, description, ato_category, expected_fields, requires_gst, business_context."""
    return spark.createDataFrame([(k, *v) for k, v in METADATA.items()], "doc_type string, description string, ato_category string, expected_fields array<string>, requires_gst boolean, business_context string")


def is_expense(doc_type: Column) -> Column:
    return F.coalesce(~doc_type.isin(NO_EXPENSE), F.lit(False))


def described(docs: DataFrame, fields: Column) -> DataFrame:
    """docs with what is known of their type, whether that is an expense, and the expected fields that `fields` (a map) lacks.

    A type that nobody knows has no description, requires nothing and expects nothing.
    """
    rows = docs.join(F.broadcast(known(docs.sparkSession)), "doc_type", "left")
    rows = rows.withColumns({"requires_gst": F.coalesce("requires_gst", F.lit(False)), "expected_fields": F.coalesce("expected_fields", F.expr("cast(array() as array<string>)")), "is_expense": is_expense(F.col("doc_type"))})
    return rows.withColumn("lacking", F.filter("expected_fields", lambda n: F.coalesce(fields[n], F.lit("")) == ""))
