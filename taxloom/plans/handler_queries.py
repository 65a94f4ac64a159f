"""Queries that read, check and enrich statements, receipts and invoices."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxloom.operators import handlers as h
from taxloom.plans.result_queries import rounded
from taxloom.sources.views import view, with_views


def _papers(spark, d, kind):
    return view(spark, d, "papers").filter(F.col("doc_type") == kind)


def _flat(rows, names):
    """Figures rounded, lists as their length."""
    kinds = dict(rows.dtypes)
    return [F.round(n, 6).alias(n) if kinds[n] == "double" else F.size(n).alias(n) if kinds[n].startswith("array<struct") else F.col(n) for n in names]


def reading(kind, names):
    def run(spark, d):
        rows = h.read(_papers(spark, d, kind), kind)
        return rows.select("doc_id", *_flat(rows, names))

    return run


def common(spark, d):
    """The fields that all papers share, and what meal and other papers add."""
    rows = h.read(view(spark, d, "papers"), "meal_receipt")
    return rows.select("doc_id", *_flat(rows, [*_COMMON, "restaurant_name"]))


def checks(kind):
    def run(spark, d):
        rows = h.checked(h.read(_papers(spark, d, kind), kind), kind)
        # Figures are left out: engines print doubles that end in a half differently.
        told = F.regexp_replace(F.array_join("issues", "; "), "[0-9][0-9.,]*", "#")
        return rows.select("doc_id", told.alias("issues"), F.round("field_confidence", 6).alias("field_confidence"))

    return run


def enrichment(kind, names):
    def run(spark, d):
        marks = view(spark, d, "paper_highlights").filter(F.col("doc_type") == kind).drop("doc_type")
        rows = h.enriched(h.read(_papers(spark, d, kind), kind), marks, kind)
        return rows.select("doc_id", *_flat(rows, names))

    return run


def work_expenses(spark, d):
    rows = h.read(_papers(spark, d, "bank_statement"), "bank_statement")
    # An array that is a plain column would be read once more, for a filter that Spark puts before what takes it apart.
    rows = rows.select("doc_id", F.posexplode(F.coalesce("work_expenses", F.array())).alias("nth", "e"))
    return rounded(rows.select("doc_id", "nth", "e.*"), "amount", "confidence")


def receipt_items(spark, d):
    rows = h.read(_papers(spark, d, "business_receipt"), "business_receipt")
    return rounded(rows.select("doc_id", F.posexplode("categorized_items").alias("nth", "i")).select("doc_id", "nth", "i.*"), "amount", "likelihood")


def deduplicated(spark, d):
    """Transactions of a statement (text and highlights): one for each date and amount."""
    t = view(spark, d, "bank_txns")
    lines = t.select(F.col("statement_id").alias("doc_id"), "ord", "date", "description", (F.pmod("cents", F.lit(5)) * 1.5).alias("amount"), (F.col("event_id") % 3 == 0).alias("highlighted"))
    out = h.deduplicated(lines, [F.col("date"), F.col("amount")])
    return out.select("doc_id", "place", "ord", "date", "description", "highlighted")


def handler_summary(spark, d):
    """Papers by type, beside what their handlers ask for."""
    rows = [(k, len(r), len(o), k in h.PRIORITY, k in h.MORE) for k, (r, o) in h.FIELDS.items()]
    known = spark.createDataFrame(rows, "document_type string, required int, optional int, overrides_from_highlights boolean, closer_look boolean")
    found = view(spark, d, "papers").groupBy(F.col("doc_type").alias("document_type")).agg(F.count("*").alias("papers"))
    return found.join(F.broadcast(known), "document_type", "left")


_COMMON = ["date", "total_amount", "gst_amount", "abn", "supplier_name", "business_name"]
_STATEMENT = ["bank_name", "account_holder", "bsb", "account_number", "statement_period_from", "statement_period_to", "opening_balance", "closing_balance", "transactions", "work_expenses", "account_type"]
_FUEL = [*_COMMON, "fuel_type", "litres", "price_per_litre", "pump_number", "station_name", "location", "odometer_reading", "vehicle_registration"]
_SHOP = [*_COMMON, "subtotal", "payment_method", "receipt_number", "store_location", "items", "discount_amount", "loyalty_program", "loyalty_member_id", "staff_id"]
_INVOICE = [*_COMMON, "supplier_abn", "invoice_number", "invoice_date", "customer_name", "description", "subtotal", "due_date", "service_type", "payment_terms", "supplier_address"]
_ENRICHED = {
    "bank_statement": ["opening_balance", "closing_balance"],
    "fuel_receipt": ["total_amount", "litres", "price_per_litre", "fuel_type", "pump_number", "date", "correction"],
    "business_receipt": ["business_name", "receipt_number", "payment_method", "total_amount", "gst_amount", "subtotal", "highlight_amount", "date", "abn", "correction"],
    "tax_invoice": ["supplier_name", "supplier_abn", "invoice_number", "invoice_date", "description", "customer_name", "total_amount", "gst_amount", "subtotal", "tax_invoice_indicator", "correction"],
}

QUERIES = {
    "p2_common_fields": common,
    "x13_bank_statements": reading("bank_statement", _STATEMENT),
    "x24_fuel_receipts": reading("fuel_receipt", _FUEL),
    "x35_business_receipts": reading("business_receipt", _SHOP),
    "x49_tax_invoices": reading("tax_invoice", _INVOICE),
    "v19_statement_checks": checks("bank_statement"),
    "v20_fuel_checks": checks("fuel_receipt"),
    "v21_receipt_checks": checks("business_receipt"),
    "v22_invoice_checks": checks("tax_invoice"),
    "x70_statement_highlights": enrichment("bank_statement", _ENRICHED["bank_statement"]),
    "x67_fuel_highlights": enrichment("fuel_receipt", _ENRICHED["fuel_receipt"]),
    "x68_receipt_highlights": enrichment("business_receipt", _ENRICHED["business_receipt"]),
    "x69_invoice_highlights": enrichment("tax_invoice", _ENRICHED["tax_invoice"]),
    "b3_statement_work_expenses": work_expenses,
    "x44_receipt_items": receipt_items,
    "x23_unique_transactions": deduplicated,
    "x77_handler_summary": handler_summary,
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ex(t: str, p: str, group: int = 1, flags: str = "(?i)") -> str:
    return f"REGEXP_EXTRACT({t}, {_q(flags + p)}, {group})"


def _has(t: str, p: str, flags: str = "(?i)") -> str:
    return f"REGEXP_MATCHES({t}, {_q(flags + p)})"


def _first(t: str, patterns: list[str], group: int = 1, flags: str = "(?i)") -> str:
    return "COALESCE(" + ", ".join(f"NULLIF({_ex(t, p, group, flags)}, '')" for p in patterns) + ")"


def _number(t: str, patterns: list[str]) -> str:
    return f"NULLIF(TRY_CAST(REPLACE({_first(t, patterns)}, ',', '') AS DOUBLE), 0)"


def _named(t: str, patterns: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {_has(t, p)} THEN {_q(k)}" for k, p in patterns.items()) + " END"


def _worded(low: str, words: dict[str, list[str]]) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"CONTAINS({low}, {_q(w)})" for w in ws) + f" THEN {_q(k)}" for k, ws in words.items()) + " END"


def _any_of(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"CONTAINS({low}, {_q(w)})" for w in words) + ")"


def _strip(t: str) -> str:
    return f"TRIM({t}, ' ' || CHR(9) || CHR(10) || CHR(13) || CHR(11) || CHR(12))"


def _lines(most: int | None = None) -> str:
    return f"LIST_TRANSFORM(STRING_SPLIT(text, CHR(10)){f'[1:{most}]' if most else ''}, lambda x: {_strip('x')})"


def _first_line(most: int, least: int, but: str) -> str:
    return f"LIST_FILTER({_lines(most)}, lambda x: LENGTH(x) > {least} AND NOT REGEXP_MATCHES(LOWER(x), {_q(but)}))[1]"


_SQL_COMMON = {
    "date": _first("text", h.DATES),
    "total_amount": f"TRY_CAST({_first('text', h.TOTALS)} AS DOUBLE)",
    "gst_amount": f"TRY_CAST({_first('text', h.GST)} AS DOUBLE)",
    "abn": _first("text", h.ABNS),
    "supplier_name": f"COALESCE(NULLIF({_strip(_first('text', h.SUPPLIERS))}, ''), {_first('text', h.NAMES, 0)})",
}
_SQL_COMMON["business_name"] = _SQL_COMMON["supplier_name"]
_ITEMS = f"LIST_FILTER(LIST_TRANSFORM(LIST_FILTER({_lines()}, lambda x: {_has('x', h.ITEM, '')}), lambda x: {{'description': {_strip(_ex('x', h.ITEM, 1, ''))}, 'amount': CAST({_ex('x', h.ITEM, 2, '')} AS DOUBLE)}}), lambda i: NOT {_has('LOWER(i.description)', h.NO_ITEM, '')})"
_TXNS = f"LIST_TRANSFORM(LIST_FILTER({_lines()}, lambda x: {_has('x', h.LINE, '')}), lambda x: {{'date': {_ex('x', h.LINE, 1, '')}, 'description': {_strip(_ex('x', h.LINE, 2, ''))}, 'amount': CAST(REPLACE({_ex('x', h.LINE, 3, '')}, '$', '') AS DOUBLE)}})"
_WORK_KIND = _named("t.description", h.WORK_PATTERNS)
_WORK_SCORE = f"(CASE WHEN {_WORK_KIND} IS NOT NULL THEN 1.0E0 ELSE 0.0E0 END + 0.5E0 * (" + " + ".join(f"CASE WHEN CONTAINS(LOWER(t.description), {_q(w)}) THEN 1 ELSE 0 END" for w in h.WORK_WORDS) + "))"
_WORK = f"LIST_FILTER(LIST_TRANSFORM(LIST_FILTER({_TXNS}, lambda t: t.amount < 0), lambda t: {{'date': t.date, 'description': t.description, 'amount': t.amount, 'work_score': {_WORK_SCORE}, 'expense_category': COALESCE({_WORK_KIND}, 'other'), 'confidence': LEAST({_WORK_SCORE} / 2, 1.0E0)}}), lambda e: e.work_score > 0)"
_BSB = _first("text", h.BSBS)
_STATE, _CODE = f"UPPER({_first('text', h.STATES, 0)})", _first("text", [h.POSTCODE])
_PRICE = _number("text", h.PRICES)
_HOLDER = "COALESCE(" + ", ".join(f"CASE WHEN LENGTH({_strip(_first('text', [p]))}) > 2 THEN {_strip(_first('text', [p]))} END" for p in h.HOLDERS) + ")"
_CONTEXT = []
for _p in h.FUEL_CONTEXT:
    _m = f"LOWER({_ex('text', _p, 0)})"
    _CONTEXT.append(f"CASE WHEN CONTAINS({_m}, '91') OR CONTAINS({_m}, 'regular') THEN 'unleaded 91' WHEN CONTAINS({_m}, '95') OR CONTAINS({_m}, 'premium') THEN 'premium unleaded 95' WHEN CONTAINS({_m}, '98') OR CONTAINS({_m}, 'supreme') THEN 'premium unleaded 98' WHEN CONTAINS({_m}, 'diesel') THEN 'diesel' END")
_SQL_OWN = {
    "bank_statement": {
        "bank_name": f"COALESCE({_named('text', h.BANKS)}, LIST_FILTER({_lines(5)}, lambda x: CONTAINS(LOWER(x), 'bank'))[1])",
        "account_holder": _HOLDER,
        "bsb": f"CASE WHEN LENGTH({_BSB}) = 6 THEN SUBSTR({_BSB}, 1, 3) || '-' || SUBSTR({_BSB}, 4, 3) ELSE {_BSB} END",
        "account_number": _first("text", h.ACCOUNTS),
        "statement_period_from": _first("text", h.PERIODS, 1, "(?is)"),
        "statement_period_to": _first("text", h.PERIODS, 2, "(?is)"),
        "opening_balance": f"COALESCE({_number('text', h.OPENING)}, 0.0E0)",
        "closing_balance": f"COALESCE({_number('text', h.CLOSING)}, 0.0E0)",
        "transactions": f"NULLIF(LEN({_TXNS}), 0)",
        "work_expenses": f"NULLIF(LEN({_WORK}), 0)",
        "account_type": f"LOWER({_first('text', h.ACCOUNT_TYPES)})",
    },
    "fuel_receipt": {
        "fuel_type": f"COALESCE({_strip('LOWER(' + _first('text', h.FUEL_TYPES, 0) + ')')}, {', '.join(_CONTEXT)})",
        "litres": _number("text", h.LITRES),
        "price_per_litre": f"CASE WHEN {_PRICE} > 10 THEN {_PRICE} / 100 ELSE {_PRICE} END",
        "pump_number": _first("text", h.PUMPS),
        "station_name": f"COALESCE({_named('text', h.STATIONS)}, {_first_line(5, 3, h.FIRST_DIGIT)}, {_worded('LOWER(text)', h.STATION_WORDS)})",
        "location": f"COALESCE(CASE WHEN {_STATE} IS NOT NULL THEN CONCAT_WS(', ', {_CODE}, {_STATE}) ELSE {_CODE} END, LIST_FILTER({_lines()}, lambda x: {_has('x', h.POSTCODE, '')} AND {_has('x', h.ADDRESS)})[1])",
        "odometer_reading": _first("text", h.ODOMETERS),
        "vehicle_registration": f"REPLACE(UPPER({_first('text', h.REGISTRATIONS)}), ' ', '')",
    },
    "business_receipt": {
        "business_name": f"COALESCE({_named('text', h.CHAINS)}, {_first_line(3, 2, h.NO_NAME)}, {_worded('LOWER(text)', h.CHAIN_WORDS)})",
        "subtotal": _number("text", h.SUBTOTALS),
        "payment_method": "COALESCE(" + ", ".join([*(f"CASE WHEN {_has('text', chr(92) + 'b' + m + chr(92) + 'b')} THEN {_q(m)} END" for m in h.METHODS), *(f"CASE WHEN LOWER({_ex('text', p)}) IN ({', '.join(map(_q, h.METHODS))}) THEN LOWER({_ex('text', p)}) END" for p in h.PAYMENTS)]) + ")",
        "receipt_number": _first("text", h.RECEIPTS),
        "store_location": "COALESCE(" + ", ".join(f"NULLIF({_ex('text', p, g)}, '')" for p, g in h.PLACES) + f", LIST_FILTER(LIST_TRANSFORM({_lines(10)}, lambda x: CASE WHEN {_has('x', h.STORE_LINE)} THEN 'Store ' || {_ex('x', h.STORE_LINE)} || ' - ' || {_strip(_ex('x', h.STORE_LINE, 2))} WHEN {_has('x', h.STREET_LINE)} THEN x END), lambda x: x IS NOT NULL)[1])",
        "items": f"NULLIF(LEN({_ITEMS}), 0)",
        "discount_amount": _number("text", h.DISCOUNTS),
        "loyalty_program": _named("text", h.LOYALTY),
        "loyalty_member_id": "CASE " + " ".join(f"WHEN {_has('text', p)} THEN {_ex('text', p)}" for p in h.LOYALTY.values()) + " END",
        "staff_id": f"NULLIF({_strip(_first('text', h.STAFF))}, '')",
    },
    "tax_invoice": {
        "supplier_name": f"COALESCE({_first_line(5, 3, h.NO_SUPPLIER)}, {_SQL_COMMON['supplier_name']})",
        "supplier_abn": "",
        "invoice_number": _first("text", h.INVOICE_NUMBERS),
        "invoice_date": _first("text", h.INVOICE_DATES),
        "customer_name": f"NULLIF({_strip(_first('text', h.CUSTOMERS))}, '')",
        "description": f"NULLIF({_strip(_first('text', h.DESCRIPTIONS))}, '')",
        "subtotal": _number("text", h.INVOICE_SUBTOTALS),
        "due_date": _first("text", h.DUE_DATES),
        "service_type": _worded("LOWER(text)", h.SERVICES),
        "payment_terms": "",
        "supplier_address": "",
    },
}


def _spaced(v: str) -> str:
    d = f"REGEXP_REPLACE({v}, '[^0-9]', '', 'g')"
    return f"CASE WHEN LENGTH({d}) = 11 THEN SUBSTR({d}, 1, 2) || ' ' || SUBSTR({d}, 3, 3) || ' ' || SUBSTR({d}, 6, 3) || ' ' || SUBSTR({d}, 9, 3) END"


_OWN_ABN = _first("text", h.SUPPLIER_ABNS)
_MORE_ABN = "COALESCE(" + ", ".join([_spaced(_OWN_ABN), *(_spaced(_first("text", [p])) for p in h.MORE_ABNS)]) + ")"
_TERM = " ".join(f"WHEN {_has('text', p)} THEN CASE WHEN CONTAINS(LOWER({_ex('text', p, 0)}), 'receipt') THEN 'Due on receipt' WHEN CONTAINS(LOWER({_ex('text', p, 0)}), 'days') THEN 'Net ' || {_ex('text', p) if k < 2 else _q('')} || ' days' ELSE {_strip(_ex('text', p)) if k < 2 else _q('')} END" for k, p in enumerate(h.TERMS))
_AROUND = f"LIST_FILTER({_lines()}[GREATEST(i - 2, 1):i + 1], lambda x: LENGTH(x) > 5 AND NOT REGEXP_MATCHES(LOWER(x), {_q(h.NO_ADDRESS)}))"
_SQL_OWN["tax_invoice"] |= {
    "supplier_abn": f"CASE WHEN {_OWN_ABN} IS NULL OR LENGTH({_MORE_ABN}) > LENGTH({_OWN_ABN}) THEN {_MORE_ABN} ELSE {_OWN_ABN} END",
    "payment_terms": f"NULLIF(CASE {_TERM} END, '')",
    "supplier_address": f"LIST_FILTER(LIST_TRANSFORM(RANGE(1, 11), lambda i: CASE WHEN {_has(_lines() + '[i]', h.POSTCODE, '')} THEN NULLIF(ARRAY_TO_STRING({_AROUND}[1:3], ', '), '') END), lambda a: a IS NOT NULL)[1]",
}


def _read_sql(kind: str, names: list[str]) -> str:
    """Every field in its own expression over the text; figures rounded."""
    figures = {"total_amount", "gst_amount", "opening_balance", "closing_balance", "litres", "price_per_litre", "subtotal", "discount_amount"}
    own = _SQL_OWN[kind]
    out = []
    for n in names:
        e = own.get(n) or _SQL_COMMON[n]
        if n == "business_name" and kind == "business_receipt":
            e = f"COALESCE({own[n]}, {_SQL_COMMON[n]})"
        out.append(f"ROUND({e}, 6) AS {n}" if n in figures else f"CAST({e} AS INT) AS {n}" if n in ("transactions", "work_expenses", "items") else f"{e} AS {n}")
    return "SELECT doc_id, " + ", ".join(out) + f" FROM papers WHERE doc_type = '{kind}'"


_CATEGORY = f"COALESCE({_worded('LOWER(i.description)', h.ITEM_WORDS)}, 'other')"
_LIKELY = "CASE " + _CATEGORY + " " + " ".join(f"WHEN '{k}' THEN {v}E0" for k, v in h.LIKELIHOOD.items()) + " ELSE 0.3E0 END"
ORACLES: dict[str, str] = {
    "p2_common_fields": with_views("SELECT doc_id, " + ", ".join(f"ROUND({e}, 6) AS {n}" if n.endswith("amount") else f"{e} AS {n}" for n, e in _SQL_COMMON.items()) + f", {_first('text', h.NAMES, 0)} AS restaurant_name FROM papers", "papers"),
    "x13_bank_statements": with_views(_read_sql("bank_statement", _STATEMENT), "papers"),
    "x24_fuel_receipts": with_views(_read_sql("fuel_receipt", _FUEL), "papers"),
    "x35_business_receipts": with_views(_read_sql("business_receipt", _SHOP), "papers"),
    "x49_tax_invoices": with_views(_read_sql("tax_invoice", _INVOICE), "papers"),
    "b3_statement_work_expenses": with_views(f"SELECT doc_id, CAST(nth - 1 AS INT) AS nth, e.date AS date, e.description AS description, ROUND(e.amount, 6) AS amount, e.work_score AS work_score, e.expense_category AS expense_category, ROUND(e.confidence, 6) AS confidence FROM (SELECT doc_id, UNNEST(w) AS e, GENERATE_SUBSCRIPTS(w, 1) AS nth FROM (SELECT doc_id, {_WORK} AS w FROM papers WHERE doc_type = 'bank_statement') a) b", "papers"),
    "x44_receipt_items": with_views(f"SELECT doc_id, CAST(nth - 1 AS INT) AS nth, i.description AS description, ROUND(i.amount, 6) AS amount, {_CATEGORY} AS business_category, {_LIKELY} AS likelihood FROM (SELECT doc_id, UNNEST(w) AS i, GENERATE_SUBSCRIPTS(w, 1) AS nth FROM (SELECT doc_id, {_ITEMS} AS w FROM papers WHERE doc_type = 'business_receipt') a) b", "papers"),
    "x23_unique_transactions": with_views("", "bank_txns").rstrip() + ", l AS (SELECT statement_id AS doc_id, ord, date, description, ((cents % 5) + 5) % 5 * 1.5 AS amount, event_id % 3 = 0 AS highlighted FROM bank_txns), r AS (SELECT *, MIN(ord) OVER (PARTITION BY doc_id, date, amount) AS place, ROW_NUMBER() OVER (PARTITION BY doc_id, date, amount ORDER BY CASE WHEN highlighted THEN 0 ELSE 1 END, CASE WHEN highlighted THEN -ord ELSE ord END) AS nth FROM l) SELECT doc_id, place, ord, date, description, highlighted FROM r WHERE nth = 1",
    "x77_handler_summary": with_views("", "papers").rstrip() + ", t(document_type, required, optional, overrides_from_highlights, closer_look) AS (VALUES " + ", ".join(f"('{k}', {len(r)}, {len(o)}, {k in h.PRIORITY}, {k in h.MORE})" for k, (r, o) in h.FIELDS.items()) + ") SELECT p.*, required, optional, overrides_from_highlights, closer_look FROM (SELECT doc_type AS document_type, COUNT(*) AS papers FROM papers GROUP BY doc_type) p LEFT JOIN t ON t.document_type = p.document_type",
}


def _raw(kind: str) -> str:
    """All fields of a type as they are, with its lists."""
    own = _SQL_OWN[kind]
    cols = {k: e for k, e in _SQL_COMMON.items() if k not in own} | own
    if kind == "business_receipt":
        cols["business_name"] = f"COALESCE({own['business_name']}, {_SQL_COMMON['business_name']})"
        cols["listed"] = f"LIST_SUM(LIST_TRANSFORM({_ITEMS}, lambda i: i.amount))"
    if kind == "bank_statement":
        cols["extreme"] = f"CAST(LEN(LIST_FILTER({_TXNS}, lambda t: NOT t.amount BETWEEN -50000 AND 50000)) AS INT)"
    return f"r AS (SELECT doc_id, " + ", ".join(f"{e} AS {k}" for k, e in cols.items()) + f" FROM papers WHERE doc_type = '{kind}')"


_FIGURES = {"total_amount", "gst_amount", "opening_balance", "closing_balance", "litres", "price_per_litre", "subtotal", "discount_amount"}
_LISTS = {"transactions", "work_expenses", "items"}
_UNREAD = {"total_debits", "total_credits", "branch_details", "cashier_id", "customer_abn", "tax_invoice_indicator"}


def _is_there(f: str) -> str:
    if f in _UNREAD:
        return "FALSE"
    return f"COALESCE({f} <> 0, FALSE)" if f in _FIGURES or f in _LISTS else f"COALESCE({f} <> '', FALSE)"


_SUMS3 = "subtotal <> 0 AND gst_amount <> 0 AND total_amount <> 0"
_OWN_CHECKS = {
    "bank_statement": [
        ("NOT REGEXP_MATCHES(bsb, '^[0-9]{3}-[0-9]{3}$')", "'Invalid BSB format: #-# (should be XXX-XXX)'"),
        ("NOT LENGTH(account_number) BETWEEN 6 AND 10", "'Account number length # outside range (#-#)'"),
        ("NOT opening_balance BETWEEN -100000 AND 1000000", "'Opening Balance $# outside reasonable range'"),
        ("NOT closing_balance BETWEEN -100000 AND 1000000", "'Closing Balance $# outside reasonable range'"),
        ("extreme > 0", "REPEAT('Transaction # amount $# outside reasonable range; ', extreme - 1) || 'Transaction # amount $# outside reasonable range'"),
    ],
    "fuel_receipt": [
        ("NOT " + _any_of("LOWER(fuel_type)", h.KNOWN_FUELS), "REGEXP_REPLACE('Unrecognized fuel type: ' || fuel_type, '[0-9][0-9.,]*', '#', 'g')"),
        ("litres <> 0 AND NOT litres BETWEEN 1 AND 200", "'Fuel quantity #L outside reasonable range (#-#L)'"),
        ("price_per_litre <> 0 AND NOT price_per_litre BETWEEN 1 AND 3", "'Price per litre $# outside reasonable range ($#-$#)'"),
        ("total_amount <> 0 AND NOT total_amount BETWEEN 5 AND 500", "'Total amount $# outside reasonable range ($#-$#)'"),
        ("total_amount <> 0 AND ABS(litres * price_per_litre - total_amount) > GREATEST(litres * price_per_litre * 0.15E0, 2.0E0)", "'Calculated total $# differs significantly from stated total $#'"),
    ],
    "business_receipt": [
        ("total_amount <> 0 AND NOT total_amount BETWEEN 0.01 AND 10000", "'Total amount $# outside reasonable range ($#-$#)'"),
        (f"{_SUMS3} AND ABS(subtotal + gst_amount - total_amount) > 0.05E0", "'Subtotal + GST ($#) does not equal total ($#)'"),
        (f"{_SUMS3} AND ABS(gst_amount - subtotal * 0.1E0) > 0.05E0", "'GST amount $# does not match expected #% ($#)'"),
        ("ABS(listed - total_amount) > GREATEST(total_amount * 0.2E0, 5.0E0)", "'Items total $# differs significantly from receipt total $#'"),
    ],
    "tax_invoice": [
        ("TRUE", "'Document should contain ''Tax Invoice'' text'"),
        ("NOT REGEXP_MATCHES(REPLACE(supplier_abn, ' ', ''), '^[0-9]{11}$')", "'Invalid supplier ABN format'"),
        (f"{_SUMS3} AND ABS(gst_amount - subtotal * 0.1E0) > 0.05E0", "'GST amount may be incorrect (expected $#)'"),
        (f"{_SUMS3} AND ABS(total_amount - (subtotal + gst_amount)) > 0.05E0", "'Total amount may be incorrect (expected $#)'"),
    ],
}
_TAX_CHECKS = [
    ("NOT REGEXP_MATCHES(REPLACE(abn, ' ', ''), '^[0-9]{11}$')", "'Invalid ABN format (must be # digits)'"),
    ("total_amount <> 0 AND gst_amount <> 0 AND ABS(gst_amount - total_amount * 0.10E0 / 1.10E0) > 0.05E0", "'GST amount # may be incorrect (expected ~#)'"),
    ("NOT REGEXP_MATCHES(date, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}')", "'Date should be in DD/MM/YYYY format'"),
]


def _checks_sql(kind: str) -> str:
    need, may = h.FIELDS[kind]
    found = [(f"NOT {_is_there(f)}", f"'Missing required field: {f}'") for f in need] + _OWN_CHECKS[kind] + _TAX_CHECKS
    text = "CONCAT_WS('; ', " + ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in found) + ")"
    n = " + ".join(f"CASE WHEN {c} THEN {'extreme' if 'extreme' in c else 1} ELSE 0 END" for c, _ in found)
    have = " + ".join(f"CASE WHEN {_is_there(f)} THEN 1 ELSE 0 END" for f in [*need, *may])
    bonus = f"CASE WHEN {_is_there('abn')} THEN 0.1E0 ELSE 0 END + CASE WHEN {_is_there('gst_amount')} THEN 0.1E0 ELSE 0 END"
    return with_views("", "papers").rstrip() + f", {_raw(kind)} SELECT doc_id, {text} AS issues, ROUND(GREATEST(LEAST(CAST({have} AS DOUBLE) / {len(need) + len(may)} - LEAST(0.1E0 * ({n}), 0.5E0) + {bonus}, 1.0E0), 0.0E0), 6) AS field_confidence FROM r"


ORACLES |= {"v19_statement_checks": _checks_sql("bank_statement"), "v20_fuel_checks": _checks_sql("fuel_receipt"), "v21_receipt_checks": _checks_sql("business_receipt"), "v22_invoice_checks": _checks_sql("tax_invoice")}


def _amounts(patterns: dict[str, str]) -> dict[str, str]:
    """The field that a highlight's amount belongs to, by the first pattern that matches or what the text says."""
    low = "LOWER(text)"
    told = f"CASE WHEN CONTAINS({low}, 'total') THEN 'total_amount' WHEN CONTAINS({low}, 'gst') OR CONTAINS({low}, 'tax') THEN 'gst_amount' WHEN CONTAINS({low}, 'sub') THEN 'subtotal' ELSE 'highlight_amount' END"
    kind = "CASE " + " ".join(f"WHEN {_ex('text', p)} <> '' THEN '{f}'" for f, p in patterns.items()) + f" WHEN {_ex('text', h.ANY_AMOUNT, 1, '')} <> '' THEN {told} END"
    value = "TRY_CAST(COALESCE(" + ", ".join([*(f"NULLIF({_ex('text', p)}, '')" for p in patterns.values()), f"NULLIF({_ex('text', h.ANY_AMOUNT, 1, '')}, '')"]) + ") AS DOUBLE)"
    return {f: f"NULLIF(CASE WHEN {kind} = '{f}' THEN {value} END, 0)" for f in patterns} | {"highlight_amount": f"CASE WHEN {kind} = 'highlight_amount' THEN {value} END"}


_SHOP_TOLD, _INVOICE_TOLD = _amounts(h.RECEIPT_HIGHLIGHT), _amounts(h.INVOICE_HIGHLIGHT)
_TOLD = {
    "bank_statement": {"opening_balance": _number("text", h.OPENING), "closing_balance": _number("text", h.CLOSING)},
    "fuel_receipt": {"fuel_type": _strip("LOWER(" + _first("text", h.FUEL_TYPES, 0) + ")"), "total_amount": _number("text", h.FUEL_HIGHLIGHT), "date": _first("text", h.DATES)} | {k: _SQL_OWN["fuel_receipt"][k] for k in ("litres", "price_per_litre", "pump_number")},
    "business_receipt": {"business_name": f"COALESCE({_named('text', h.CHAINS)}, {_first_line(3, 2, h.NO_NAME)})", "date": _first("text", h.DATES), "abn": _first("text", h.ABNS)} | {k: _SQL_OWN["business_receipt"][k] for k in ("receipt_number", "payment_method")} | _SHOP_TOLD,
    "tax_invoice": {"supplier_name": _first_line(5, 3, h.NO_SUPPLIER), "supplier_abn": _OWN_ABN} | {k: _SQL_OWN["tax_invoice"][k] for k in ("invoice_number", "invoice_date", "description", "customer_name")} | {k: v for k, v in _INVOICE_TOLD.items() if k != "highlight_amount"},
}
_GAP = "(ABS(total_amount - subtotal - gst_amount) > 0.10E0 AND total_amount - subtotal > 0 AND ABS(total_amount - subtotal - subtotal * 0.10E0) < ABS(gst_amount - subtotal * 0.10E0))"
_BOTH, _G0, _T0, _S0 = "(COALESCE(subtotal <> 0, FALSE) AND COALESCE(total_amount <> 0, FALSE))", "COALESCE(gst_amount <> 0, FALSE)", "COALESCE(total_amount <> 0, FALSE)", "COALESCE(subtotal <> 0, FALSE)"
_DERIVED = f"CASE WHEN {_BOTH} AND NOT {_G0}{{more}} THEN 'calculated_gst' WHEN {_BOTH} AND {_G0} AND {_GAP} THEN 'corrected_gst' WHEN NOT {_BOTH} AND {_S0} AND {_G0} AND NOT {_T0} THEN 'calculated_total'{{last}} END"
_WHY = {
    "fuel_receipt": "CASE WHEN litres * price_per_litre IS NOT NULL AND COALESCE(total_amount, 0) = 0 THEN 'calculated_total' WHEN COALESCE(total_amount, 0) <> 0 AND ABS(litres * price_per_litre - total_amount) > 2 AND litres * price_per_litre BETWEEN 5 AND 500 THEN 'corrected_from_calculation' END",
    "business_receipt": _DERIVED.format(more=" AND total_amount - subtotal > 0", last=f" WHEN NOT {_T0} AND listed IS NOT NULL AND NOT ({_S0} AND {_G0}) THEN 'estimated_from_items'"),
    "tax_invoice": _DERIVED.format(more="", last=""),
}
_MENDED = {
    "fuel_receipt": {"total_amount": "CASE WHEN correction IS NOT NULL THEN litres * price_per_litre ELSE total_amount END"},
    "business_receipt": {"gst_amount": "CASE WHEN correction IN ('calculated_gst', 'corrected_gst') THEN total_amount - subtotal ELSE gst_amount END", "total_amount": "CASE correction WHEN 'calculated_total' THEN subtotal + gst_amount WHEN 'estimated_from_items' THEN listed * 1.10E0 ELSE total_amount END"},
}
_MENDED["tax_invoice"] = _MENDED["business_receipt"] | {"total_amount": "CASE WHEN correction = 'calculated_total' THEN subtotal + gst_amount ELSE total_amount END"}


def _enriched_sql(kind: str, names: list[str]) -> str:
    told = _TOLD[kind]
    last = "{0} IS NOT NULL" if kind == "bank_statement" else "{0} IS NOT NULL AND confidence > 0.7"
    picks = ", ".join(f"ARG_MIN({k}, ord) FILTER ({k} IS NOT NULL) AS first_{k}, ARG_MAX({k}, ord) FILTER ({last.format(k)}) AS last_{k}" for k in told)
    fields = []
    for k in told:
        priority = k in h.PRIORITY.get(kind, [])
        if k == "highlight_amount":
            fields.append(f"first_{k} AS {k}")
        elif kind == "bank_statement":
            fields.append(f"COALESCE(last_{k}, {k}) AS {k}")
        else:
            kept = f"CASE WHEN {_is_there(k)} THEN {k} ELSE first_{k} END"
            fields.append(f"COALESCE(last_{k}, {kept}) AS {k}" if priority else f"{kept} AS {k}")
    shown = "MAX(CASE WHEN CONTAINS(LOWER(text), 'tax invoice') OR CONTAINS(LOWER(text), 'gst invoice') THEN TRUE END) AS tax_invoice_indicator"
    more = ["tax_invoice_indicator"] if kind == "tax_invoice" else ["listed"] if kind == "business_receipt" else []
    why = f", e AS (SELECT *, {_WHY[kind]} AS correction FROM d)" if kind in _WHY else ", e AS (SELECT * FROM d)"
    out = []
    for n in names:
        e = _MENDED.get(kind, {}).get(n, n)
        out.append(f"ROUND({e}, 6) AS {n}" if n in _FIGURES or n == "highlight_amount" else f"{e} AS {n}")
    return (
        with_views("", "papers", "paper_highlights").rstrip()
        + f", {_raw(kind)}, t AS (SELECT doc_id, ord, confidence, text, {', '.join(f'{e} AS {k}' for k, e in told.items())} FROM paper_highlights WHERE doc_type = '{kind}'),"
        + f" g AS (SELECT doc_id, {picks}, {shown} FROM t GROUP BY doc_id),"
        + f" d AS (SELECT r.doc_id, {', '.join([*fields, *more])} FROM r LEFT JOIN g ON g.doc_id = r.doc_id){why}"
        + f" SELECT doc_id, {', '.join(out)} FROM e"
    )


ORACLES |= {
    "x70_statement_highlights": _enriched_sql("bank_statement", _ENRICHED["bank_statement"]),
    "x67_fuel_highlights": _enriched_sql("fuel_receipt", _ENRICHED["fuel_receipt"]),
    "x68_receipt_highlights": _enriched_sql("business_receipt", _ENRICHED["business_receipt"]),
    "x69_invoice_highlights": _enriched_sql("tax_invoice", _ENRICHED["tax_invoice"]),
}
