"""Deterministic views over the driver's tables, in SQL that Spark and DuckDB both read.

The tables hold no tax documents, so the views derive them: amounts are built
from integer cents and dates from date parts, never by formatting floats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CENTS = "CAST(ROUND(o_totalprice * 100) AS BIGINT)"


def _money(cents: str) -> str:
    return f"CAST(CAST(FLOOR(({cents}) / 100) AS BIGINT) AS STRING) || '.' || LPAD(CAST(({cents}) % 100 AS STRING), 2, '0')"


_DATE = "LPAD(CAST(EXTRACT(day FROM o_orderdate) AS STRING), 2, '0') || '/' || LPAD(CAST(EXTRACT(month FROM o_orderdate) AS STRING), 2, '0') || '/' || CAST(EXTRACT(year FROM o_orderdate) AS STRING)"
_SUPPLIER = "CASE o_custkey % 6 WHEN 0 THEN 'Woolworths' WHEN 1 THEN 'Bunnings Warehouse' WHEN 2 THEN 'JB Hi-Fi' WHEN 3 THEN 'Shell' WHEN 4 THEN 'Officeworks' ELSE 'Corner Cafe ' || CAST(o_custkey % 17 AS STRING) END"
_ABN = "LPAD(CAST((o_custkey * 7919 + 51004085) * 97 % 100000000000 AS STRING), 11, '1')"
_TRUTH = {
    "supplier_name": _SUPPLIER,
    "date": _DATE,
    "total_amount": _money(_CENTS),
    "gst_amount": _money(f"CAST(FLOOR({_CENTS} / 11) AS BIGINT)"),
    "abn": _ABN,
    "invoice_number": "'INV-' || CAST(o_orderkey AS STRING)",
}
_FIELDS = list(_TRUTH)

_TRUTH_SQL = " UNION ALL ".join(f"SELECT o_orderkey AS doc_id, '{f}' AS field, {e} AS value, {k} AS k FROM orders" for k, (f, e) in enumerate(_TRUTH.items()))
#: Documents whose truth is missing, and fields that a model's reading garbles or leaves out.
_GROUND = f"SELECT doc_id, field, value, k FROM ({_TRUTH_SQL}) t WHERE doc_id % 13 <> 0 AND NOT (field = 'abn' AND doc_id % 5 = 0)"
_READ = f"""
SELECT m.model AS model, t.doc_id AS doc_id, t.field AS field,
  CASE (t.doc_id * 3 + t.k * 5 + m.ord * 2) % 9
    WHEN 0 THEN UPPER(t.value)
    WHEN 1 THEN CASE WHEN t.field IN ('total_amount', 'gst_amount') THEN '$' || t.value ELSE ' ' || t.value || ' ' END
    WHEN 2 THEN REPLACE(t.value, '/', '-')
    WHEN 3 THEN CASE WHEN t.field = 'abn' THEN SUBSTR(t.value, 1, 2) || ' ' || SUBSTR(t.value, 3, 3) || ' ' || SUBSTR(t.value, 6, 3) || ' ' || SUBSTR(t.value, 9, 3) ELSE t.value END
    WHEN 4 THEN SUBSTR(t.value, 1, LENGTH(t.value) - 1) || 'x'
    WHEN 5 THEN ''
    ELSE t.value END AS value,
  CAST((t.doc_id * 31 + t.k * 17 + m.ord * 7) % 100 AS DOUBLE) / 100 AS confidence
FROM ({_TRUTH_SQL}) t CROSS JOIN (SELECT 'internvl3' AS model, 0 AS ord UNION ALL SELECT 'llama32_vision' AS model, 1 AS ord) m
WHERE (t.doc_id + t.k * 3 + m.ord) % 10 <> 0"""

_RESULTS = """
SELECT o_orderkey AS doc_id, o_orderkey AS position,
  CASE o_orderkey % 3 WHEN 0 THEN 'internvl3' WHEN 1 THEN 'llama32_vision' ELSE 'rule_engine' END AS model,
  o_orderkey % 11 <> 0 AS success,
  CASE WHEN o_orderkey % 11 <> 0 OR o_custkey % 4 = 3 THEN NULL WHEN o_custkey % 4 = 0 THEN 'TimeoutError: no answer' WHEN o_custkey % 4 = 1 THEN 'ValueError: empty: text' ELSE 'out of memory' END AS error,
  CAST((o_custkey * 37 + o_orderkey * 11) % 1001 AS DOUBLE) / 1000 AS confidence_score,
  CAST((o_custkey * 13 + o_orderkey * 29) % 1001 AS DOUBLE) / 1000 AS ato_compliance_score,
  CAST((o_orderkey * 7) % 401 + 600 AS DOUBLE) / 1000 AS precision_score,
  CAST((o_orderkey * 5) % 501 + 500 AS DOUBLE) / 1000 AS recall_score,
  CAST((o_orderkey * 3) % 451 + 550 AS DOUBLE) / 1000 AS f1_score,
  CAST((o_orderkey % 3) * 800 + (o_custkey * 17) % 1900 + 100 AS DOUBLE) / 1000 AS processing_time,
  (o_custkey * 37 + o_orderkey * 11) % 1001 >= 700 AS production_ready,
  o_orderkey % 7 = 0 AS awk_fallback_used,
  CAST(o_custkey % 4 AS INT) AS highlights_detected
FROM orders"""

_PHRASES = ["BP Fuel Station", "Wilson Parking Flinders St", "Uber Trip to Airport", "Officeworks Supplies", "McDonald''s Lunch", "Salary Payment", "Deloitte Consulting Fee", "Telstra Phone Bill", "CityLink Toll", "Hilton Hotel Sydney", "NRMA Insurance", "Client Meeting Conference Training", "Monthly Bank Fee Charges", "Laptop Software License", "Grocery Store", "Office Project Contract Service"]
_TXNS = f"""
SELECT event_id, user_id AS statement_id, event_id AS ord,
  LPAD(CAST(EXTRACT(day FROM ts) AS STRING), 2, '0') || '/' || LPAD(CAST(EXTRACT(month FROM ts) AS STRING), 2, '0') || '/' || CAST(EXTRACT(year FROM ts) AS STRING) AS date,
  CASE event_id % 16 {' '.join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(_PHRASES[:-1]))} ELSE '{_PHRASES[-1]}' END AS description,
  CASE WHEN event_type IN ('purchase', 'error', 'click') THEN -1 ELSE 1 END * CAST((event_id * 7919) % 99990 + 10 AS BIGINT) AS cents,
  CAST((event_id * 31) % 101 AS DOUBLE) / 100 AS confidence
FROM events"""

_BSB = """
SELECT c_custkey AS id,
  CASE c_custkey % 7
    WHEN 0 THEN LPAD(CAST(c_custkey * 7919 % 1000000 AS STRING), 6, '0')
    WHEN 1 THEN LPAD(CAST(c_custkey * 31 % 1000 AS STRING), 3, '0') || '-' || LPAD(CAST(c_custkey % 1000 AS STRING), 3, '0')
    WHEN 2 THEN LPAD(CAST(c_custkey * 13 % 1000 AS STRING), 3, '0') || ' ' || LPAD(CAST(c_custkey % 1000 AS STRING), 3, '0')
    WHEN 3 THEN CASE WHEN c_custkey % 2 = 0 THEN '123456' ELSE '000-000' END
    WHEN 4 THEN LPAD(CAST(c_custkey * 17 % 100000 AS STRING), 5, '0')
    WHEN 5 THEN LPAD(CAST(c_custkey * 101 % 10000000 AS STRING), 7, '6')
    ELSE CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'none' ELSE LPAD(CAST(60 + c_custkey % 20 AS STRING), 3, '0') || '001' END END AS bsb
FROM customer"""

_ABNS = """
SELECT s_suppkey AS id,
  CASE s_suppkey % 6
    WHEN 0 THEN '88 000 014 675' WHEN 1 THEN '51 004 085 616' WHEN 2 THEN LPAD(CAST(s_suppkey * 104729 % 100000000000 AS STRING), 11, '3')
    WHEN 3 THEN CAST(s_suppkey * 7919 AS STRING) WHEN 4 THEN '64067190' || LPAD(CAST(s_suppkey % 1000 AS STRING), 3, '0') ELSE ' ' END AS abn
FROM supplier"""

_LINES = """
SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS id,
  CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents, l_shipdate,
  CAST(EXTRACT(day FROM l_shipdate) AS INT) AS d, CAST(EXTRACT(month FROM l_shipdate) AS INT) AS m, CAST(EXTRACT(year FROM l_shipdate) AS INT) AS y
FROM lineitem"""
_DATES = f"""
SELECT id, CASE id % 8
    WHEN 0 THEN LPAD(CAST(d AS STRING), 2, '0') || '/' || LPAD(CAST(m AS STRING), 2, '0') || '/' || CAST(y AS STRING)
    WHEN 1 THEN CAST(d AS STRING) || '-' || CAST(m AS STRING) || '-' || CAST(y AS STRING)
    WHEN 2 THEN CAST(d AS STRING) || '.' || LPAD(CAST(m AS STRING), 2, '0') || '.' || CAST(y AS STRING)
    WHEN 3 THEN CAST(d AS STRING) || ' ' || CASE m WHEN 1 THEN 'Jan' WHEN 2 THEN 'Feb' WHEN 3 THEN 'March' WHEN 4 THEN 'Apr' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'jul' WHEN 8 THEN 'August' WHEN 9 THEN 'Sep' WHEN 10 THEN 'October' WHEN 11 THEN 'Nov' ELSE 'DEC' END || ' ' || CAST(y AS STRING)
    WHEN 4 THEN CAST(y AS STRING) || '/' || LPAD(CAST(m AS STRING), 2, '0') || '/' || LPAD(CAST(d AS STRING), 2, '0')
    WHEN 5 THEN CAST(d + 10 AS STRING) || '/' || CAST(m + 2 AS STRING) || '/' || CAST(y AS STRING)
    WHEN 6 THEN ' ' || LPAD(CAST(d AS STRING), 2, '0') || ' ' || LPAD(CAST(m AS STRING), 2, '0') || ' ' || CAST(y AS STRING)
    ELSE '29/02/' || CAST(y - (id % 2) * 60 AS STRING) END AS text
FROM ({_LINES}) l"""
_AMOUNTS = f"""
SELECT id, CASE id % 8
    WHEN 0 THEN '$' || CAST(CAST(FLOOR(cents / 100) AS BIGINT) AS STRING) || '.' || LPAD(CAST(cents % 100 AS STRING), 2, '0')
    WHEN 1 THEN CAST(CAST(FLOOR(cents / 100) AS BIGINT) % 900 + 1 AS STRING) || ',' || LPAD(CAST(cents % 1000 AS STRING), 3, '0') || '.5'
    WHEN 2 THEN '-' || CAST(cents % 977 AS STRING) || '.10'
    WHEN 3 THEN '$1,23.45' WHEN 4 THEN CAST(cents AS STRING) WHEN 5 THEN CAST(cents % 100 AS STRING) || '..67' WHEN 6 THEN '   ' ELSE ' $' || CAST(cents % 1000 AS STRING) || ' ' END AS text
FROM ({_LINES}) l"""
_GST = f"""
SELECT id, CAST(cents AS DOUBLE) / 100 AS subtotal,
  CASE id % 5 WHEN 0 THEN 0.0E0 WHEN 1 THEN CAST(CAST(FLOOR(cents / 10) AS BIGINT) AS DOUBLE) / 100 WHEN 2 THEN CAST(CAST(FLOOR((cents + 5) / 10) AS BIGINT) AS DOUBLE) / 100 WHEN 3 THEN -1.0E0 ELSE CAST(cents % 500 AS DOUBLE) / 100 END AS gst,
  CASE id % 5 WHEN 0 THEN CAST(cents AS DOUBLE) / 100 WHEN 2 THEN CAST(cents + CAST(FLOOR((cents + 5) / 10) AS BIGINT) AS DOUBLE) / 100 ELSE CAST(cents + CAST(FLOOR(cents / 10) AS BIGINT) AS DOUBLE) / 100 END AS total
FROM ({_LINES}) l"""

_PROMPTS = """
SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'fuel_receipt' WHEN 1 THEN 'tax_invoice' WHEN 2 THEN 'bank_statement' ELSE 'business_receipt' END AS doc_type,
  CASE event_type WHEN 'signup' THEN 'detailed' WHEN 'purchase' THEN 'step_by_step' WHEN 'view' THEN 'concise' WHEN 'click' THEN 'example_based' ELSE 'structured' END AS strategy,
  CASE WHEN event_type IN ('signup', 'view') AND user_id % 4 < 3 THEN CAST((event_id * 13 + user_id) % 51 + 50 AS DOUBLE) / 100 ELSE CAST((event_id * 13 + user_id) % 101 AS DOUBLE) / 100 END AS confidence,
  CASE WHEN event_type IN ('signup', 'view') AND user_id % 4 < 3 THEN CAST((event_id * 7 + user_id * 3) % 51 + 50 AS DOUBLE) / 100 ELSE CAST((event_id * 7 + user_id * 3) % 101 AS DOUBLE) / 100 END AS accuracy
FROM events"""

_HIGHLIGHTS = """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ord, CAST(l_partkey * 7 % 600 AS INT) AS x, CAST(l_suppkey * 13 % 900 AS INT) AS y,
  CAST(20 + l_partkey % 380 AS INT) AS width, CAST(10 + l_suppkey % 60 AS INT) AS height,
  CASE l_partkey % 5 WHEN 0 THEN 'yellow' WHEN 1 THEN 'green' WHEN 2 THEN 'pink' WHEN 3 THEN 'blue' ELSE 'orange' END AS color,
  CAST((l_partkey * 3 + l_suppkey) % 101 AS DOUBLE) / 100 AS confidence
FROM lineitem"""
_BOXES = """
SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ord, CAST(l_suppkey * 7 % 620 AS INT) AS x1, CAST(l_partkey * 11 % 900 AS INT) AS y1,
  CAST(l_suppkey * 7 % 620 + 15 + l_partkey % 90 AS INT) AS x2, CAST(l_partkey * 11 % 900 + 8 + l_suppkey % 20 AS INT) AS y2,
  'word' || CAST(l_partkey % 50 AS STRING) AS text, CAST((l_suppkey * 3 + l_partkey) % 101 AS DOUBLE) / 100 AS confidence
FROM lineitem"""

VIEWS = {
    "ground_truth": _GROUND,
    "extractions": _READ,
    "results": _RESULTS,
    "bank_txns": _TXNS,
    "bsb_inputs": _BSB,
    "abn_inputs": _ABNS,
    "date_inputs": _DATES,
    "amount_inputs": _AMOUNTS,
    "gst_inputs": _GST,
    "prompt_runs": _PROMPTS,
    "highlights": _HIGHLIGHTS,
    "ocr_boxes": _BOXES,
}
TABLES = ["customer", "supplier", "orders", "lineitem", "events", "conversations"]


#: Views whose texts cost far more to read than to move; their tables are dealt to all cores first.
COSTLY = {"receipts", "papers", "paper_highlights", "broken_receipts"}


def spread(df: DataFrame) -> DataFrame:
    """df dealt over twice as many partitions as there are cores, where it has fewer.

    For inputs of a few files or row groups before costly work on each row:
    what is moved should be narrow. Inputs with partitions enough stay as they are.
    """
    enough = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(enough) if df.rdd.getNumPartitions() < enough else df


#: Views of many and wide rows for each row of their table, and the column by which that is dealt out before they are made: joins and groups by it move nothing more.
GATHERED = {"page_marks": "l_orderkey", "page_words": "l_orderkey"}
#: Partitions of a gathered table for each one that is read, so that the rows made of it are sorted in memory.
_FINER = 32


def gathered(df: DataFrame, by: str) -> DataFrame:
    """df dealt out by a column, while its rows are few and narrow."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions")), _FINER * df.rdd.getNumPartitions()), by)


#: Views whose texts make a method longer than Java compiles where a whole stage is one method, and that length in bytes of bytecode.
LONG, COMPILED = {"page_marks", "page_words", "receipts", "broken_receipts"}, "8000"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the columns that a query uses are read.

    Sets spark.sql.codegen.hugeMethodLimit in the session, by the view named
    last: for LONG views a stage of a longer method runs as shorter ones, which
    Java compiles; others keep Spark's default, with which they are faster.
    """
    if name in LONG:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", COMPILED)
    else:
        spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    sql = VIEWS[name]
    frames = {}
    for t in TABLES:
        if f"FROM {t}" in sql:
            df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
            if name in COSTLY:
                df = spread(df.select(*[c for c in df.columns if c in sql]))
            if name in GATHERED:
                df = gathered(df.select(*[c for c in df.columns if c in sql]), GATHERED[name])
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
            frames[t] = df
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL in front of which the named views stand as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + sql

_NL = " || CHR(10) || "
_SUB = f"CAST(FLOOR({_CENTS} * 10 / 11) AS BIGINT)"
#: Receipt, fuel, invoice, statement and meal texts with what such papers say, made of each order's figures.
VIEWS["receipts"] = f"""
SELECT o_orderkey AS doc_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'business_receipt' WHEN 1 THEN 'fuel_receipt' WHEN 2 THEN 'tax_invoice' WHEN 3 THEN 'bank_statement' ELSE 'meal_receipt' END AS doc_type,
  CAST((o_custkey * 37 + o_orderkey * 11) % 1001 AS DOUBLE) / 1000 AS compliance_score,
  o_custkey % 4 = 0 AS highlights_detected,
  CASE WHEN o_custkey % 3 = 0 THEN 'STORE: ' ELSE 'Supplier: ' END || {_SUPPLIER}{_NL}
  CASE WHEN o_orderkey % 4 = 0 THEN 'DATE: ' || {_DATE} WHEN o_orderkey % 4 = 1 THEN 'Invoice date ' || {_DATE} WHEN o_orderkey % 4 = 2 THEN 'paid on ' || REPLACE({_DATE}, '/', '-') ELSE 'no day given' END{_NL}
  CASE WHEN o_custkey % 2 = 0 THEN 'ABN: ' || {_ABN} ELSE 'a.b.n. withheld' END{_NL}
  CASE o_orderkey % 5 WHEN 0 THEN 'RECEIPT: no #' || CAST(o_orderkey AS STRING) || ' Qty: ' || CAST(o_custkey % 9 AS STRING) || ' items purchase'
    WHEN 1 THEN 'Pump ' || CAST(o_custkey % 12 AS STRING) || ' ' || CAST(o_orderkey % 60 + 5 AS STRING) || '.5 litres at 18' || CAST(o_custkey % 10 AS STRING) || '.9 c/l Diesel: max'
    WHEN 2 THEN 'Tax Invoice Invoice Number: INV-' || CAST(o_orderkey AS STRING) || ' professional services consulting customer'
    WHEN 3 THEN 'Westpac account statement BSB: 03' || CAST(o_custkey % 10 AS STRING) || '-' || LPAD(CAST(o_custkey % 1000 AS STRING), 3, '0') || ' account number: ' || LPAD(CAST(o_custkey AS STRING), 8, '7') || ' opening balance closing balance'
    ELSE 'Table ' || CAST(o_custkey % 30 AS STRING) || ' cafe lunch covers 2 coffee Sydney' END{_NL}
  'SUBTOTAL: $' || {_money(_SUB)}{_NL}
  CASE WHEN o_orderkey % 7 = 0 THEN 'TAX: ' ELSE 'GST: $' END || {_money(f"{_CENTS} - {_SUB}")}{_NL}
  'TOTAL: $' || {_money(_CENTS)} AS text
FROM orders"""

#: Receipts of which some have no text, an odd type, or numbers and dates that are none.
VIEWS["broken_receipts"] = f"""
SELECT doc_id, CASE WHEN doc_id % 37 = 2 THEN 'poster' ELSE doc_type END AS doc_type, highlights_detected,
  CASE WHEN doc_id % 29 = 3 THEN NULL WHEN doc_id % 29 = 4 THEN '  ' WHEN doc_id % 29 = 5 THEN REPLACE(text, 'TOTAL: $', 'TOTAL: $1.2.') WHEN doc_id % 29 = 6 THEN REPLACE(text, 'TAX: ', 'TAX: ?') WHEN doc_id % 29 = 7 THEN REPLACE(text, '/', '/3') ELSE text END AS text
FROM ({VIEWS["receipts"]}) r"""


def _pick(by: str, *values: str) -> str:
    """One of the SQL values, by a number."""
    return f"CASE {by} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


_TOTAL = _money(_CENTS)
_NET, _TAX = _money(_SUB), _money(f"{_CENTS} - {_SUB}")
_DAY = "LPAD(CAST(o_custkey % 28 + 1 AS STRING), 2, '0')"
_STATEMENT = _NL.join([
    _pick("o_custkey", "'Westpac Banking Corporation'", "'ANZ'", "'CommBank everyday'", "'My Local Bank Ltd'", "'Statement of Account'", "'National Australia Bank'"),
    _pick("o_orderkey", "'Account holder: John Smith'", "'Customer: Li'", "'Mr Alan Jones'", "'holder unknown'"),
    _pick("o_custkey + o_orderkey", "'BSB: 032-' || LPAD(CAST(o_custkey % 1000 AS STRING), 3, '0')", "'bsb 732' || LPAD(CAST(o_custkey % 1000 AS STRING), 3, '0')", "'branch details on request'"),
    _pick("o_orderkey", "'Account number: ' || LPAD(CAST(o_custkey AS STRING), 8, '1')", "'Acc ' || LPAD(CAST(o_custkey AS STRING), 6, '2')", "'no account'"),
    _pick("o_custkey", f"'Statement period: 01/03/2024 to ' || {_DAY} || '/04/2024'", f"'From 1/2/2024' || CHR(10) || 'end: ' || {_DAY} || '/02/2024'", "'quarterly'"),
    _pick("o_orderkey + 1", f"'Opening balance: $' || {_TOTAL}", "'Balance brought forward 1,234.50'", "'Previous: -88.10'", "'n/a'"),
    f"{_DAY} || '/03/2024 ' || " + _pick("o_custkey", "'BP Fuel Station 12'", "'Officeworks office supplies'", "'Uber Trip to Airport'", "'Salary from Acme'", "'Training conference travel'") + f" || ' -$' || {_money('o_orderkey * 7919 % 99990 + 10')}",
    f"'05/03/2024 ' || " + _pick("o_orderkey", "'Coffee meeting lunch'", "'Interest earned'", "'Hotel Sydney'") + f" || ' ' || CASE WHEN o_custkey % 2 = 0 THEN '-' ELSE '' END || {_money('o_custkey * 31 % 9999 + 100')}",
    f"'Closing balance $' || CASE WHEN o_custkey % 9 = 0 THEN '1,200,000.00' ELSE {_NET} END",
    _pick("o_custkey", "'Account type: Savings'", "'business account'", "'-'"),
])
_FUEL = _NL.join([
    _pick("o_custkey", "'BP Connect'", "'Shell Coles Express'", "'Caltex'", "'Corner Fuel Depot'", "'12'", "'United Petroleum'"),
    _pick("o_orderkey", "'12 Main St Richmond VIC 3121'", "'Sydney NSW'", "'postcode 4000'", "'no address'"),
    _pick("o_custkey + o_orderkey", f"'DATE: ' || {_DATE}", f"'on ' || REPLACE({_DATE}, '/', '-')", f"'Date: ' || REPLACE({_DATE}, '/', '.')", "'undated'"),
    _pick("o_custkey", "'Unleaded 91'", "'Premium 98'", "'Diesel'", "'E10'", "'octane 95 grade'"),
    "CAST(o_orderkey % 70 + 1 AS STRING) || '.5 L @ $1.' || CAST(o_custkey % 90 + 10 AS STRING) || ' per litre'",
    _pick("o_orderkey + 2", "'Pump 4'", "'pump no 11'", "'self service'"),
    _pick("o_custkey", "'odometer: ' || CAST(o_orderkey % 900000 AS STRING)", "'rego: abc' || CAST(o_custkey % 1000 AS STRING)", "'XYZ 12A'", "'-'"),
    _pick("o_orderkey", f"'TOTAL: $' || {_money('o_orderkey * 7919 % 20000 + 100')}", "'TOTAL: 1.50'", "'paid'"),
    _pick("o_custkey + 1", f"'GST: $' || {_TAX}", "'abn 51 004 085 616'", "'12345678901'"),
])
_SHOP = _NL.join([
    _pick("o_custkey", "'WOOLWORTHS METRO'", "'** RECEIPT **'", "'JB HI-FI'", "'The Pen Shop'", "'mart 24'", "'Bunnings Warehouse'"),
    _pick("o_orderkey", "'Sydney store'", "'Store no 42 Box Hill'", "'ACT 2600'", "'7 King Street'", "'online'"),
    _pick("o_custkey + o_orderkey", f"'Date: ' || {_DATE}", f"REPLACE({_DATE}, '/', '-')", "'today'"),
    "'Blue pen pack ' || CAST(o_custkey % 20 + 1 AS STRING) || '.50'",
    _pick("o_orderkey", "'USB cable $19.95'", "'Coffee and biscuits 7.25'", "'Safety gloves $12'", "'Mystery thing 3.10'"),
    _pick("o_custkey", f"'Subtotal: $' || {_NET}", "'net amount 10.00'", "'-'"),
    _pick("o_orderkey", f"'GST: $' || {_TAX}", "'tax 1.00'", "'tax free'"),
    _pick("o_custkey", f"'TOTAL: $' || {_TOTAL}", f"'Total: ' || {_money('o_orderkey * 31 % 3000 + 50')}", "'see above'"),
    _pick("o_custkey + 3", "'paid by EFTPOS'", "'Payment: cash'", "'gift card 99'", "'Visa debit'", "'tender: zip'", "'account'"),
    _pick("o_orderkey + 1", "'Receipt no: R-' || CAST(o_orderkey AS STRING)", "'txn # T' || CAST(o_custkey AS STRING)", "'-'"),
    _pick("o_custkey", "'flybuys: 60141'", "'Everyday Rewards card: 93' || CAST(o_custkey AS STRING)", "'served by Anna'", "'till 7'", "'-'"),
    _pick("o_orderkey", "'savings: $2.50'", "'-$1.00 off'", "'-'"),
])
_INVOICE = _NL.join([
    _pick("o_custkey", "'TAX INVOICE'", "'Smith & Co Lawyers'", "'2024 invoice'", "'Acme Consulting Pty Ltd'"),
    _pick("o_orderkey", "'Level 2'", "'Brown Accountants'", "'1'"),
    _pick("o_custkey + o_orderkey", "'12 Hill Rd, Perth WA 6000'", "'PO Box 5'", "'phone 9999 1234'"),
    _pick("o_custkey", f"'ABN: ' || {_ABN}", "'ABN 51 004 085 616'", "'A.B.N. 88-000-014-675'", "'abn: 123'"),
    _pick("o_orderkey + 1", "'Invoice No: INV-' || CAST(o_orderkey AS STRING)", "'Invoice: A' || CAST(o_custkey AS STRING)", "'ref 1'"),
    _pick("o_custkey", f"'Invoice date: ' || {_DATE}", f"'issued ' || {_DATE}", "'undated'"),
    _pick("o_orderkey", "'Bill to: Jane Doe & Sons'", "'Customer: Big Client'", "'attn sales'"),
    _pick("o_custkey + 1", "'Description: web design, hosting.'", "'Services: legal advice'", "'misc'"),
    _pick("o_orderkey", f"'Subtotal: $' || {_NET}", f"'amount before gst ' || {_NET}", "'-'"),
    _pick("o_custkey", f"'GST: $' || {_TAX}", "'GST: $5.00'", "'-'"),
    _pick("o_orderkey + 2", f"'TOTAL: $' || {_TOTAL}", f"'Total: ' || {_TOTAL}", "'-'"),
    _pick("o_custkey", f"'Due date: ' || {_DATE}", f"'payable by ' || {_DATE}", "'-'"),
    _pick("o_orderkey", "'Payment terms: strictly monthly'", "'net 30 days'", "'Payment due on receipt'", "'due in 14 day'"),
])
_PAPER_TEXTS = {"bank_statement": _STATEMENT, "fuel_receipt": _FUEL, "business_receipt": _SHOP, "tax_invoice": _INVOICE}
#: Statements, fuel and shop receipts and invoices in the words that their handlers look for.
VIEWS["papers"] = "SELECT o_orderkey AS doc_id, " + _pick("o_orderkey", *[f"'{k}'" for k in _PAPER_TEXTS]) + " AS doc_type, " + _pick("o_orderkey", *_PAPER_TEXTS.values()) + " AS text FROM orders"
#: Up to three highlights of a paper.
VIEWS["paper_highlights"] = "SELECT o_orderkey AS doc_id, CAST(s.ord AS BIGINT) AS ord, " + _pick("o_orderkey", *[f"'{k}'" for k in _PAPER_TEXTS]) + " AS doc_type, CAST((o_custkey * 3 + o_orderkey + s.ord * 37) % 101 AS DOUBLE) / 100 AS confidence, " + _pick(
    "(o_orderkey * 2 + o_custkey + s.ord)",
    f"'Total: $' || {_TOTAL}",
    f"'GST $' || {_TAX}",
    f"'Subtotal ' || {_NET}",
    "'$45.60 sub'",
    "'Opening balance 900.00 closing balance 950.50'",
    f"'Tax Invoice' || CHR(10) || 'Invoice No: H' || CAST(o_orderkey AS STRING) || ' Date ' || {_DATE}",
    "'Diesel 40.5 L @ $1.85 per litre'",
    "'Coles receipt no R9 paid cash'",
    "'Pump 9'",
    "'nothing'",
) + " AS text FROM orders CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1 AS ord UNION ALL SELECT 2 AS ord) s WHERE (o_custkey + s.ord) % 2 = 0"


#: What models answer when asked for a paper's type, and pieces of statements as they are recognised.
VIEWS["answers"] = "SELECT o_orderkey AS doc_id, " + _pick(
    "(o_orderkey + o_custkey)",
    "'fuel_receipt'",
    "'It is a Tax Invoice.'",
    "'tax document, an invoice'",
    "'Bank Statement'",
    "'RECEIPT'",
    "'invoice'",
    "'from the bank'",
    "'cannot tell'",
    "'12.50 L of Diesel'",
    "'012-345 12345678'",
    "'petrol bill'",
    "'Opening Balance 12'",
    "'40 litres'",
) + " AS text FROM orders"
VIEWS["statement_readings"] = "SELECT user_id AS statement_id, event_id AS ord, " + _pick(
    "event_id",
    "'03/04/2024 Uber Trip $' || CAST(event_id % 900 + 10 AS STRING) || '.50 ref: U' || CAST(event_id AS STRING)",
    "'7 Mar 2024 BP Fuel 1,234.00 balance 99.10'",
    "'Account: ' || LPAD(CAST(user_id AS STRING), 8, '3') || ' 032-' || LPAD(CAST(event_id % 1000 AS STRING), 3, '0') || ' John Citizen Smith'",
    "'Balance: $' || CAST(event_id % 9000 AS STRING) || '.25'",
    "'--'",
    "'Client lunch'",
    "' x '",
    "'12-05-24 Officeworks paper 45.95 reference INV-9'",
) + " AS text FROM events"
#: Highlights of statements: what a marker left of the orders of the same customer.
VIEWS["statement_marks"] = "SELECT o_custkey AS statement_id, o_orderkey AS ord, " + _pick("(o_orderkey + o_custkey)", "'uber trip home'", "'Wilson Parking Flinders'", "'Telstra Phone'", "'bank'", "'Hotel bill Sydney'") + f" AS description, CAST(CAST(ROUND(o_totalprice * 100) AS BIGINT) AS STRING) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN 'yellow' ELSE 'green' END AS color FROM orders"


_MARK = "CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey"
_ROW_Y = "CASE WHEN l_partkey % 11 = 0 THEN 120 ELSE 180 + 95 * l_linenumber END + l_suppkey % 10"
#: Highlights of statement pages, some without a colour or confidence, and the words on them: rows of six and a few above.
VIEWS["page_marks"] = f"""
SELECT l_orderkey AS image_id, {_MARK} AS ord, CAST(20 + l_partkey % 30 AS INT) AS x, CAST({_ROW_Y} AS INT) AS y,
  CAST(CASE WHEN l_partkey % 9 = 0 THEN 150 ELSE 330 + l_partkey % 300 END AS INT) AS width, CAST(CASE WHEN l_suppkey % 8 = 0 THEN 12 ELSE 24 + l_suppkey % 50 END AS INT) AS height,
  CASE l_partkey % 6 WHEN 0 THEN 'yellow' WHEN 1 THEN 'green' WHEN 2 THEN 'Pink' WHEN 3 THEN 'blue' WHEN 4 THEN 'orange' END AS color,
  CASE WHEN l_suppkey % 13 <> 0 THEN CAST((l_partkey * 3 + l_suppkey) % 101 AS DOUBLE) / 100 END AS confidence
FROM lineitem"""
_WORDS_OF = _pick(
    "k",
    _pick("l_partkey", "LPAD(CAST(l_suppkey % 28 + 1 AS STRING), 2, '0') || '/03/2024'", "'7 Mar 2024'", "'12-05-24'", "'Date'", "' '"),
    _pick("l_suppkey", "'Uber Trip'", "'BP Fuel Station'", "'Officeworks supplies'", "'Client lunch restaurant'", "'Hotel Sydney conference'", "'Salary payment'", "'Description'", "'Balance of account'"),
    _pick("l_partkey + l_suppkey", "'$' || CAST(l_partkey % 900 + 10 AS STRING) || '.50'", "'1,234.00'", "'Amount'", "'$' || CAST(l_suppkey % 77 AS STRING)", "'45.95'", "'-'"),
    _pick("l_partkey + 1", "'ref: R' || CAST(l_suppkey AS STRING)", "'Account: ' || LPAD(CAST(l_suppkey AS STRING), 8, '3')", "'balance $' || CAST(l_partkey % 5000 AS STRING) || '.10'", "'032-' || LPAD(CAST(l_partkey % 1000 AS STRING), 3, '0')", "'x'"),
    _pick("l_linenumber", "'Statement of account'", "'BSB 732 ' || LPAD(CAST(l_suppkey % 1000 AS STRING), 3, '0')", "'Number ' || LPAD(CAST(l_partkey AS STRING), 9, '4')", "'John Citizen Smith'", "'Statement period March'", "'Page'", "'Mr Li'"),
    _pick("l_suppkey + l_partkey", "'Period'", "'Amount due'", "'Description'", "'Posting date'", "'word' || CAST(l_partkey % 50 AS STRING)", "'Mary Anne Jones'"),
)
_X1 = "CASE k WHEN 4 THEN 40 + l_partkey % 200 WHEN 5 THEN 400 + l_suppkey % 300 ELSE 30 + k * 70 + l_partkey % 20 END"
_Y1 = f"CASE k WHEN 4 THEN 15 + l_linenumber * 38 WHEN 5 THEN {_ROW_Y} - 40 ELSE {_ROW_Y} + 2 END"
VIEWS["page_words"] = f"""
SELECT image_id, ord, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x1 + wide AS INT) AS x2, CAST(y1 + high AS INT) AS y2, text, confidence FROM (
SELECT l_orderkey AS image_id, ({_MARK}) * 10 + k AS ord, {_X1} AS x1, {_Y1} AS y1, 50 + l_suppkey % 25 AS wide, 8 + l_partkey % 14 AS high, {_WORDS_OF} AS text, CAST((l_suppkey * 3 + l_partkey * 7 + k * 29) % 101 AS DOUBLE) / 100 AS confidence
FROM lineitem CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k UNION ALL SELECT 4 AS k UNION ALL SELECT 5 AS k) s) w"""

_ASKS = _pick("(conv_id + turn)", "'Extract all fields: '", "'Analyze this image. Requirements: extract the business name. Output format JSON. '", "'For Australian ATO compliance, process GST (10%) and ABN of the business. '", "'Give date as DD/MM/YYYY and ABN as XX XXX XXX XXX in a structure. '", "'tell me '", "'highlight the GST date abn. information: '")
_TOPIC = _pick("(conv_id * 3 + turn)", "'fuel petrol diesel litres station '", "'Tax Invoice ABN GST supplier '", "'receipt business items total '", "'bank statement transaction balance '", "'restaurant food meal '", "'hotel booking '", "'travel flight '", "'parking vehicle '", "'professional services consulting legal '", "'equipment tools '", "''")
#: Prompts whose names tell of a document type and whose texts are turns of conversations.
VIEWS["prompts"] = f"""
SELECT LPAD(CAST(conv_id AS STRING), 9, '0') || '_' || LPAD(CAST(turn AS STRING), 4, '0') || '_' || {_pick("(conv_id + turn * 2)", "'fuel'", "'TAX_INVOICE'", "'business'", "'bank'", "'meal'", "'accommodation'", "'travel'", "'toll'", "'professional'", "'supplies'", "'general'")} AS prompt_id,
  CASE WHEN (conv_id + turn) % 17 = 0 THEN NULL WHEN (conv_id + turn) % 13 = 0 THEN 'short' ELSE {_ASKS} || {_TOPIC} || text END AS text
FROM conversations"""
#: Receipts with what a model answered about them, and how well they were read before.
VIEWS["asked"] = "SELECT o_orderkey AS doc_id, " + _pick("o_orderkey", "'business_receipt'", "'fuel_receipt'", "'tax_invoice'", "'bank_statement'", "'meal_receipt'", "'other'") + " AS doc_type, " + _pick("(o_custkey + o_orderkey)", "'It is from Caltex, diesel'", "NULL", "'Bunnings shop'", "'Hilton hotel, 2 nights'", "'a Tax Invoice for consulting'", "'cafe lunch'", "'parking fee'", "'a laptop'", "'something'", "''") + """ AS response,
  CASE o_custkey % 2 WHEN 0 THEN 'internvl3' ELSE 'llama32_vision' END AS model, o_custkey % 3 = 0 AS highlights, CAST((o_custkey * 37 + o_orderkey * 11) % 101 AS DOUBLE) / 100 AS quality, o_orderkey % 4 <> 0 AS prefer
FROM orders"""
