"""Queries over bank transactions and statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxloom.operators import banking as b
from taxloom.plans.result_queries import rounded
from taxloom.sources.views import view, with_views


def _txns(spark, d):
    return view(spark, d, "bank_txns").withColumn("amount", F.col("cents") / 100)


def work_expenses(spark, d):
    rows = b.categorized(_txns(spark, d))
    out = rows.select("event_id", "category", "ato_category", "work_score", "confidence", F.array_join("indicators", ",").alias("indicators"))
    return rounded(out, "work_score", "confidence")


def expense_dedup(spark, d):
    rows = b.deduplicated(b.categorized(_txns(spark, d)), ["statement_id"])
    return rows.select("statement_id", "event_id", "date", "description", "amount")


def expense_summary(spark, d):
    return rounded(b.expense_summary(b.categorized(_txns(spark, d))), "average_confidence")


def transaction_patterns(spark, d):
    return rounded(b.patterns(_txns(spark, d), ["statement_id"]), "average_confidence", "work_percentage")


def statement_lines(spark, d):
    """Statements of a user's month are built from the transactions as text and read back line by line."""
    cents = F.abs("cents")
    money = F.concat(F.when(F.col("cents") < 0, "-").otherwise("+"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    line = F.concat_ws("  ", "date", "description", money)
    month = F.concat_ws("-", F.substring("date", 7, 4), F.substring("date", 4, 2))
    of = F.concat_ws("/", F.col("statement_id").cast("string"), month).alias("id")
    texts = _txns(spark, d).groupBy(of).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return b.statement_lines(texts).select("id", F.col("line").cast("long").alias("line"), "date", "description", "amount")


_TX = with_views("", "bank_txns").rstrip() + ", t AS (SELECT *, CAST(cents AS DOUBLE) / 100 AS amount, LOWER(description) AS d FROM bank_txns)"
_HITS = " UNION ALL ".join(f"SELECT event_id, {k} AS k, '{c}' AS category, {w}E0 AS w, '{a}' AS ato FROM debits WHERE REGEXP_MATCHES(d, '\\b(?:{p})\\b')" for k, (c, p, w, a) in enumerate(b.CATEGORIES))
_WORDS = " + ".join(f"CASE WHEN d LIKE '%{w}%' THEN 1 ELSE 0 END" for w in b.BUSINESS_WORDS)
_NAMES = ", ".join(f"CASE WHEN d LIKE '%{w}%' THEN '{w}' END" for w in b.BUSINESS_WORDS)
_EXP = _TX + f""", debits AS (SELECT * FROM t WHERE cents < 0), hits AS ({_HITS}),
 best AS (SELECT event_id, category, w, ato FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY w DESC, k) AS place FROM hits) h WHERE place = 1),
 scored AS (SELECT x.*, COALESCE(y.category, 'other') AS category, COALESCE(y.ato, 'Other business expenses') AS ato_category, COALESCE(y.w, 0) + LEAST(0.1E0 * ({_WORDS}), 0.3E0) AS work_score, CONCAT_WS(',', {_NAMES}) AS indicators FROM debits x LEFT JOIN best y ON y.event_id = x.event_id),
 expenses AS (SELECT * EXCLUDE (confidence), LEAST(work_score, 1.0E0) AS confidence FROM scored WHERE ROUND(work_score, 9) >= 0.3) """

QUERIES = {
    "b1_work_expenses": work_expenses,
    "r4_expense_dedup": expense_dedup,
    "g19_expense_summary": expense_summary,
    "g21_transaction_patterns": transaction_patterns,
    "x20_statement_lines": statement_lines,
}

ORACLES = {
    "b1_work_expenses": _EXP + "SELECT event_id, category, ato_category, ROUND(work_score, 6) AS work_score, ROUND(confidence, 6) AS confidence, indicators FROM expenses",
    "r4_expense_dedup": _EXP + "SELECT statement_id, event_id, date, description, amount FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY statement_id, date, SUBSTR(description, 1, 20), ABS(amount) ORDER BY ord) AS copy FROM expenses) u WHERE copy = 1",
    "g19_expense_summary": _EXP + "SELECT NULL AS category, NULL AS ato_category, COUNT(*) AS n, CAST(SUM(-cents) AS DOUBLE) / 100 AS total_amount, ROUND(AVG(confidence), 6) AS average_confidence FROM expenses UNION ALL SELECT category, NULL, COUNT(*), CAST(SUM(-cents) AS DOUBLE) / 100, ROUND(AVG(confidence), 6) FROM expenses GROUP BY category UNION ALL SELECT NULL, ato_category, COUNT(*), CAST(SUM(-cents) AS DOUBLE) / 100, ROUND(AVG(confidence), 6) FROM expenses GROUP BY ato_category",
    "g21_transaction_patterns": _TX + f", w AS (SELECT *, REGEXP_MATCHES(d, '{'|'.join(b.PATTERN_WORDS)}') AS work FROM t) SELECT statement_id, COUNT(*) AS total, COUNT(CASE WHEN cents < 0 THEN 1 END) AS debits, COUNT(CASE WHEN cents >= 0 THEN 1 END) AS credits, CAST(COALESCE(SUM(CASE WHEN cents < 0 THEN -cents END), 0) AS DOUBLE) / 100 AS debit_amount, CAST(COALESCE(SUM(CASE WHEN cents >= 0 THEN cents END), 0) AS DOUBLE) / 100 AS credit_amount, ROUND(AVG(confidence), 6) AS average_confidence, MIN(confidence) AS min_confidence, MAX(confidence) AS max_confidence, COUNT(CASE WHEN work THEN 1 END) AS work_count, ROUND(100.0E0 * COUNT(CASE WHEN work THEN 1 END) / COUNT(*), 6) AS work_percentage FROM w GROUP BY statement_id",
    "x20_statement_lines": _TX + ", m AS (SELECT *, CAST(statement_id AS VARCHAR) || '/' || SUBSTR(date, 7, 4) || '-' || SUBSTR(date, 4, 2) AS id FROM t) SELECT id, ROW_NUMBER() OVER (PARTITION BY id ORDER BY event_id) - 1 AS line, date, description, amount FROM m",
}
