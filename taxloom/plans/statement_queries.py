"""Queries over bank statement pages: what is read in highlights, and what pages tell from end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxloom.operators import statement_pages as sp
from taxloom.operators import texts as tx
from taxloom.plans.handler_queries import _q
from taxloom.plans.reading_queries import _CONTENT, _DAY, _LARGEST, _LONGEST, _REF, _REST, _VALID, _any
from taxloom.plans.result_queries import rounded
from taxloom.sources.views import view, with_views


def _marks(spark, d):
    return sp.with_defaults(view(spark, d, "page_marks"))


def _words(spark, d):
    return view(spark, d, "page_words")


def _read(spark, d):
    return sp.recognised(sp.spatial.statement_highlights(_marks(spark, d)), _words(spark, d))


def readings(spark, d):
    """What is read on each page, and how surely, by words and by characters."""
    words = _words(spark, d).withColumnRenamed("ord", "b_ord")
    out = sp.readings(words, ["image_id"], most=10_000)
    return rounded(out, "confidence", "weighted_confidence", places=12)


def transactions(spark, d):
    return rounded(sp.transactions(_read(spark, d)), "amount", "confidence")


def work(spark, d):
    out = sp.work_highlights(_read(spark, d), sp.WORK)
    return rounded(out.withColumn("indicators", F.array_join("indicators", ",")), "score")


def work_summary(spark, d):
    return rounded(sp.work_summary(sp.work_highlights(_read(spark, d))), "average_score")


def layout(spark, d):
    return rounded(sp.row_layout(_marks(spark, d), _words(spark, d)), "coverage")


def pages(spark, d):
    out = sp.pages(view(spark, d, "page_marks"), _words(spark, d))
    return rounded(out, "balance", "best_work", "likelihood", "row_coverage", "head_coverage")


QUERIES = {
    "g32_readings": readings,
    "e10_transactions": transactions,
    "r5_work_highlights": work,
    "g20_work_summary": work_summary,
    "b27_row_layout": layout,
    "e10_statement_pages": pages,
}

_STRIPPED = "TRIM(text, ' ' || CHR(9) || CHR(10) || CHR(13) || CHR(11) || CHR(12))"
_SURE = f"(confidence >= 0.5 AND {_STRIPPED} <> '')"
_BASE = (
    with_views("", "page_marks", "page_words").rstrip()
    + f""", marks AS (SELECT image_id, ord AS h_ord, x, y, width, height, x + width AS hx2, y + height AS hy2, COALESCE(color, 'unknown') AS color, COALESCE(confidence, 0) AS h_confidence FROM page_marks),
 pairs AS (SELECT m.*, w.ord AS b_ord, x1, y1, x2, y2, text, confidence, NOT (hx2 < x1 OR x2 < x OR hy2 < y1 OR y2 < y) AS touch, GREATEST(LEAST(hx2, x2) - GREATEST(x, x1), 0) * GREATEST(LEAST(hy2, y2) - GREATEST(y, y1), 0) AS shared,
  CAST(FLOOR((x1 + x2) / 2.0) AS BIGINT) AS cx, CAST(FLOOR((y1 + y2) / 2.0) AS BIGINT) AS cy, CAST(FLOOR(x + width / 2.0) AS BIGINT) AS hcx, CAST(FLOOR(y + height / 2.0) AS BIGINT) AS hcy FROM marks m JOIN page_words w ON w.image_id = m.image_id),
 joined AS (SELECT image_id, h_ord, STRING_AGG({_STRIPPED}, ' ' ORDER BY y1, x1, b_ord) AS text, AVG(confidence) AS confidence FROM pairs WHERE CAST(width AS DOUBLE) / height BETWEEN 1.5 AND 20 AND touch AND shared > 0.5 * (x2 - x1) * (y2 - y1) AND {_SURE} GROUP BY image_id, h_ord),
 heard AS (SELECT m.*, j.text, j.confidence FROM marks m JOIN joined j ON j.image_id = m.image_id AND j.h_ord = m.h_ord WHERE {_VALID.replace("text", "j.text")}),
 shaped AS (SELECT * FROM heard WHERE width >= 200 AND height BETWEEN 20 AND 100 AND CAST(width AS DOUBLE) / height BETWEEN 3 AND 25 AND y >= 200 AND h_confidence >= 0.4),
 moves AS (SELECT image_id, h_ord, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY y, h_ord) AS INT) AS place, {_DAY} AS date, CASE WHEN {_REST} = '' THEN 'Transaction' ELSE {_REST} END AS description, ABS({_LARGEST}) AS amount, {_REF} AS reference, CASE WHEN {_LARGEST} < 0 THEN 'debit' ELSE 'credit' END AS type, confidence FROM shaped WHERE {_LARGEST} IS NOT NULL),
 """
)
_DATE = "NULLIF(REGEXP_EXTRACT(text, '([0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4})', 1), '')"
_SUM = "NULLIF(REGEXP_EXTRACT(text, '([-+]?\\$?[0-9]+(?:\\.[0-9]{2})?)', 1), '')"
_KINDS = {c: "ROUND(0.3E0 * (" + " + ".join(f"CASE WHEN CONTAINS(LOWER(text), {_q(w)}) THEN 1 ELSE 0 END" for w in ws) + "), 9)" for c, ws in tx.WORK_CATEGORIES.items()}
_MOST = "GREATEST(" + ", ".join(_KINDS.values()) + ")"
_FOUND = "LIST_FILTER([" + ", ".join(f"CASE WHEN CONTAINS(LOWER(text), {_q(w)}) THEN {_q(w)} END" for w in tx.WORK_WORDS) + "], lambda w: w IS NOT NULL)"
_WORK = f"""scored AS (SELECT *, {_FOUND} AS found, {_MOST} AS most, CASE {" ".join(f"WHEN {_MOST} > 0 AND {e} = {_MOST} THEN '{c}'" for c, e in _KINDS.items())} END AS category, {_DATE} AS date, {_SUM} AS amount,
  TRIM(REPLACE(REPLACE(text, COALESCE({_DATE}, ''), ''), COALESCE({_SUM}, ''), '')) AS described FROM heard WHERE {_CONTENT} = 'transaction'),
 spent AS (SELECT *, ROUND(LEAST(LEAST(0.2E0 * LEN(found) + LEAST(most, 0.6E0), 1.0E0) + CASE LOWER(color) WHEN 'yellow' THEN 0.2E0 WHEN 'green' THEN 0.15E0 WHEN 'pink' THEN 0.1E0 WHEN 'blue' THEN 0.05E0 ELSE 0 END + CASE WHEN h_confidence > 0.8 THEN 0.1E0 WHEN h_confidence > 0.6 THEN 0.05E0 ELSE 0 END, 1.0E0), 9) AS score FROM scored WHERE COALESCE(date, amount, NULLIF(described, '')) IS NOT NULL)"""
_NAMES = lambda text, fields: " + ".join(f"CASE WHEN CONTAINS(LOWER({text}), '{f}') THEN {1 << i} ELSE 0 END" for i, f in enumerate(fields))
_ROWS = f"""near AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, h_ord ORDER BY (hcx - cx) * (hcx - cx) + (hcy - cy) * (hcy - cy), b_ord) AS place FROM pairs WHERE NOT touch AND cx BETWEEN GREATEST(x - 100, 0) AND hx2 + 100 AND cy BETWEEN GREATEST(y - 100, 0) AND hy2 + 100),
 named AS (SELECT image_id, h_ord, BIT_OR({_NAMES("text", sp.LAYOUT["transaction_row"]["fields"])}) AS mask FROM near WHERE place <= 10 GROUP BY image_id, h_ord),
 laid AS (SELECT m.image_id, m.h_ord, CASE WHEN height BETWEEN 20 AND 60 AND width BETWEEN 300 AND 2000 THEN 0.8E0 ELSE 0.3E0 END AS likelihood, COALESCE(mask, 0) AS mask FROM marks m LEFT JOIN named n ON n.image_id = m.image_id AND n.h_ord = m.h_ord)"""
_TOP = f"LIST_FILTER(REGEXP_EXTRACT_ALL(text, {_q(tx.HOLDER_FORM)}), lambda n: LENGTH(n) BETWEEN 10 AND 50)[1]"
_TOLD = lambda pattern: f"NULLIF(REGEXP_EXTRACT(text, {_q(pattern)}, 1), '')"
_LAST = lambda value: f"ARG_MAX({value}, h_ord) FILTER ({value} IS NOT NULL)"
_BALANCE = f"TRY_CAST(REPLACE({_TOLD(tx.READ_BALANCE)}, ',', '') AS DOUBLE)"

ORACLES = {
    "g32_readings": with_views(f"SELECT image_id, STRING_AGG({_STRIPPED}, ' ' ORDER BY y1, x1, ord) AS text, COUNT(*) AS words, ROUND(AVG(confidence), 12) AS confidence, ROUND(SUM(confidence * LENGTH(text)) / SUM(LENGTH(text)), 12) AS weighted_confidence FROM page_words WHERE {_SURE} GROUP BY image_id", "page_words"),
    "e10_transactions": _BASE + "done AS (SELECT 1) SELECT image_id, h_ord, place, date, description, ROUND(amount, 6) AS amount, reference, type, ROUND(confidence, 6) AS confidence FROM moves",
    "r5_work_highlights": _BASE + _WORK + " SELECT image_id, h_ord, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY score DESC, h_ord) AS INT) AS place, ROUND(score, 6) AS score, category, ARRAY_TO_STRING(found, ',') AS indicators, date, amount, described AS description, color FROM spent WHERE score >= 0.6",
    "g20_work_summary": _BASE + _WORK + ", w AS (SELECT COALESCE(category, 'other') AS category, color, score FROM spent) SELECT category, color, COUNT(*) AS n, COUNT(CASE WHEN score >= 0.6 THEN 1 END) AS work_expenses, ROUND(AVG(score), 6) AS average_score FROM w GROUP BY GROUPING SETS ((), (category), (color))",
    "b27_row_layout": _BASE + _ROWS + " SELECT image_id, h_ord, likelihood, mask, ROUND(BIT_COUNT(mask) / 3.0, 6) AS coverage FROM laid",
    "e10_statement_pages": _BASE
    + _WORK
    + ", "
    + _ROWS
    + f""", counted AS (SELECT image_id, COUNT(*) AS highlights, COUNT(CASE WHEN width >= 200 AND height BETWEEN 20 AND 100 AND CAST(width AS DOUBLE) / height BETWEEN 3 AND 20 AND y >= 200 AND h_confidence >= 0.4 THEN 1 END) AS rows FROM marks GROUP BY image_id),
 summed AS (SELECT image_id, COUNT(*) AS transactions, CAST(SUM(CAST(ROUND(amount * 100) AS BIGINT)) AS BIGINT) AS cents, ARG_MAX(description, place) AS lowest FROM moves GROUP BY image_id),
 tops AS (SELECT image_id, STRING_AGG({_STRIPPED}, ' ' ORDER BY y1, x1, ord) AS text FROM page_words WHERE y1 < 300 AND {_STRIPPED} <> '' GROUP BY image_id),
 held AS (SELECT image_id, NULLIF(REGEXP_EXTRACT(text, {_q(tx.BSB_FORM)}, 0), '') AS bsb, {_LONGEST} AS account_number, {_TOP} AS account_holder FROM tops),
 later AS (SELECT image_id, {_LAST(_TOLD(tx.READ_BSB))} AS bsb, {_LAST(_TOLD(tx.READ_ACCOUNT))} AS account_number, {_LAST(_BALANCE)} AS balance FROM shaped GROUP BY image_id),
 works AS (SELECT image_id, COUNT(*) AS work, COUNT(CASE WHEN score >= 0.6 THEN 1 END) AS sure_work, FIRST(described ORDER BY score DESC, h_ord) AS first_work, MAX(score) AS best_work FROM spent GROUP BY image_id),
 rowed AS (SELECT image_id, AVG(likelihood) AS likelihood, BIT_OR(mask) AS mask FROM laid GROUP BY image_id),
 heads AS (SELECT image_id, BIT_OR({_NAMES("text", sp.LAYOUT["header"]["fields"])}) AS mask FROM page_words WHERE y1 < 200 GROUP BY image_id)
 SELECT c.image_id, highlights, rows, COALESCE(transactions, 0) AS transactions, COALESCE(cents, 0) AS cents, lowest, COALESCE(l.bsb, h.bsb) AS bsb, COALESCE(l.account_number, h.account_number) AS account_number, account_holder, ROUND(balance, 6) AS balance,
  COALESCE(work, 0) AS work, COALESCE(sure_work, 0) AS sure_work, first_work, ROUND(best_work, 6) AS best_work, ROUND(likelihood, 6) AS likelihood, ROUND(BIT_COUNT(r.mask) / 3.0, 6) AS row_coverage, r.mask = 7 AS row_complete, ROUND(BIT_COUNT(COALESCE(e.mask, 0)) / 3.0, 6) AS head_coverage, COALESCE(e.mask, 0) = 7 AS head_complete
 FROM counted c LEFT JOIN summed s ON s.image_id = c.image_id LEFT JOIN held h ON h.image_id = c.image_id LEFT JOIN later l ON l.image_id = c.image_id LEFT JOIN works w ON w.image_id = c.image_id LEFT JOIN rowed r ON r.image_id = c.image_id LEFT JOIN heads e ON e.image_id = c.image_id""",
}
