"""Queries over models' answers, recognised text, fallback decisions and benchmark figures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from taxloom.operators import banking, batch, spatial
from taxloom.operators import classification as cl
from taxloom.operators import comparison as cmp
from taxloom.operators import evaluation as ev
from taxloom.operators import fallback as fb
from taxloom.operators import ordering
from taxloom.operators import texts as tx
from taxloom.plans.bank_queries import _EXP
from taxloom.plans.document_queries import _CLASS
from taxloom.plans.handler_queries import _q
from taxloom.plans.page_queries import _PAIRS
from taxloom.plans.result_queries import rounded
from taxloom.sources import documents, models
from taxloom.sources.views import view, with_views


def answers(how):
    def run(spark, d):
        return view(spark, d, "answers").withColumn("v", how(F.col("text"))).select("doc_id", "v.*")

    return run


def line_transactions(spark, d):
    rows = view(spark, d, "statement_readings").withColumn("t", tx.line_transaction(F.col("text"))).filter("t is not null")
    return rounded(rows.select("ord", "t.*"), "amount")


def account_texts(spark, d):
    return view(spark, d, "statement_readings").select("ord", tx.valid_text(F.col("text")).alias("valid"), tx.account_text(F.col("text")).alias("a")).select("ord", "valid", "a.*")


def read_transactions(spark, d):
    rows = view(spark, d, "statement_readings").filter(tx.valid_text(F.col("text"))).withColumns({"t": tx.read_transaction(F.col("text")), "a": tx.read_account(F.col("text"))})
    return rows.select("ord", "t.amount", "t.date", "t.description", "a.bsb", "a.account_number", "a.balance")


def roll_up(spark, d):
    return tx.statement_roll_up(view(spark, d, "statement_readings"))


def bank_names(spark, d):
    """Banks as statements write them in their first line, and what the tables of banks say of them."""
    written = F.substring_index("text", "\n", 1).alias("name")
    rows = view(spark, d, "papers").filter("doc_type = 'bank_statement'").groupBy(written).agg(F.count("*").alias("papers"))
    return rows.select("name", "papers", tx.bank_category(F.col("name")).alias("category"), tx.is_big_four(F.col("name")).alias("big_four"), tx.bank_ranges(F.col("name")).alias("ranges"))


def _maps(spark, d):
    rows = view(spark, d, "extractions")
    return rows.groupBy("model", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def fallback_decisions(spark, d):
    f = F.col("fields")
    return _maps(spark, d).select("model", "doc_id", fb.issues(fb.data(f)).alias("issues"), fb.meaningless(fb.data(f)).alias("meaningless"), fb.insufficient(f).alias("insufficient"), fb.preliminary_grade(f).alias("grade"))


def ato_scores(spark, d):
    return rounded(ev.ato_scores(view(spark, d, "extractions"), view(spark, d, "ground_truth")), "ato_score")


def benchmark_overall(spark, d):
    out = ev.benchmark_overall(view(spark, d, "results"))
    return rounded(out, "average_f1", "success_rate", "avg_processing_time", "total_processing_time")


def benchmark_summary(spark, d):
    out = ev.benchmark_summary(ev.benchmark_overall(view(spark, d, "results")))
    return rounded(out, "best_f1_score", "worst_f1_score", "average_f1_score", "fastest_avg_time", "slowest_avg_time")


def ranked_with_benchmark(spark, d):
    """The model ranking beside each model's benchmark figures."""
    rank = view(spark, d, "results").groupBy("model").agg(F.avg("confidence_score").alias("confidence"))
    bench = ev.benchmark_overall(view(spark, d, "results")).select("model", "average_f1", "success_rate")
    return rounded(rank.join(bench, "model", "left"), "confidence", "average_f1", "success_rate")


def evidence(spark, d):
    rows = cl.evidence(view(spark, d, "receipts"))
    return rows.select("doc_id", "predicted", F.array_join("evidence", "; ").alias("evidence"), "confident", "production_ready")


def highlight_contents(spark, d):
    rows = view(spark, d, "statement_readings")
    return rows.select("ord", tx.content(F.col("text")).alias("content"), tx.fuel_after_all(F.col("text")).alias("fuel"))


def balanced_transactions(spark, d):
    """Statement readings two on a line, each with a balance behind it, read back."""
    line = lambda c: F.concat("date", F.lit(" "), "description", F.lit(" $"), c, F.lit(" "), F.lit("1"), c)
    cents = F.concat(F.pmod("cents", F.lit(977)).cast("string"), F.lit(".25"))
    rows = view(spark, d, "bank_txns").select(F.col("event_id").alias("id"), F.concat(line(cents), F.lit(" ; "), line(cents), F.lit("\n"), F.lit("end")).alias("text"))
    return tx.balanced_transactions(rows)


def fuel_details(spark, d):
    rows = view(spark, d, "papers").filter("doc_type = 'fuel_receipt'")
    return rows.select("doc_id", tx.fuel_details(F.concat("text", F.lit("\nLocation: Depot "), F.col("doc_id").cast("string"))).alias("d")).select("doc_id", "d.*")


def metric_winners(spark, d):
    """Which of two models does better on each document's figures."""
    rows = view(spark, d, "results").groupBy("model").agg(F.avg("confidence_score").alias("confidence_score"), F.avg("processing_time").alias("processing_time"), F.avg("ato_compliance_score").alias("ato_compliance_score"), F.avg(F.col("production_ready").cast("int")).alias("production_ready"))
    return rounded(cmp.metric_winners(rows, "internvl3", "llama32_vision"), "a", "b")


def model_grades(spark, d):
    return batch.dataset_metrics(view(spark, d, "results")).select("model", cmp.production_grade(F.col("production_ready_rate")).alias("grade"))


def ordered_expenses(spark, d):
    """Work expenses without duplicates in the order of their confidence."""
    t = view(spark, d, "bank_txns").withColumn("amount", F.col("cents") / 100).drop("confidence")
    out = banking.deduplicated(banking.categorized(t), ["statement_id"])
    place = F.row_number().over(Window.partitionBy("statement_id").orderBy(F.desc(F.round("confidence", 9)), "ord"))
    return out.select("statement_id", "ord", "category", place.alias("place"))


def submission_order(spark, d):
    """Results with the place at which they were asked for, among those of their model."""
    return ordering.places(view(spark, d, "results").select("model", "doc_id", "success", "position"), "model", "position").drop("position")


def rows_from_the_top(spark, d):
    """Transaction rows of each page from top to bottom, and where they stand on a page of 1000 by 1000."""
    rows = spatial.transaction_rows(view(spark, d, "highlights"))
    w = Window.partitionBy("image_id").orderBy("y", "ord")
    part = lambda c: (F.col(c) / 1000).alias(f"relative_{c}")
    return rows.select("image_id", "ord", F.row_number().over(w).alias("place"), *map(part, ("x", "y", "width", "height")))


def ordered_correlations(spark, d):
    """The highlights of each page in the order of how well they go with their text."""
    rows = spatial.correlations(view(spark, d, "highlights"), view(spark, d, "ocr_boxes"))
    w = Window.partitionBy("image_id").orderBy(F.desc(F.round("correlation", 9)), "h_ord")
    return rows.select("image_id", "h_ord", F.row_number().over(w).alias("place"))


def model_answers(spark, d):
    """What a placeholder model answers to receipts, an error for those without a text."""
    out = models.asked(view(spark, d, "broken_receipts").select("doc_id", "text"), lambda: models.placeholder)
    return rounded(out.select("doc_id", "text", "confidence", "error"), "confidence")


def result_texts(spark, d):
    """Each reading of a document as lines of its fields."""
    rows = view(spark, d, "extractions").groupBy("model", "doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("extracted_fields"))
    return documents.result_text(rows, F.concat_ws("/", "model", F.col("doc_id").cast("string")))


QUERIES = {
    "u2_model_answers": model_answers,
    "k4_result_texts": result_texts,
    "c6_answer_types": answers(tx.classify_answer),
    "c7_plain_answer_types": answers(tx.classify_answer_plainly),
    "b11_line_transactions": line_transactions,
    "b13_account_texts": account_texts,
    "b14_read_transactions": read_transactions,
    "b16_statement_roll_up": roll_up,
    "j17_bank_names": bank_names,
    "v30_fallback_decisions": fallback_decisions,
    "a9_ato_scores": ato_scores,
    "g17_benchmark_overall": benchmark_overall,
    "r2_benchmark_summary": benchmark_summary,
    "j15_ranking_with_benchmark": ranked_with_benchmark,
    "c3_evidence": evidence,
    "c16_highlight_contents": highlight_contents,
    "x8_balanced_transactions": balanced_transactions,
    "x9_fuel_details": fuel_details,
    "j14_metric_winners": metric_winners,
    "d5_model_grades": model_grades,
    "r3_ordered_expenses": ordered_expenses,
    "r8_submission_order": submission_order,
    "r6_rows_from_the_top": rows_from_the_top,
    "r12_ordered_correlations": ordered_correlations,
}


def _any(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"CONTAINS({low}, {_q(w)})" for w in words) + ")"


def _answers(branches: list[tuple[str, str, float]]) -> str:
    kind = "CASE " + " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in branches) + " ELSE 'unknown' END"
    sure = "CASE " + " ".join(f"WHEN {c} THEN {v}E0" for c, _, v in branches) + " ELSE 0.5E0 END"
    return with_views(f"SELECT doc_id, kind AS document_type, sure AS confidence, kind <> 'unknown' AND sure > 0.7 AS is_business_document FROM (SELECT doc_id, {kind} AS kind, {sure} AS sure FROM (SELECT doc_id, LOWER(text) AS low FROM answers) a) b", "answers")


_SAYS = lambda *w: _any("low", list(w))
_FULL = [
    (_SAYS("fuel_receipt", "fuel receipt"), "fuel_receipt", 0.90),
    (f"({_any('low', tx.FUEL_SIGNS)} OR REGEXP_MATCHES(low, {_q(tx.FUEL_QUANTITY)}))", "fuel_receipt", 0.95),
    (_SAYS("fuel", "petrol"), "fuel_receipt", 0.85),
    (_SAYS("tax_invoice", "tax invoice"), "tax_invoice", 0.85),
    ("(CONTAINS(low, 'tax') AND CONTAINS(low, 'invoice'))", "tax_invoice", 0.80),
    (_SAYS("bank_statement", "bank statement"), "bank_statement", 0.90),
    (f"({_any('low', tx.BANK_SIGNS)} OR REGEXP_MATCHES(low, {_q(tx.BANK_ACCOUNT)}))", "bank_statement", 0.95),
    (_SAYS("bank"), "bank_statement", 0.75),
    (_SAYS("receipt"), "receipt", 0.75),
    (_SAYS("invoice"), "tax_invoice", 0.70),
]
_PLAIN = [(_SAYS("fuel_receipt", "fuel receipt"), "fuel_receipt", 0.90), (_SAYS("tax_invoice", "tax invoice"), "tax_invoice", 0.85), (_SAYS("bank_statement", "bank statement"), "bank_statement", 0.85), (_SAYS("receipt"), "receipt", 0.75), (_SAYS("invoice"), "tax_invoice", 0.70)]
_TRIMMED = "TRIM(text, ' ' || CHR(9) || CHR(10) || CHR(13) || CHR(11) || CHR(12))"
_VALID = f"(LENGTH({_TRIMMED}) BETWEEN 2 AND 200 AND REGEXP_MATCHES({_TRIMMED}, '[a-zA-Z0-9]'))"
_BARE = "CAST(REGEXP_REPLACE(a, '[$,]', '', 'g') AS DOUBLE)"
_LARGEST = f"LIST_MAX(LIST_TRANSFORM(REGEXP_EXTRACT_ALL(text, {_q(tx.AMOUNT_FORM)}), lambda a: {_BARE}))"
_DAY = "COALESCE(" + ", ".join(f"NULLIF(REGEXP_EXTRACT(text, {_q('(?i)' + p)}, 0), '')" for p in tx.DAY_FORMS) + ")"
_REF = f"NULLIF(REGEXP_EXTRACT(text, {_q('(?i)' + tx.REFERENCE_FORM)}, 1), '')"
_NO_DAY = f"CASE WHEN {_DAY} IS NOT NULL THEN REGEXP_REPLACE(REGEXP_REPLACE(text, {_q(tx.DAY_FORMS[0])}, '', 'g'), {_q('(?i)' + tx.DAY_FORMS[1])}, '', 'g') ELSE text END"
_NO_REF = f"CASE WHEN {_REF} IS NOT NULL THEN REGEXP_REPLACE({_NO_DAY}, {_q('(?i)' + tx.REFERENCE_FORM)}, '', 'g') ELSE {_NO_DAY} END"
_REST = f"TRIM(REGEXP_REPLACE(REGEXP_REPLACE({_NO_REF}, {_q(tx.AMOUNT_FORM)}, '', 'g'), '\\s+', ' ', 'g'))"
_RUNS = f"REGEXP_EXTRACT_ALL(text, {_q(tx.ACCOUNT_FORM)})"
_LONGEST = f"LIST_FILTER({_RUNS}, lambda n: LENGTH(n) = LIST_MAX(LIST_TRANSFORM({_RUNS}, lambda m: LENGTH(m))))[1]"
_AMOUNTS, _DAYS = f"REGEXP_EXTRACT_ALL(text, {_q(tx.LAST_AMOUNT_FORM)}, 1)", f"REGEXP_EXTRACT_ALL(text, {_q(tx.FIRST_DAY_FORM)}, 1)"
_LEFT = f"TRIM(LIST_REDUCE(LIST_PREPEND(LIST_REDUCE(LIST_PREPEND(text, {_AMOUNTS}), lambda acc, a: REPLACE(REPLACE(acc, '$' || a, ''), a, '')), {_DAYS}), lambda acc, x: REPLACE(acc, x, '')))"
_ACCOUNT = {k: f"NULLIF(REGEXP_EXTRACT(text, {_q(p)}, 1), '')" for k, p in (("bsb", tx.READ_BSB), ("account_number", tx.READ_ACCOUNT))} | {"balance": f"TRY_CAST(REPLACE(NULLIF(REGEXP_EXTRACT(text, {_q(tx.READ_BALANCE)}, 1), ''), ',', '') AS DOUBLE)"}
_LAST = f"TRY_CAST(REPLACE(({_AMOUNTS})[-1], ',', '') AS DOUBLE)"
_BANK_HIT = {b: f"(LOWER(name) = {_q(b.lower())} OR {_any('LOWER(name)', [n.lower() for n in ns])})" for b, ns in tx.BANK_NAMES.items()}
_RANGE_HIT = {b: f"(CONTAINS({_q(b.lower())}, LOWER(name)) OR {_any('LOWER(name)', [n.lower() for n in ns])})" for b, ns in tx.BANK_NAMES.items()}
_HELD = "(value IS NOT NULL AND TRIM(value) <> '')"
_NUMBER = "TRY_CAST(REGEXP_REPLACE({}, '[$,\\s]', '', 'g') AS DOUBLE)"

ORACLES = {
    "u2_model_answers": with_views("SELECT doc_id, CASE WHEN text <> '' THEN SPLIT_PART(text, CHR(10), 1) END AS text, CASE WHEN text <> '' THEN ROUND(LEAST(CAST(LENGTH(text) AS DOUBLE) / 1000, 1), 6) END AS confidence, CASE WHEN COALESCE(text, '') = '' THEN 'ValueError: no text' END AS error FROM broken_receipts", "broken_receipts"),
    "k4_result_texts": with_views("SELECT model || '/' || CAST(doc_id AS VARCHAR) AS name, COALESCE(STRING_AGG(CASE WHEN value <> '' THEN field || ': ' || value END, CHR(10) ORDER BY field), '') AS text FROM extractions GROUP BY model, doc_id", "extractions"),
    "c6_answer_types": _answers(_FULL),
    "c7_plain_answer_types": _answers(_PLAIN),
    "b11_line_transactions": with_views(f"SELECT ord, {_DAY} AS date, CASE WHEN {_REST} = '' THEN 'Transaction' ELSE {_REST} END AS description, ROUND(ABS({_LARGEST}), 6) AS amount, {_REF} AS reference, CASE WHEN {_LARGEST} < 0 THEN 'debit' ELSE 'credit' END AS type FROM statement_readings WHERE {_LARGEST} IS NOT NULL", "statement_readings"),
    "b13_account_texts": with_views(f"SELECT ord, {_VALID} AS valid, NULLIF(REGEXP_EXTRACT(text, {_q(tx.BSB_FORM)}, 0), '') AS bsb, {_LONGEST} AS account_number, LIST_FILTER(REGEXP_EXTRACT_ALL(text, {_q(tx.HOLDER_FORM)}), lambda n: LENGTH(n) BETWEEN 10 AND 50)[1] AS account_holder FROM statement_readings", "statement_readings"),
    "b14_read_transactions": with_views(f"SELECT ord, {_LAST} AS amount, CASE WHEN LEN({_AMOUNTS}) > 0 THEN ({_DAYS})[1] END AS date, CASE WHEN LEN({_AMOUNTS}) > 0 THEN {_LEFT} END AS description, " + ", ".join(f"{e} AS {k}" for k, e in _ACCOUNT.items()) + f" FROM statement_readings WHERE {_VALID}", "statement_readings"),
    "b16_statement_roll_up": with_views(f"SELECT statement_id, COUNT(*) AS texts, COUNT(amount) AS transactions, CAST(SUM(CAST(ROUND(amount * 100) AS BIGINT)) AS BIGINT) AS cents, " + ", ".join(f"ARG_MAX({k}, ord) FILTER ({k} IS NOT NULL) AS {k}" for k in _ACCOUNT) + f" FROM (SELECT statement_id, ord, {_LAST} AS amount, " + ", ".join(f"{e} AS {k}" for k, e in _ACCOUNT.items()) + f" FROM statement_readings WHERE {_VALID}) t GROUP BY statement_id", "statement_readings"),
    "j17_bank_names": with_views("", "papers").rstrip() + ", t AS (SELECT SPLIT_PART(text, CHR(10), 1) AS name, COUNT(*) AS papers FROM papers WHERE doc_type = 'bank_statement' GROUP BY 1) SELECT name, papers, CASE " + " ".join(f"WHEN {_BANK_HIT[b]} THEN '{c}'" for b, c, _ in tx.BANKS) + " END AS category, " + " OR ".join(_BANK_HIT[b] for b, c, _ in tx.BANKS if c == "big_four") + " AS big_four, CASE " + " ".join(f"WHEN {_RANGE_HIT[b]} THEN '{','.join(f'{lo}-{hi}' for lo, hi in r)}'" for b, r in tx.NAMED_RANGES.items()) + " ELSE '' END AS ranges FROM t",
    "v30_fallback_decisions": with_views("", "extractions").rstrip() + f""", f AS (SELECT model, doc_id, COUNT(CASE WHEN {_HELD} THEN 1 END) AS n,
 COUNT(CASE WHEN {_HELD} AND ((field = 'total_amount' AND COALESCE(TRY_CAST(TRIM(REGEXP_REPLACE(value, '[$,]', '', 'g')) AS DOUBLE) < 5, TRUE)) OR (field = 'supplier_name' AND LENGTH(TRIM(value)) <= 2) OR (field = 'date' AND (NOT REGEXP_MATCHES(value, '[0-9]') OR LENGTH(TRIM(value)) < 8))) THEN 1 END) AS bad,
 COUNT(CASE WHEN {_HELD} AND (LENGTH(TRIM(value)) <= 1 OR LOWER(TRIM(value)) IN ({', '.join(map(_q, fb.NOTHING))})) THEN 1 END) AS empty FROM extractions GROUP BY model, doc_id)
 SELECT model, doc_id, CAST(bad AS INT) AS issues, CAST(empty AS INT) AS meaningless, n < 3 OR bad > 0 OR empty > FLOOR(n / 2) AS insufficient, CASE WHEN n < 3 OR bad >= 3 THEN 'very_poor' WHEN n < 5 OR bad >= 2 OR empty > FLOOR(n / 2) THEN 'poor' WHEN n < 7 OR bad >= 1 OR empty > FLOOR(n / 3) THEN 'fair' WHEN n >= 8 AND bad = 0 AND empty = 0 THEN 'excellent' ELSE 'good' END AS grade FROM f""",
    "a9_ato_scores": with_views("", "extractions", "ground_truth").rstrip() + f""", t AS (SELECT s.model, s.doc_id, g.field, g.value AS true_value FROM (SELECT DISTINCT model, doc_id FROM extractions) s JOIN ground_truth g ON g.doc_id = s.doc_id),
 c AS (SELECT t.*, e.value, (SELECT COUNT(*) FROM ground_truth g WHERE g.doc_id = t.doc_id AND g.field = 'total_amount') AS has_total FROM t LEFT JOIN extractions e ON e.model = t.model AND e.doc_id = t.doc_id AND e.field = t.field),
 p AS (SELECT model, doc_id, CASE WHEN field IN ('abn', 'date', 'total_amount', 'subtotal', 'gst_amount') THEN 1 ELSE 0 END + CASE WHEN field = 'gst_amount' AND has_total > 0 THEN 1 ELSE 0 END AS checks,
 CASE WHEN field = 'abn' THEN CASE WHEN REGEXP_MATCHES(REGEXP_REPLACE(value, '\\s', '', 'g'), '^[0-9]{{11}}$') THEN 1.0E0 WHEN REGEXP_MATCHES(REGEXP_REPLACE(true_value, '\\s', '', 'g'), '^[0-9]{{11}}$') AND value = true_value THEN 0.8E0 ELSE 0.0E0 END
 WHEN field = 'date' THEN CASE WHEN REGEXP_MATCHES(TRIM(value), {_q(ev.DATE_FORMS[0])}) OR REGEXP_MATCHES(TRIM(value), {_q(ev.DATE_FORMS[1])}) THEN 1.0E0 ELSE 0.0E0 END
 WHEN field IN ('total_amount', 'subtotal', 'gst_amount') THEN CASE WHEN REGEXP_MATCHES(TRIM(value), {_q(ev.AMOUNT_FORM)}) THEN 1.0E0 ELSE 0.0E0 END ELSE 0.0E0 END AS points FROM c)
 SELECT model, doc_id, CAST(SUM(checks) AS INT) AS checks, ROUND(CASE WHEN SUM(checks) > 0 THEN SUM(points) / SUM(checks) ELSE 0 END, 6) AS ato_score FROM p GROUP BY model, doc_id""",
    "g17_benchmark_overall": with_views("SELECT model, ROUND(COALESCE(AVG(CASE WHEN success THEN f1_score END), 0), 6) AS average_f1, ROUND(AVG(CASE WHEN success THEN 1.0E0 ELSE 0.0E0 END), 6) AS success_rate, COUNT(*) AS total_documents, COUNT(CASE WHEN success THEN 1 END) AS successful_documents, ROUND(AVG(CASE WHEN success THEN processing_time END), 6) AS avg_processing_time, MIN(CASE WHEN success THEN processing_time END) AS min_processing_time, MAX(CASE WHEN success THEN processing_time END) AS max_processing_time, ROUND(SUM(CASE WHEN success THEN processing_time END), 6) AS total_processing_time FROM results GROUP BY model", "results"),
    "r2_benchmark_summary": with_views("SELECT COUNT(*) AS num_models, ROUND(MAX(f), 6) AS best_f1_score, ROUND(MIN(f), 6) AS worst_f1_score, ROUND(AVG(f), 6) AS average_f1_score, ROUND(MIN(t), 6) AS fastest_avg_time, ROUND(MAX(t), 6) AS slowest_avg_time FROM (SELECT model, AVG(CASE WHEN success THEN f1_score END) AS f, AVG(CASE WHEN success THEN processing_time END) AS t FROM results GROUP BY model) m", "results"),
    "j15_ranking_with_benchmark": with_views("SELECT model, ROUND(c, 6) AS confidence, ROUND(COALESCE(f, 0), 6) AS average_f1, ROUND(s, 6) AS success_rate FROM (SELECT model, AVG(confidence_score) AS c, AVG(CASE WHEN success THEN f1_score END) AS f, AVG(CASE WHEN success THEN 1.0E0 ELSE 0.0E0 END) AS s FROM results GROUP BY model) m", "results"),
}

_TOP3 = "CASE predicted " + " ".join(f"WHEN '{k}' THEN ARRAY_TO_STRING(LIST_TRANSFORM(LIST_SORT(LIST_FILTER([" + ", ".join(f"{{'w': {-cl.keyword_weight(w)}, 'k': {j}, 't': {_q(w)}}}" for j, w in enumerate(ws)) + "], lambda t: CONTAINS(low, t.t)))[1:3], lambda t: t.t), ', ')" for k, ws in cl.KEYWORDS.items() if ws) + " ELSE '' END"
_SHOWN = "CASE predicted " + " ".join(f"WHEN '{k}' THEN " + " + ".join(f"CASE WHEN REGEXP_MATCHES(low, {_q(p)}) THEN 1 ELSE 0 END" for p in ps) for k, ps in cl.FORMATS.items()) + " ELSE 0 END"
_NAMED = "ARRAY_TO_STRING(LIST_TRANSFORM(LIST_FILTER([" + ", ".join(map(_q, cl.BUSINESSES)) + "], lambda b: CONTAINS(low, b))[1:2], lambda b: b || ' (0.80)'), ', ')"
_CONTENT = "CASE WHEN COALESCE(text, '') = '' THEN 'unknown' " + " ".join(f"WHEN {_any('LOWER(text)', ws)} THEN '{k}'" for k, ws in tx.CONTENTS.items()) + " WHEN REGEXP_MATCHES(text, '[0-9]+\\.[0-9]{2}') THEN 'transaction' ELSE 'unknown' END"
_METRICS = {"confidence_score": "confidence_score", "processing_time": "processing_time", "ato_compliance_score": "ato_compliance_score", "production_ready": "CASE WHEN production_ready THEN 1.0E0 ELSE 0.0E0 END"}
_MEANS = "m AS (" + " UNION ALL ".join(f"SELECT '{k}' AS metric, AVG(CASE WHEN model = 'internvl3' THEN {e} END) AS a, AVG(CASE WHEN model = 'llama32_vision' THEN {e} END) AS b FROM results" for k, e in _METRICS.items()) + ")"
_TEXT = "date || ' ' || description || ' $' || c || ' 1' || c || ' ; ' || date || ' ' || description || ' $' || c || ' 1' || c"
ORACLES |= {
    "c3_evidence": _CLASS.rstrip() + f", e AS (SELECT p.*, low FROM predicted p JOIN low ON low.doc_id = p.doc_id), w AS (SELECT *, {_TOP3} AS words, {_SHOWN} AS shown, {_NAMED} AS names FROM e) SELECT doc_id, predicted, CASE WHEN score < 0.3 THEN 'Low confidence classification' ELSE CONCAT_WS('; ', CASE WHEN words <> '' THEN 'Keywords: ' || words END, CASE WHEN shown > 0 THEN 'Format patterns: ' || CAST(shown AS VARCHAR) END, CASE WHEN names <> '' THEN 'Australian businesses: ' || names END) END AS evidence, score >= 0.7 AS confident, score >= 0.8 AND predicted NOT IN ('unknown', 'other') AS production_ready FROM w",
    "c16_highlight_contents": with_views(f"SELECT ord, {_CONTENT} AS content, {_any('LOWER(text)', tx.FUEL_WORDS)} AS fuel FROM statement_readings", "statement_readings"),
    "x8_balanced_transactions": with_views(f"SELECT id, CAST(nth AS INT) AS nth, date, description, c AS amount, '1' || c AS balance FROM (SELECT event_id AS id, date, TRIM(description) AS description, CAST(((cents % 977) + 977) % 977 AS VARCHAR) || '.25' AS c FROM bank_txns) t CROSS JOIN (SELECT 0 AS nth UNION ALL SELECT 1) n", "bank_txns"),
    "x9_fuel_details": with_views("SELECT doc_id, NULLIF(REGEXP_EXTRACT(text, '(?i)pump\\s+([0-9]+)', 1), '') AS pump_number, 'Depot ' || CAST(doc_id AS VARCHAR) AS location, NULLIF(REGEXP_EXTRACT(text, '(?i)odometer[:\\s]+([0-9]+)', 1), '') AS odometer FROM papers WHERE doc_type = 'fuel_receipt'", "papers"),
    "j14_metric_winners": with_views("", "results").rstrip() + f", {_MEANS} SELECT metric, ROUND(a, 6) AS a, ROUND(b, 6) AS b, CASE WHEN a = b THEN 'tie' WHEN (metric = 'processing_time') = (a < b) THEN 'internvl3' ELSE 'llama32_vision' END AS winner FROM m",
    "d5_model_grades": with_views("SELECT model, CASE WHEN r >= 0.9 THEN 'excellent' WHEN r >= 0.7 THEN 'good' WHEN r >= 0.5 THEN 'fair' ELSE 'poor' END AS grade FROM (SELECT model, AVG(CASE WHEN success THEN CASE WHEN production_ready THEN 1.0E0 ELSE 0.0E0 END END) AS r FROM results GROUP BY model) m", "results"),
    "r3_ordered_expenses": _EXP + "SELECT statement_id, ord, category, CAST(ROW_NUMBER() OVER (PARTITION BY statement_id ORDER BY ROUND(confidence, 9) DESC, ord) AS INT) AS place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY statement_id, date, SUBSTR(description, 1, 20), ABS(amount) ORDER BY ord) AS copy FROM expenses) u WHERE copy = 1",
    "r8_submission_order": with_views("SELECT model, doc_id, success, CAST(ROW_NUMBER() OVER (PARTITION BY model ORDER BY position) AS INT) AS place FROM results", "results"),
    "r6_rows_from_the_top": with_views("SELECT image_id, ord, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY y, ord) AS INT) AS place, CAST(x AS DOUBLE) / 1000 AS relative_x, CAST(y AS DOUBLE) / 1000 AS relative_y, CAST(width AS DOUBLE) / 1000 AS relative_width, CAST(height AS DOUBLE) / 1000 AS relative_height FROM highlights WHERE width >= 200 AND height BETWEEN 20 AND 100 AND CAST(width AS DOUBLE) / height BETWEEN 3 AND 25 AND y >= 200 AND confidence >= 0.4", "highlights"),
    "r12_ordered_correlations": _PAIRS + "SELECT image_id, h_ord, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY ROUND(correlation, 9) DESC, h_ord) AS INT) AS place FROM scores",
}
