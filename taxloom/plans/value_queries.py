"""Queries over identifiers, dates, amounts and field-level evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxloom.functions import validators as v
from taxloom.operators import evaluation as ev
from taxloom.plans.result_queries import rounded
from taxloom.sources.views import view, with_views

#: The year against which dates are checked, fixed so that results do not depend on the day.
THIS_YEAR = 2024
ALIASES = {"supplier": ["supplier_name", "business_name"], "total": ["total_amount", "total"], "date": ["invoice_date", "date"], "abn": ["supplier_abn", "abn"], "number": ["invoice_number"]}


def abn_validate(spark, d):
    c = F.col("abn")
    return view(spark, d, "abn_inputs").select("id", v.abn_issue(c).isNull().alias("valid"), F.when(v.blank(c), "").when(v.abn_issue(c).isNull(), v.abn_format(c)).otherwise(v.digits(c)).alias("formatted"), v.abn_issue(c).alias("issue"))


def bsb_validate(spark, d):
    c = F.col("bsb")
    bank, kind = v.bank_of(v.bsb_prefix(c)), v.bank_of(v.bsb_prefix(c), "category")
    issues = v.bsb_issues(c)
    return view(spark, d, "bsb_inputs").select("id", (F.size(issues) == 0).alias("valid"), v.bsb_format(F.substring(v.digits(c), 1, 6)).alias("formatted"), bank.alias("bank"), kind.alias("category"), F.array_join(issues, "; ").alias("issues"))


def bsb_nearest(spark, d):
    c = F.col("bsb")
    return view(spark, d, "bsb_inputs").select("id", v.bsb_nearest(c).alias("nearest")).filter("nearest is not null")


def big_four(spark, d):
    c = F.col("bsb")
    four = F.coalesce(v.bank_of(v.bsb_prefix(c), "category") == "big_four", F.lit(False))
    return view(spark, d, "bsb_inputs").groupBy(F.coalesce(v.bank_of(v.bsb_prefix(c)), F.lit("none")).alias("bank")).agg(F.count("*").alias("n"), F.count_if(four).alias("big_four"))


def bank_ranges(spark, d):
    """Banks by category, in the order tried, with how many of the BSBs lie in their ranges."""
    dim = spark.createDataFrame([(k, *r) for k, r in enumerate(v.BANK_RANGES)], "ord int, bank string, category string, lo int, hi int")
    # There are a thousand prefixes at most, so what meets the ranges is small whatever the table's size.
    prefixes = view(spark, d, "bsb_inputs").groupBy(v.bsb_prefix(F.col("bsb")).alias("prefix")).agg(F.count("*").alias("n"))
    first = prefixes.join(F.broadcast(dim), F.col("prefix").between(F.col("lo"), F.col("hi"))).groupBy("prefix", "n").agg(F.min("ord").alias("ord"))
    found = first.join(F.broadcast(dim.select("ord", "bank")), "ord").groupBy("bank").agg(F.sum("n").alias("n"))
    banks = dim.groupBy("category", "bank").agg(F.min("ord").cast("long").alias("ord"), F.count("*").alias("ranges"))
    return banks.join(found, "bank").select("category", "bank", "ord", "ranges", "n")


def bsb_checked(spark, d):
    """BSBs by the plainer check, and whether they are well formed at all."""
    rows = view(spark, d, "bsb_inputs").withColumns({"c": v.bsb_checked(F.col("bsb")), "well_formed": v.bsb_well_formed(F.col("bsb"))})
    return rows.select("id", "well_formed", "c.*")


def bsb_suggestions(spark, d):
    return view(spark, d, "bsb_inputs").select("id", F.array_join(v.bsb_suggestions(F.col("bsb")), "; ").alias("suggestions"))


def date_validate(spark, d):
    c = F.col("text")
    day = v.parse_date(c)
    return view(spark, d, "date_inputs").select("id", v.date_issue(c, THIS_YEAR).isNull().alias("valid"), F.date_format(day, "dd/MM/yyyy").alias("formatted"), v.financial_year(day).alias("financial_year"))


def amount_validate(spark, d):
    c = F.col("text")
    return view(spark, d, "amount_inputs").select("id", v.amount_issue(c).isNull().alias("valid"), v.amount_value(c).alias("amount"), v.amount_issue(c).alias("issue"))


def gst_validate(spark, d):
    s, g, t = F.col("subtotal"), F.col("gst"), F.col("total")
    return view(spark, d, "gst_inputs").select("id", v.gst_valid(s, g, t).alias("valid"), v.gst_rounded(s, g, t).alias("valid_rounded"), F.round(v.gst_part(t), 6).alias("gst_part"), (t >= v.GST_THRESHOLD).alias("must_register"))


def _read(spark, d):
    return view(spark, d, "extractions"), view(spark, d, "ground_truth")


def prf(spark, d):
    out = ev.prf(*_read(spark, d))
    return rounded(out.select("model", "doc_id", "precision", "recall", "f1"), "precision", "recall", "f1")


def match_rates(spark, d):
    return rounded(ev.match_rates(ev.paired(*_read(spark, d))), "exact_match", "fuzzy_match")


def field_accuracy(spark, d):
    return rounded(ev.field_accuracy(ev.paired(*_read(spark, d))), "accuracy")


def confidence_correlation(spark, d):
    return rounded(ev.confidence_correlation(ev.paired(*_read(spark, d)), ["model", "field"]), "correlation")


def sroie_fields(spark, d):
    return rounded(ev.sroie_fields(ev.sroie_scores(*_read(spark, d))), "precision", "recall", "f1")


def sroie_leaderboard(spark, d):
    return rounded(ev.sroie_leaderboard(ev.sroie_scores(*_read(spark, d))), "f1")


def standardized(spark, d):
    return ev.standardized(view(spark, d, "extractions"), ALIASES)


_DIGITS = "REGEXP_REPLACE({}, '[^0-9]', '', 'g')"
_RANGE = " ".join(f"WHEN p BETWEEN {lo} AND {hi} THEN '{bank}'" for bank, _, lo, hi in v.BANK_RANGES)
_KIND = " ".join(f"WHEN p BETWEEN {lo} AND {hi} THEN '{kind}'" for _, kind, lo, hi in v.BANK_RANGES)
_BSB = with_views("", "bsb_inputs").rstrip() + f""", d AS (SELECT id, bsb, {_DIGITS.format('bsb')} AS dg FROM bsb_inputs),
 six AS (SELECT *, SUBSTR(dg, 1, 6) AS s, LENGTH(dg) AS n, CASE WHEN LENGTH(dg) >= 3 THEN CAST(SUBSTR(dg, 1, 3) AS INTEGER) END AS p FROM d),
 known AS (SELECT *, CASE {_RANGE} END AS bank, CASE {_KIND} END AS category FROM six) """
_CHECK = " + ".join(f"CAST(SUBSTR(dg, {k + 2}, 1) AS INTEGER) * {w}" for k, w in enumerate(v.ABN_WEIGHTS))
_NEAR = " UNION ALL ".join(f"SELECT id, LEAST(ABS(p - {lo}), ABS(p - {hi})) AS distance, {k} AS ord, '{bank}' AS bank FROM known WHERE bank IS NULL AND LENGTH(s) = 6" for k, (bank, _, lo, hi) in enumerate(v.BANK_RANGES))
_MONTH = "CASE LOWER(REGEXP_EXTRACT(t, '^[0-9]{1,2} +([A-Za-z]+) +[0-9]{4}$', 1)) " + " ".join(f"WHEN '{w}' THEN {k + 1}" for names in (v._MONTHS, v._FULL) for k, w in enumerate(names) if names is v._MONTHS or w != "may") + " END"
_NUM = "TRY_CAST(REGEXP_REPLACE({0}, '[$,\\s]', '', 'g') AS DOUBLE)"
_SAME = f"""CASE WHEN field IN ('abn', 'abn_number') THEN REGEXP_REPLACE(a, '[\\s-]', '', 'g') = REGEXP_REPLACE(b, '[\\s-]', '', 'g')
 WHEN field IN ('total_amount', 'amount', 'subtotal', 'gst_amount') THEN CASE WHEN {_NUM.format('a')} IS NOT NULL AND {_NUM.format('b')} IS NOT NULL THEN {_NUM.format('a')} = {_NUM.format('b')} ELSE a = b END
 WHEN field IN ('date', 'transaction_date', 'invoice_date') THEN REGEXP_REPLACE(a, '[-/\\s]', '', 'g') = REGEXP_REPLACE(b, '[-/\\s]', '', 'g') ELSE a = b END"""
_PAIRS = with_views("", "extractions", "ground_truth").rstrip() + f""", seen AS (SELECT DISTINCT model, doc_id FROM extractions),
 pairs AS (SELECT s.model, s.doc_id, g.field, g.value AS true_value, e.value, e.confidence, LOWER(TRIM(e.value)) AS a, LOWER(TRIM(g.value)) AS b FROM seen s JOIN ground_truth g ON g.doc_id = s.doc_id LEFT JOIN extractions e ON e.model = s.model AND e.doc_id = s.doc_id AND e.field = g.field),
 judged AS (SELECT *, COALESCE({_SAME}, FALSE) AS same FROM pairs) """
_SROIE = with_views("", "extractions", "ground_truth").rstrip() + f""", names AS (SELECT 'company' AS name, 'supplier_name' AS field UNION ALL SELECT 'date', 'date' UNION ALL SELECT 'total', 'total_amount' UNION ALL SELECT 'address', 'address'),
 seen AS (SELECT DISTINCT model, doc_id FROM extractions WHERE doc_id IN (SELECT doc_id FROM ground_truth)),
 due AS (SELECT s.model, s.doc_id, n.name, LOWER(TRIM(NULLIF(e.value, ''))) AS a, LOWER(TRIM(NULLIF(g.value, ''))) AS b FROM seen s CROSS JOIN names n LEFT JOIN extractions e ON e.model = s.model AND e.doc_id = s.doc_id AND e.field = n.field LEFT JOIN ground_truth g ON g.doc_id = s.doc_id AND g.field = n.field),
 scores AS (SELECT model, doc_id, name, CASE WHEN a IS NULL AND b IS NULL THEN 1.0 WHEN CASE WHEN name = 'total' THEN CASE WHEN {_NUM.format('a')} IS NOT NULL AND {_NUM.format('b')} IS NOT NULL THEN ABS({_NUM.format('a')} - {_NUM.format('b')}) < 0.01 ELSE a = b END WHEN name = 'date' THEN REGEXP_REPLACE(a, '[-/\\s]', '', 'g') = REGEXP_REPLACE(b, '[-/\\s]', '', 'g') ELSE a = b END THEN 1.0 ELSE 0.0 END AS f1 FROM due),
 fields AS (SELECT model, name, AVG(f1) AS f1, COUNT(*) AS sample_count FROM scores GROUP BY model, name) """
_SIM = "CASE WHEN a = b THEN 1.0 WHEN LENGTH(a) = 0 OR LENGTH(b) = 0 THEN 0.0 ELSE 1.0 - CAST(LEVENSHTEIN(a, b) AS DOUBLE) / GREATEST(LENGTH(a), LENGTH(b)) END"
_ALIAS = " ".join(f"WHEN '{a}' THEN '{n}'" for n, many in ALIASES.items() for a in many)
_ORDER = " ".join(f"WHEN '{a}' THEN {k}" for many in ALIASES.values() for k, a in enumerate(many))

QUERIES = {
    "v1_abn_validate": abn_validate,
    "v4_bsb_validate": bsb_validate,
    "v3_bsb_checked": bsb_checked,
    "v4_bsb_suggestions": bsb_suggestions,
    "j8_bsb_nearest": bsb_nearest,
    "v7_big_four": big_four,
    "v8_banks_by_category": bank_ranges,
    "v9_date_validate": date_validate,
    "v15_amount_validate": amount_validate,
    "v11_gst_validate": gst_validate,
    "g1_prf": prf,
    "g2_g4_match_rates": match_rates,
    "g6_field_accuracy": field_accuracy,
    "g8_confidence_correlation": confidence_correlation,
    "j1_missing_truth": lambda s, d: ev.missing_truth(*_read(s, d)),
    "g16_sroie_fields": sroie_fields,
    "r2_sroie_leaderboard": sroie_leaderboard,
    "p7_standardized_fields": standardized,
}

ORACLES = {
    "v1_abn_validate": with_views("", "abn_inputs").rstrip()
    + f""", d AS (SELECT id, abn, {_DIGITS.format('abn')} AS dg FROM abn_inputs),
 e AS (SELECT *, CASE WHEN TRIM(abn) = '' THEN 'ABN is required' WHEN LENGTH(dg) <> 11 THEN 'ABN must be 11 digits, got ' || CAST(LENGTH(dg) AS VARCHAR) WHEN CAST(SUBSTR(dg, 1, 1) AS INTEGER) < 1 OR ((CAST(SUBSTR(dg, 1, 1) AS INTEGER) - 1) * 10 + {_CHECK}) % 89 <> 0 THEN 'ABN checksum validation failed' END AS issue FROM d)
 SELECT id, issue IS NULL AS valid, CASE WHEN TRIM(abn) = '' THEN '' WHEN issue IS NULL THEN SUBSTR(dg, 1, 2) || ' ' || SUBSTR(dg, 3, 3) || ' ' || SUBSTR(dg, 6, 3) || ' ' || SUBSTR(dg, 9, 3) ELSE dg END AS formatted, issue FROM e""",
    "v4_bsb_validate": _BSB
    + """, i AS (SELECT *, CASE WHEN TRIM(bsb) = '' THEN 'BSB is required' WHEN n = 0 THEN 'BSB contains no digits' ELSE CONCAT_WS('; ', CASE WHEN n < 6 THEN 'BSB too short: ' || CAST(n AS VARCHAR) || ' digits (expected 6)' END, CASE WHEN n > 6 THEN 'BSB too long: ' || CAST(n AS VARCHAR) || ' digits (expected 6)' END, CASE WHEN n >= 3 AND bank IS NULL THEN 'BSB not recognized as valid Australian bank' END, CASE WHEN s = '000000' THEN 'Invalid BSB: 000-000 is not a valid bank code' END, CASE WHEN s = '123456' THEN 'BSB appears to be a placeholder (123-456)' END) END AS issues FROM known)
 SELECT id, issues = '' AS valid, CASE WHEN LENGTH(s) = 6 THEN SUBSTR(s, 1, 3) || '-' || SUBSTR(s, 4, 3) ELSE s END AS formatted, bank, category, issues FROM i""",
    "j8_bsb_nearest": _BSB + f", near AS ({_NEAR}) SELECT id, bank AS nearest FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY distance, ord) AS k FROM near WHERE distance <= 20) t WHERE k = 1",
    "v7_big_four": _BSB + "SELECT COALESCE(bank, 'none') AS bank, COUNT(*) AS n, COUNT(CASE WHEN category = 'big_four' THEN 1 END) AS big_four FROM known GROUP BY 1",
    "v8_banks_by_category": _BSB + ", dim AS (SELECT bank, CAST(MIN(ord) AS BIGINT) AS ord, COUNT(*) AS ranges FROM (VALUES " + ", ".join(f"({k}, '{b}')" for k, (b, _, _, _) in enumerate(v.BANK_RANGES)) + ") t(ord, bank) GROUP BY bank) SELECT category, k.bank, ord, ranges, COUNT(*) AS n FROM known k JOIN dim ON dim.bank = k.bank GROUP BY category, k.bank, ord, ranges",
    "v9_date_validate": with_views("", "date_inputs").rstrip()
    + f""", t AS (SELECT id, TRIM(text) AS t FROM date_inputs),
 q AS (SELECT id, CASE WHEN REGEXP_MATCHES(t, '^[0-9]{{1,2}}[/. -][0-9]{{1,2}}[/. -][0-9]{{4}}$') THEN REGEXP_REPLACE(t, '[. -]', '/', 'g') WHEN {_MONTH} IS NOT NULL THEN REGEXP_EXTRACT(t, '^([0-9]+)', 1) || '/' || CAST({_MONTH} AS VARCHAR) || '/' || REGEXP_EXTRACT(t, '([0-9]{{4}})$', 1) END AS s FROM t),
 r AS (SELECT id, CAST(SPLIT_PART(s, '/', 1) AS INTEGER) AS dd, CAST(SPLIT_PART(s, '/', 2) AS INTEGER) AS mm, CAST(SPLIT_PART(s, '/', 3) AS INTEGER) AS yy FROM q),
 g AS (SELECT *, COALESCE(mm BETWEEN 1 AND 12 AND dd BETWEEN 1 AND CASE WHEN mm IN (4, 6, 9, 11) THEN 30 WHEN mm = 2 THEN CASE WHEN yy % 4 = 0 AND (yy % 100 <> 0 OR yy % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END, FALSE) AS good FROM r)
 SELECT id, good AND yy BETWEEN 1950 AND {THIS_YEAR + 2} AS valid, CASE WHEN good THEN LPAD(CAST(dd AS VARCHAR), 2, '0') || '/' || LPAD(CAST(mm AS VARCHAR), 2, '0') || '/' || LPAD(CAST(yy AS VARCHAR), 4, '0') END AS formatted, CASE WHEN good THEN CASE WHEN mm >= 7 THEN CAST(yy AS VARCHAR) || '-' || CAST(yy + 1 AS VARCHAR) ELSE CAST(yy - 1 AS VARCHAR) || '-' || CAST(yy AS VARCHAR) END END AS financial_year FROM g""",
    "v15_amount_validate": with_views("", "amount_inputs").rstrip()
    + """, t AS (SELECT id, TRIM(text) AS t, CASE WHEN REGEXP_MATCHES(TRIM(text), '^-?\\$?([0-9]{1,3}(,[0-9]{3})*|[0-9]+)(\\.[0-9]{1,2})?$') THEN ABS(CAST(REGEXP_REPLACE(TRIM(text), '[$,]', '', 'g') AS DOUBLE)) END AS amount FROM amount_inputs),
 i AS (SELECT *, CASE WHEN t = '' THEN 'Amount is required' WHEN amount IS NULL THEN 'Invalid amount format' WHEN t LIKE '-%' AND amount > 0 THEN 'Amount cannot be negative' END AS issue FROM t) SELECT id, issue IS NULL AS valid, amount, issue FROM i""",
    "v11_gst_validate": with_views("SELECT id, CASE WHEN gst = 0 AND total = subtotal THEN TRUE ELSE subtotal >= 0 AND gst >= 0 AND total >= 0 AND ABS(gst - subtotal * 0.1E0) <= 0.005E0 AND ABS(total - (subtotal + subtotal * 0.1E0)) <= 0.005E0 END AS valid, CASE WHEN gst = 0 AND total = subtotal THEN TRUE ELSE ABS(gst - FLOOR(subtotal * 0.1E0 * 100 + 0.5) / 100) <= 0.005E0 AND ABS(total - (subtotal + FLOOR(subtotal * 0.1E0 * 100 + 0.5) / 100)) <= 0.005E0 END AS valid_rounded, ROUND(total * (0.1E0 / 1.1E0), 6) AS gst_part, total >= 75000 AS must_register FROM gst_inputs", "gst_inputs"),
    "g1_prf": with_views("", "extractions", "ground_truth").rstrip()
    + """, seen AS (SELECT DISTINCT model, doc_id FROM extractions), n AS (SELECT s.model, s.doc_id, (SELECT COUNT(*) FROM extractions e WHERE e.model = s.model AND e.doc_id = s.doc_id) AS reads FROM seen s),
 t AS (SELECT s.model, s.doc_id, COUNT(*) AS due, COUNT(e.field) AS tp FROM seen s JOIN ground_truth g ON g.doc_id = s.doc_id LEFT JOIN extractions e ON e.model = s.model AND e.doc_id = s.doc_id AND e.field = g.field GROUP BY s.model, s.doc_id),
 r AS (SELECT e.model, e.doc_id, COUNT(*) AS reads FROM extractions e GROUP BY e.model, e.doc_id),
 p AS (SELECT t.model, t.doc_id, CAST(tp AS DOUBLE) / reads AS p, CAST(tp AS DOUBLE) / due AS r FROM t JOIN r ON r.model = t.model AND r.doc_id = t.doc_id)
 SELECT model, doc_id, ROUND(p, 6) AS precision, ROUND(r, 6) AS recall, ROUND(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM p""".replace(" n AS (SELECT s.model, s.doc_id, (SELECT COUNT(*) FROM extractions e WHERE e.model = s.model AND e.doc_id = s.doc_id) AS reads FROM seen s),\n", ""),
    "g2_g4_match_rates": _PAIRS + f"SELECT model, doc_id, ROUND(AVG(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS exact_match, ROUND(AVG(CASE WHEN COALESCE({_SIM} >= 0.8, FALSE) THEN 1.0 ELSE 0.0 END), 6) AS fuzzy_match, COUNT(*) AS fields FROM judged GROUP BY model, doc_id",
    "g6_field_accuracy": _PAIRS + 'SELECT model, field, COUNT(CASE WHEN a = b THEN 1 END) AS "right", COUNT(*) AS n, ROUND(AVG(CASE WHEN COALESCE(a = b, FALSE) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pairs GROUP BY model, field',
    "g8_confidence_correlation": _PAIRS + ", c AS (SELECT model, field, confidence AS x, CASE WHEN same THEN 1.0E0 ELSE 0.0E0 END AS y FROM judged WHERE confidence IS NOT NULL), s AS (SELECT model, field, COUNT(*) AS n, SUM(x) AS sx, SUM(y) AS sy, SUM(x * x) AS sxx, SUM(y * y) AS syy, SUM(x * y) AS sxy FROM c GROUP BY model, field) SELECT model, field, n, ROUND(CASE WHEN n < 2 OR n * sxx - sx * sx <= 1e-9 OR n * syy - sy * sy <= 1e-9 THEN 0 ELSE (n * sxy - sx * sy) / SQRT((n * sxx - sx * sx) * (n * syy - sy * sy)) END, 6) AS correlation FROM s",
    "j1_missing_truth": with_views("SELECT DISTINCT doc_id FROM extractions WHERE doc_id NOT IN (SELECT doc_id FROM ground_truth)", "extractions", "ground_truth"),
    "g16_sroie_fields": _SROIE + "SELECT model, name, ROUND(f1, 6) AS precision, ROUND(f1, 6) AS recall, ROUND(f1, 6) AS f1, sample_count FROM fields",
    "r2_sroie_leaderboard": _SROIE + "SELECT 'overall' AS name, model, ROUND(f1, 6) AS f1, ROW_NUMBER() OVER (ORDER BY f1 DESC, model) AS place FROM (SELECT model, AVG(f1) AS f1 FROM scores GROUP BY model) t UNION ALL SELECT name, model, ROUND(f1, 6) AS f1, ROW_NUMBER() OVER (PARTITION BY name ORDER BY f1 DESC, model) AS place FROM fields",
    "p7_standardized_fields": with_views(f"SELECT model, doc_id, name, value FROM (SELECT model, doc_id, name, value, ROW_NUMBER() OVER (PARTITION BY model, doc_id, name ORDER BY k, value) AS place FROM (SELECT model, doc_id, value, CASE field {_ALIAS} END AS name, CASE field {_ORDER} END AS k FROM extractions WHERE value <> '') t WHERE name IS NOT NULL) u WHERE place = 1", "extractions"),
}

_NINE = " ".join(f"WHEN CAST(SUBSTR(dg, 1, 3) AS INTEGER) BETWEEN {lo} AND {hi} THEN '{bank}'" for bank, kind, lo, hi in v.BANK_RANGES if kind not in v.LATER)
_UNKNOWN = "CASE WHEN n >= 3 AND bank IS NULL THEN '{}' END"
ORACLES["v3_bsb_checked"] = with_views("", "bsb_inputs").rstrip() + f""", d AS (SELECT id, bsb, {_DIGITS.format("bsb")} AS dg FROM bsb_inputs), e AS (SELECT *, CASE WHEN LENGTH(dg) = 6 THEN CASE {_NINE} END END AS bank FROM d),
 i AS (SELECT *, CASE WHEN TRIM(bsb) = '' THEN 'BSB is required' WHEN LENGTH(dg) <> 6 THEN 'BSB must be 6 digits, got ' || CAST(LENGTH(dg) AS VARCHAR) WHEN bank IS NULL THEN 'BSB not recognized as valid Australian bank' END AS issue FROM e)
 SELECT id, LENGTH(dg) = 6 AS well_formed, issue IS NULL AS valid, CASE WHEN TRIM(bsb) = '' THEN '' WHEN LENGTH(dg) = 6 THEN SUBSTR(dg, 1, 3) || '-' || SUBSTR(dg, 4, 3) ELSE dg END AS formatted, issue, bank FROM i"""
ORACLES["v4_bsb_suggestions"] = _BSB + """SELECT id, CASE WHEN TRIM(bsb) = '' THEN 'Please provide a 6-digit BSB number' WHEN n = 0 THEN 'BSB should be 6 digits (e.g., 123-456)' ELSE CONCAT_WS('; ', CASE WHEN n < 6 THEN 'Add ' || CAST(6 - n AS VARCHAR) || ' more digits to complete BSB' END, CASE WHEN n > 6 THEN 'Remove extra digits - BSB should be exactly 6 digits' END, """ + ", ".join(_UNKNOWN.format(t) for t in ("Verify BSB with your bank", "Check for typos in the BSB number", "Ensure BSB belongs to an Australian bank")) + """, CASE WHEN s = '000000' THEN 'Use your bank''s actual BSB number' END, CASE WHEN s = '123456' THEN 'Replace with your bank''s actual BSB number' END) END AS suggestions FROM known"""
