"""DuckDB counterparts of compliance and of the whole document pipeline, built on those of extraction and recognition."""

from __future__ import annotations

from taxloom.functions import validators as v
from taxloom.operators import batch_run as br
from taxloom.operators import classification as cl
from taxloom.operators import compliance as co
from taxloom.operators import confidence as cf
from taxloom.operators import extraction as ex
from taxloom.operators import registry as reg
from taxloom.plans import document_queries as dq
from taxloom.sources.views import VIEWS, with_views

_NAMES = {f: br.RENAMED.get(f, f) for f in ex.FIELDS}
_PIVOT = ", ".join(f"COALESCE(MAX(CASE WHEN field = '{f}' THEN {dq._CLEAN} END), '') AS f_{n}" for f, n in _NAMES.items())


def _has(name: str) -> str:
    return f"TRIM(f_{name}) <> ''" if name in _NAMES.values() else "FALSE"


def _quoted(text: str) -> str:
    return f"'{text}'"


def _count(names: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {_has(n)} THEN 1 ELSE 0 END" for n in names) + ")"


def _by_type(pick, other: str) -> str:
    return "CASE doc_type " + " ".join(f"WHEN '{k}' THEN {pick(*spec)}" for k, spec in co.REQUIRED.items()) + f" ELSE {other} END"


def _number(name: str) -> str:
    return f"TRY_CAST(REGEXP_REPLACE(f_{name}, '[$,]', '', 'g') AS DOUBLE)"


_ABN = "REGEXP_REPLACE(f_abn, '[^0-9]', '', 'g')"
_SUM = " + ".join(f"CAST(SUBSTR({_ABN}, {k + 2}, 1) AS INTEGER) * {w}" for k, w in enumerate(v.ABN_WEIGHTS))
_ABN_GOOD = f"CASE WHEN LENGTH({_ABN}) <> 11 THEN FALSE ELSE CAST(SUBSTR({_ABN}, 1, 1) AS INTEGER) >= 1 AND ((CAST(SUBSTR({_ABN}, 1, 1) AS INTEGER) - 1) * 10 + {_SUM}) % 89 = 0 END"
_PREFIX = "CAST(SUBSTR(REGEXP_REPLACE(f_bsb, '[^0-9]', '', 'g'), 1, 3) AS INTEGER)"
_BSB_GOOD = "CASE WHEN LENGTH(REGEXP_REPLACE(f_bsb, '[^0-9]', '', 'g')) <> 6 THEN FALSE ELSE " + " OR ".join(f"{_PREFIX} BETWEEN {lo} AND {hi}" for _, _, lo, hi in v.BANK_RANGES) + " END"
_DATE = "TRY_STRPTIME(REPLACE(f_date, '-', '/'), '%d/%m/%Y')"
_DATE_GOOD = f"COALESCE(EXTRACT(year FROM {_DATE}) BETWEEN 1950 AND {dq.THIS_YEAR + 2}, FALSE)"
_CHECKS = [("abn", _ABN_GOOD), ("bsb", _BSB_GOOD), ("date", _DATE_GOOD), *((a, f"COALESCE({_number(a)} >= 0, FALSE)") for a in co.AMOUNTS if a in _NAMES.values())]
_N_CHECKS = "(" + " + ".join(f"CASE WHEN {_has(n)} THEN 1 ELSE 0 END" for n, _ in _CHECKS) + ")"
_N_WRONG = "(" + " + ".join(f"CASE WHEN {_has(n)} AND NOT ({good}) THEN 1 ELSE 0 END" for n, good in _CHECKS) + ")"
_S, _G, _T = (_number(n) for n in ("subtotal", "gst_amount", "total_amount"))
_ADDS_UP = f"CASE WHEN {_G} = 0 AND {_T} = {_S} THEN TRUE ELSE {_S} >= 0 AND {_G} >= 0 AND {_T} >= 0 AND ABS({_G} - {_S} * 0.1E0) <= 0.005E0 AND ABS({_T} - ({_S} + {_S} * 0.1E0)) <= 0.005E0 END"
_TAX = f"CASE WHEN {_has('subtotal')} AND {_has('gst_amount')} AND {_has('total_amount')} THEN CASE WHEN {_S} IS NULL OR {_G} IS NULL OR {_T} IS NULL THEN 0.2E0 WHEN {_ADDS_UP} THEN 1.0E0 ELSE 0.3E0 END WHEN {_has('total_amount')} AND NOT {_has('gst_amount')} AND NOT {_has('subtotal')} THEN CASE WHEN {_T} IS NOT NULL THEN 0.7E0 ELSE 0.5E0 END ELSE 0.8E0 END"
_MUST = _by_type(lambda _, __, m: str(m), "FALSE")
_SPECIFIC = f"GREATEST(1.0E0 - (CASE WHEN {_MUST} AND NOT {_has('gst_amount')} THEN 0.4E0 ELSE 0 END + CASE WHEN {_MUST} AND NOT {_has('abn')} THEN 0.4E0 ELSE 0 END + CASE WHEN doc_type = 'fuel_receipt' AND NOT {_has('fuel_type')} THEN 0.2E0 ELSE 0 END + CASE WHEN doc_type = 'bank_statement' AND NOT ({_has('account_number')} AND {_has('bsb')}) THEN 0.3E0 ELSE 0 END + CASE WHEN doc_type = 'professional_services' AND NOT {_has('description')} THEN 0.2E0 ELSE 0 END), 0.0E0)"
_COMPLETE = _by_type(lambda req, opt, _: f"LEAST(CAST({_count(req)} AS DOUBLE) / {len(req)} + CAST({_count(opt)} AS DOUBLE) / {len(opt)} * 0.2E0, 1.0E0)", "0.5E0")
_LACKING = _by_type(lambda req, _, __: f"{_count(req)} < {len(req)}", "TRUE")
_TYPES = "CASE industry " + " ".join(f"WHEN '{k}' THEN [{', '.join(map(_quoted, t))}]" for k, t in reg.EXPECTED.items()) + " ELSE ['business_receipt', 'tax_invoice'] END"
_MISSING = "CASE industry " + " ".join(f"WHEN '{k}' THEN CASE WHEN {' AND '.join(f'f_{n} <> {chr(39)}{chr(39)}' if n in _NAMES.values() else 'FALSE' for n in names)} THEN 0 ELSE 1 END" for k, (_, names) in reg.NEEDED.items()) + " ELSE 0 END"
_KNOWN_ABN = "REGEXP_REPLACE(abn, '[^0-9]', '', 'g')"
_CONTEXT = f"CASE WHEN industry IS NULL THEN 1 ELSE CASE WHEN LIST_CONTAINS({_TYPES}, doc_type) THEN 0 ELSE 1 END + CASE WHEN f_abn <> '' AND abn <> '' AND {_ABN} <> {_KNOWN_ABN} THEN 1 ELSE 0 END + {_MISSING} END"

#: Common table expressions up to `graded`: components, score, issues and verdict of every receipt.
ASSESSED = (
    dq._FIELDS.rstrip()
    + f""", wide AS (SELECT doc_id, {_PIVOT} FROM kept GROUP BY doc_id),
 f AS (SELECT r.doc_id, r.doc_type, r.text, r.highlights_detected, {', '.join(f"COALESCE(w.f_{n}, '') AS f_{n}" for n in _NAMES.values())} FROM receipts r LEFT JOIN wide w ON w.doc_id = r.doc_id),
 low AS (SELECT doc_id AS id, LOWER(text) AS low FROM f), {dq._recognised('low')},
 shop AS (SELECT word, MIN(biz) AS biz FROM kw GROUP BY word),
 met AS (SELECT f.*, best.confidence AS seen, known.industry, known.abn FROM f LEFT JOIN best ON best.id = f.doc_id LEFT JOIN shop ON shop.word = LOWER(f.f_supplier_name) LEFT JOIN known ON known.biz = shop.biz),
 parts AS (SELECT *, {_COMPLETE} AS completeness, {_N_CHECKS} AS n_checks, {_N_WRONG} AS n_wrong, {_CONTEXT} AS n_context, {_TAX} AS tax, {_SPECIFIC} AS specific, {_LACKING} AS lacking FROM met),
 scored AS (SELECT *, CASE WHEN n_checks > 0 THEN 1.0E0 - CAST(n_wrong AS DOUBLE) / n_checks ELSE 1.0E0 END AS formats, CASE WHEN seen IS NOT NULL THEN seen * CASE WHEN n_context = 0 THEN 1.0E0 ELSE 0.5E0 END WHEN {_has('supplier_name')} THEN 0.3E0 ELSE 0.0E0 END AS business_score FROM parts),
 summed AS (SELECT *, 0.0E0 + completeness * 0.3E0 + formats * 0.25E0 + business_score * 0.2E0 + tax * 0.15E0 + specific * 0.1E0 AS compliance_score, CAST(CASE WHEN lacking THEN 1 ELSE 0 END + n_wrong + CASE WHEN seen IS NOT NULL THEN n_context ELSE 1 END + CASE WHEN tax IN (0.2, 0.3, 0.5) THEN 1 ELSE 0 END + CASE WHEN specific < 1 THEN 1 ELSE 0 END AS INT) AS n_issues FROM scored),
 graded AS (SELECT *, ROUND(compliance_score, 9) >= {co.PASS} AND n_issues <= {co.MOST_ISSUES} AS passed FROM summed) """
)
_ADVICE = f"CASE WHEN passed THEN '' ELSE CONCAT_WS(',', CASE WHEN ROUND(compliance_score, 9) < 0.3 THEN 'significant manual review' WHEN ROUND(compliance_score, 9) < 0.6 THEN 'additional validation' END, CASE WHEN {_has('abn')} AND NOT ({_ABN_GOOD}) THEN 'verify the ABN' END, CASE WHEN tax < 0.5 THEN 'check the GST sums' END, CASE WHEN seen IS NULL THEN 'verify the supplier' END) END"
COMPLIANCE = ASSESSED + "SELECT doc_id, " + ", ".join(f"ROUND({n}, 6) AS {n}" for n in [*co.WEIGHTS, "compliance_score"]) + f", n_issues, passed, {_ADVICE} AS advice FROM graded"

_KEPT = list(br.RENAMED.values())
_FULL = "(" + " + ".join(f"CASE WHEN f_{n} <> '' THEN 1 ELSE 0 END" for n in _KEPT) + ")"
_KINDS = "(" + " + ".join(f"CASE WHEN f_{n} <> '' THEN 1.0E0 ELSE 0.0E0 END" for n in cf.KEY_FIELDS if n in _KEPT) + " + CASE WHEN f_gst_amount <> '' THEN 0.5E0 ELSE 0.0E0 END)"
_QUALITY = f"LEAST(LEAST({_FULL} / 6.0E0, 1.0E0) * 0.6E0 + {_KINDS} / 5.0E0 * 0.4E0, 1.0E0)"
_OF = lambda words: "(" + " + ".join(f"CASE WHEN CONTAINS(LOWER(text), '{dq._sql(w)}') THEN 1 ELSE 0 END" for w in words) + ")"
_BUSINESS = f"LEAST(0.3E0 * {_OF(cf.BUSINESSES)} + 0.1E0 * {_OF(cf.PLACES)} + CASE WHEN CONTAINS(LOWER(text), 'abn') OR f_abn <> '' THEN 0.2E0 ELSE 0 END + CASE WHEN CONTAINS(LOWER(text), 'gst') OR f_gst_amount <> '' THEN 0.2E0 ELSE 0 END + CASE WHEN highlights_detected THEN 0.1E0 ELSE 0 END, 1.0E0)"


def _listed(pairs: list[tuple[str, str]], ordered: bool = False) -> str:
    items = sorted(pairs, key=lambda p: p[1]) if ordered else pairs
    return "CONCAT_WS(',', " + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in items) + ")"


_FEW, _BELOW = f"n_fields < {cf.LEAST_FIELDS}", f"ROUND(raw, 9) < {cf.PRODUCTION}"
_FLAGS = _listed([(f"class_score < {cf.LEAST_CLASS}", "low_classification_confidence"), (_FEW, "insufficient_fields"), (f"compliance_score < {cf.LEAST_COMPLIANCE}", "low_ato_compliance"), ("NOT passed", "ato_compliance_failed"), ("business < 0.3", "low_business_recognition"), (_BELOW, "below_production_threshold")])
_TOLD = _listed([("class_score < 0.6", "verify the document type"), ("extraction < 0.6", "review extracted fields"), ("compliance_score < 0.6", "verify compliance"), ("business < 0.5", "verify the business"), (_BELOW, "below production threshold"), ("NOT passed", "compliance failed"), (_FEW, "insufficient fields"), ("final >= 0.9", "ready for automated processing"), ("final < 0.9 AND final >= 0.7", "needs manual review"), ("final < 0.7", "needs manual processing")], ordered=True)
_CLASSES = " UNION ALL ".join(f"SELECT doc_id, {k} AS ord, '{kind}' AS type, {dq._score(kind)} AS score FROM c_low" for k, kind in enumerate(cl.KEYWORDS))
PIPELINE = (
    ASSESSED.rstrip()
    + f""", c_low AS (SELECT doc_id, LOWER(text) AS low FROM receipts), c_all AS ({_CLASSES}), c_best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS place FROM c_all),
 c AS (SELECT doc_id, CASE WHEN score < 0.3 THEN 'other' ELSE type END AS predicted, score AS class_score FROM c_best WHERE place = 1),
 q AS (SELECT g.*, c.predicted, c.class_score, {_QUALITY} AS extraction, {_BUSINESS} AS business, {_FULL} AS n_fields FROM graded g JOIN c ON c.doc_id = g.doc_id),
 s AS (SELECT *, class_score * 0.25E0 + extraction * 0.35E0 + compliance_score * 0.25E0 + business * 0.15E0 AS raw FROM q),
 o AS (SELECT *, CASE WHEN NOT passed THEN LEAST(CASE WHEN class_score < {cf.LEAST_CLASS} THEN LEAST(raw, 0.5E0) ELSE raw END, 0.4E0) WHEN class_score < {cf.LEAST_CLASS} THEN LEAST(raw, 0.5E0) ELSE raw END AS overall FROM s),
 z AS (SELECT *, ROUND(overall, 9) AS final FROM o)
 SELECT doc_id, predicted, ROUND(extraction, 6) AS extraction, ROUND(business, 6) AS business, ROUND(compliance_score, 6) AS compliance_score, ROUND(overall, 6) AS overall, CASE WHEN final >= 0.9 THEN 'excellent' WHEN final >= 0.7 THEN 'good' WHEN final >= 0.5 THEN 'fair' WHEN final >= 0.3 THEN 'poor' ELSE 'very_poor' END AS grade, final >= {cf.PRODUCTION} AS production_ready, {_FLAGS} AS flags, {_TOLD} AS advice FROM z"""
)
ORACLES = {"a1_compliance": COMPLIANCE, "e1_document_pipeline": PIPELINE}

#: A batch: which papers fail, where and why, and the grades of all others.
_TRIMMED = "TRIM(text, ' ' || CHR(9) || CHR(10) || CHR(13))"
_LABELLED = lambda pattern: f"REGEXP_EXTRACT_ALL(text, '{dq._sql(pattern)}', 1)"
_BAD_NUMBER = f"LIST_FILTER({_LABELLED(br.AMOUNTS)}, lambda x: TRY_CAST(REGEXP_REPLACE(x, '[$,]', '', 'g') AS DOUBLE) IS NULL)[1]"
_DAY = "TRY_STRPTIME(x, ['%d/%m/%Y', '%d-%m-%Y'])"
_BAD_DAY = f"LIST_FILTER({_LABELLED(br.DAYS)}, lambda x: {_DAY} IS NULL OR YEAR({_DAY}) NOT BETWEEN 1950 AND {dq.THIS_YEAR + 2})[1]"
_STAGED = with_views("", "broken_receipts").rstrip() + f""", staged AS (SELECT *, CASE WHEN text IS NULL THEN 'load|TypeError: no text' WHEN {_TRIMMED} = '' THEN 'load|ValueError: empty text' WHEN doc_type NOT IN ({", ".join(f"'{t}'" for t in ex.TYPES)}) THEN 'type|ValueError: unknown document type ' || doc_type
  WHEN {_BAD_NUMBER} IS NOT NULL THEN 'amounts|NumberError: ' || {_BAD_NUMBER} WHEN {_BAD_DAY} IS NOT NULL THEN 'dates|DateError: ' || {_BAD_DAY} END AS failure FROM broken_receipts),
 split AS (SELECT *, SPLIT_PART(failure, '|', 1) AS failed_stage, SPLIT_PART(failure, '|', 2) AS error FROM staged)"""
_WELL = PIPELINE.replace(VIEWS["receipts"], f"SELECT doc_id, COALESCE(doc_type, 'other') AS doc_type, 0 AS compliance_score, highlights_detected, text FROM ({_STAGED} SELECT * FROM split WHERE failure IS NULL) ok")
ORACLES["e2_batch"] = f"""SELECT doc_id, NULL AS failed_stage, NULL AS error, predicted, extraction, business, compliance_score, overall, grade, production_ready, flags, advice FROM ({_WELL}) w
 UNION ALL SELECT doc_id, failed_stage, error, 'error', 0, 0, 0, 0, 'very_poor', FALSE, '{br.FLAG}', '{br.ADVICE}' FROM ({_STAGED} SELECT * FROM split WHERE failure IS NOT NULL) f"""
ORACLES["e2_failures"] = _STAGED + " SELECT failed_stage, SPLIT_PART(error, ':', 1) AS error_type, COUNT(*) AS n FROM split WHERE failure IS NOT NULL GROUP BY 1, 2"
