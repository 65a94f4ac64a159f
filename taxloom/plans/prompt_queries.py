"""Queries over prompts: selection, building, validation of a library."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxloom.operators import prompt_checks as pc
from taxloom.operators import prompt_library as pl
from taxloom.operators import texts as tx
from taxloom.plans.handler_queries import _q
from taxloom.plans.result_queries import rounded
from taxloom.sources.views import view, with_views


def selected(spark, d):
    docs = view(spark, d, "asked").select("doc_id", "doc_type", "response", "model")
    out = pl.selected(docs, pl.library_of(spark, pl.OWN))
    return out.select("doc_id", "wanted", "tier", "found_name", F.md5("prompt").alias("prompt"))


def tiered(spark, d):
    """As selected, from a library without most of the wanted prompts, through all tiers."""
    docs = view(spark, d, "asked").select("doc_id", "doc_type", "response", "model")
    few = {k: v for k, v in pl.OWN.items() if k in _FEW}
    out = pl.selected(docs, pl.library_of(spark, few), pl.TIERS)
    return out.select("doc_id", "tier", "found_name", F.md5("prompt").alias("prompt"))


def built(spark, d):
    docs = view(spark, d, "asked").select("doc_id", "doc_type", "highlights", "quality", "prefer")
    out = pl.built(docs, view(spark, d, "prompt_runs"), pl.bases_of(spark, pl.BASES))
    return out.select("doc_id", "strategy", "tier", F.length("prompt").alias("size"), F.md5("prompt").alias("prompt"))


def judged(spark, d):
    out = pc.judged(view(spark, d, "prompts"))
    return rounded(out.select("prompt_id", "doc_type", "effectiveness", "compatibility", "score", "passed", F.array_join("issues", ",").alias("issues")), "effectiveness", "compatibility", "score")


def report(spark, d):
    out = pc.library_report(pc.judged(view(spark, d, "prompts")))
    return rounded(out.withColumn("recommendations", F.array_join("recommendations", "; ")), "average")


_FEW = ["factual_information_prompt", "meal_receipt_extraction_prompt", "tax_invoice_extraction_prompt"]

QUERIES = {
    "e11_prompt_selection": selected,
    "e11_prompt_tiers": tiered,
    "e12_built_prompts": built,
    "d15_prompt_checks": judged,
    "g29_library_report": report,
    "g34_prompt_counts": lambda s, d: pc.counts_by_type(view(s, d, "prompts")),
}


def _s(text: str) -> str:
    return _q(text).replace("\n", "' || CHR(10) || '")


def _any(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"CONTAINS({low}, {_q(w)})" for w in words) + ")"


_ROUTED = "CASE " + " ".join(f"WHEN {_any('low', ws)} THEN '{k}_extraction_prompt'" for k, ws in tx.ROUTES) + " WHEN doc_type IN ('business_receipt', 'fuel_receipt', 'tax_invoice', 'bank_statement') THEN doc_type || '_extraction_prompt' ELSE 'business_receipt_extraction_prompt' END"
_WANTED = with_views("", "asked").rstrip() + f", w AS (SELECT *, {_ROUTED} AS wanted FROM (SELECT *, LOWER(COALESCE(response, '')) AS low FROM asked) a)"
_LIST = lambda prompts: ", ".join(f"({_q(k)}, {_s(v)})" for k, v in prompts.items())


def _found(prompts: dict[str, str], tiers: list[str]) -> str:
    each = " UNION ALL ".join(["SELECT doc_id, model, 0 AS tier, wanted AS name FROM w", *[f"SELECT doc_id, model, {i + 1}, '{n}' FROM w" for i, n in enumerate(tiers)]])
    shown = f"CASE WHEN model = 'llama32_vision' AND NOT STARTS_WITH(text, '{pl.IMAGE}') THEN '{pl.IMAGE}' || text ELSE text END"
    return f""", lib(name, text) AS (VALUES {_LIST(prompts)}), got AS (SELECT doc_id, MIN(tier) AS tier, ARG_MIN(name, tier) AS name, ARG_MIN({shown}, tier) AS text FROM ({each}) t JOIN lib USING (name) GROUP BY doc_id)
 SELECT w.doc_id, wanted, CAST(tier AS INT) AS tier, got.name AS found_name, MD5(COALESCE(got.text, CASE WHEN model = 'llama32_vision' THEN {_s(pl.LAST_WITH_IMAGE)} ELSE {_s(pl.LAST)} END)) AS prompt FROM w LEFT JOIN got ON got.doc_id = w.doc_id"""


_BASE = "lib(strategy, doc_type, text) AS (VALUES " + ", ".join(f"({_q(a) if a else 'NULL'}, {_q(b) if b else 'NULL'}, {_s(t)})" for a, b, t in pl.BASES) + ")"


def _lookup(by: str) -> str:
    order = f"CASE WHEN l.strategy IS NOT NULL AND l.doc_type IS NOT NULL THEN 0 WHEN l.strategy IS NOT NULL THEN 1 WHEN l.doc_type IS NOT NULL THEN 2 ELSE 3 END"  # noqa: F541
    return f"(SELECT MIN({{'t': {order}, 'text': l.text}}) FROM lib l WHERE (l.strategy IS NULL OR l.strategy = {by}) AND (l.doc_type IS NULL OR l.doc_type = k.doc_type))"


_TYPE = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN {_s(chr(10) + v)}" for k, v in pl.ON_TYPE.items()) + " ELSE '' END"
_BUILT = with_views("", "asked", "prompt_runs").rstrip() + f""", {_BASE}, used AS (SELECT doc_type, strategy, COUNT(*) AS n FROM prompt_runs GROUP BY doc_type, strategy),
 best AS (SELECT doc_type, strategy AS best FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_type ORDER BY n DESC, strategy) AS k FROM used) u WHERE k = 1),
 how AS (SELECT a.*, CASE WHEN quality < 0.5 THEN 'specialized' WHEN a.doc_type = 'bank_statement' AND highlights THEN 'highlight_enhanced' WHEN a.doc_type IN ('tax_invoice', 'business_receipt') AND prefer THEN 'ato_compliance' WHEN a.doc_type IN ('fuel_receipt', 'parking_toll') THEN 'specialized' WHEN best IS NOT NULL THEN best WHEN prefer THEN 'ato_compliance' ELSE 'specialized' END AS strategy FROM asked a LEFT JOIN best ON best.doc_type = a.doc_type),
 keys AS (SELECT k.*, {_lookup("k.strategy")} AS own, {_lookup("'ato_compliance'")} AS ato, {_lookup("'base'")} AS plain FROM (SELECT DISTINCT strategy, doc_type FROM how) k),
 full_ AS (SELECT doc_id, h.strategy, own.t AS tier, CASE WHEN h.strategy IN ('ato_compliance', 'highlight_enhanced', 'specialized') THEN own.text ELSE {_s(pl.UNIFIED_HEAD)} || ato.text || {_s(pl.UNIFIED_MIDDLE)} || plain.text || {_s(pl.UNIFIED_TAIL)} END
  || CASE WHEN highlights THEN {_s(pl.ON_HIGHLIGHTS)} ELSE '' END || CASE WHEN quality < 0.3 THEN {_s(pl.ON_POOR_QUALITY)} ELSE '' END || {_TYPE.replace("doc_type", "h.doc_type")} AS prompt FROM how h JOIN keys k ON k.strategy = h.strategy AND k.doc_type = h.doc_type)
 SELECT doc_id, strategy, CAST(tier AS INT) AS tier, CAST(LENGTH(prompt) AS INT) AS size, MD5(prompt) AS prompt FROM full_"""

_NAMED = "CASE " + " ".join(f"WHEN CONTAINS(LOWER(prompt_id), '{part}') THEN '{kind}'" for part, kind in pl.NAMED_TYPES) + " ELSE 'other' END"
_WORD = lambda w: f"CASE WHEN REGEXP_MATCHES(text, {_q(rf'(?i)\b{w}\b')}) THEN 1 ELSE 0 END"
_HELD = lambda ws: "(" + " + ".join(map(_WORD, ws)) + ")"
_SHARE = "CASE doc_type " + " ".join(f"WHEN '{k}' THEN CAST({_HELD(ws)} AS DOUBLE) / {len(ws)}" for k, ws in pc.TYPE_WORDS.items()) + " END"
_LIKE = lambda p: f"REGEXP_MATCHES(text, '(?i){p}')"
_RULES = [
    ("structure", "critical", 0.5, "LENGTH(text) < 100"),
    ("structure", "warning", 0.2, "LENGTH(text) > 4000"),
    ("structure", "warning", 0.1, f"NOT {_LIKE('(?:extract|analyze|process)')}"),
    ("structure", "minor", 0.05, f"NOT {_LIKE('(?:requirements?|fields?|information):')}"),
    ("content", "warning", 0.3, "COALESCE(share < 0.5, FALSE)"),
    ("content", "minor", 0.1, "COALESCE(share >= 0.5 AND share < 0.8, FALSE)"),
    ("content", "warning", 0.1, f"NOT {_LIKE('(?:format|structure|json|output)')}"),
    ("internvl3", "minor", 0.1, "LENGTH(text) NOT BETWEEN 500 AND 2000"),
    ("internvl3", "warning", 0.2, f"{_HELD(['extract', 'analyze', 'image'])} < 3"),
    ("llama32", "minor", 0.1, "LENGTH(text) NOT BETWEEN 300 AND 1500"),
    ("llama32", "warning", 0.2, f"{_HELD(['compliance', 'ato', 'business'])} < 3"),
    ("llama32", "warning", 0.2, "CONTAINS(low, 'highlight')"),
    ("compliance", "warning", 0.3, f"{_HELD(['australian', 'ato', 'gst', 'abn', 'business'])} < 2"),
    ("compliance", "minor", 0.1, "CONTAINS(low, 'gst') AND NOT CONTAINS(text, '10%')"),
    ("compliance", "minor", 0.1, "CONTAINS(low, 'date') AND NOT CONTAINS(low, 'dd/mm/yyyy')"),
    ("compliance", "minor", 0.1, "CONTAINS(low, 'abn') AND NOT CONTAINS(low, 'xx xxx xxx xxx')"),
]
_ISSUE = [f"{'compatibility' if k in ('internvl3', 'llama32') else k}_{s}" for k, s, _, _ in _RULES]
_PART = lambda kind: "GREATEST(1.0E0 - (" + " + ".join(f"CASE WHEN r{i} THEN {p}E0 ELSE 0 END" for i, (k, _, p, _) in enumerate(_RULES) if k == kind) + "), 0)"
_JUDGED = with_views("", "prompts").rstrip() + f""", p AS (SELECT prompt_id, COALESCE(text, '') AS text, LOWER(COALESCE(text, '')) AS low, {_NAMED} AS doc_type FROM prompts), q AS (SELECT *, {_SHARE} AS share FROM p),
 r AS (SELECT prompt_id, doc_type, {", ".join(f"{c} AS r{i}" for i, (_, _, _, c) in enumerate(_RULES))} FROM q),
 s AS (SELECT prompt_id, doc_type, ({_PART("structure")} + {_PART("content")} + {_PART("compliance")}) / 3 AS effectiveness, ({_PART("internvl3")} + {_PART("llama32")}) / 2 AS compatibility, LIST_FILTER([{", ".join(f"CASE WHEN r{i} THEN '{n}' END" for i, n in enumerate(_ISSUE))}], lambda x: x IS NOT NULL) AS issues, r0 FROM r),
 v AS (SELECT *, (effectiveness + compatibility) / 2 AS score, ROUND((effectiveness + compatibility) / 2, 9) >= 0.7 AND NOT r0 AS passed FROM s)"""
_KINDS = list(dict.fromkeys(_ISSUE))

ORACLES = {
    "e11_prompt_selection": _WANTED + _found(pl.OWN, list(pl.FALLBACK)[:1]),
    "e11_prompt_tiers": "SELECT * EXCLUDE (wanted) FROM (" + _WANTED + _found({k: v for k, v in pl.OWN.items() if k in _FEW}, pl.TIERS) + ") t",
    "e12_built_prompts": _BUILT,
    "d15_prompt_checks": _JUDGED + " SELECT prompt_id, doc_type, ROUND(effectiveness, 6) AS effectiveness, ROUND(compatibility, 6) AS compatibility, ROUND(score, 6) AS score, passed, ARRAY_TO_STRING(issues, ',') AS issues FROM v",
    "g29_library_report": _JUDGED
    + f""", n AS (SELECT kind, COUNT(*) AS n, MIN({{'p': prompt_id, 'k': k}}) AS first FROM (SELECT prompt_id, UNNEST(issues) AS kind, GENERATE_SUBSCRIPTS(issues, 1) AS k FROM v) u GROUP BY kind),
 t AS (SELECT COUNT(*) AS total, COUNT(CASE WHEN passed THEN 1 END) AS passed, COUNT(CASE WHEN NOT passed THEN 1 END) AS failed, AVG(score) AS average FROM v), top AS (SELECT kind, n FROM n ORDER BY n DESC, first LIMIT 1)
 SELECT total, passed, failed, ROUND(average, 6) AS average, {", ".join(f"COALESCE((SELECT n FROM n WHERE kind = '{k}'), 0) AS {k}" for k in _KINDS)}, kind AS most_common,
 CONCAT_WS('; ', CASE WHEN ROUND(average, 9) < 0.7 THEN 'Overall prompt quality below threshold - review and improve prompts' END, CASE WHEN failed > passed THEN 'More prompts failed than passed - significant improvements needed' END, 'Most common issue: ' || kind || ' (' || CAST(top.n AS VARCHAR) || ' occurrences)') AS recommendations FROM t CROSS JOIN top""",
    "g34_prompt_counts": with_views(f"SELECT {_NAMED} AS doc_type, COUNT(*) AS prompts FROM prompts GROUP BY 1", "prompts"),
}
