"""Queries that compare models: significance by Welch's test, fairness, and both beside ranking and deployment."""

from __future__ import annotations

from taxloom.operators import batch, comparison
from taxloom.plans.result_queries import _RANKED, rounded
from taxloom.sources.views import view, with_views

METRICS = ["precision_score", "recall_score", "f1_score", "confidence_score", "ato_compliance_score", "processing_time"]


def _done(spark, d):
    return view(spark, d, "results").filter("success")


def significance(spark, d):
    out = comparison.significance(_done(spark, d), METRICS)
    return rounded(out, "difference", "t", "df", "p_value", "low", "high", "effect")


def fairness(spark, d):
    out = comparison.fairness(comparison.settings_of(view(spark, d, "extractions"), view(spark, d, "results")))
    return rounded(out.selectExpr("* except (issues)", "array_join(issues, '; ') AS issues"), "score")


def full_comparison(spark, d):
    out = comparison.full_comparison(batch.dataset_metrics(view(spark, d, "results")), _done(spark, d), view(spark, d, "extractions"), METRICS)
    return rounded(out, "fairness")


QUERIES = {"d14_significance": significance, "d2_fairness": fairness, "e8_full_comparison": full_comparison}

#: Simpson's rule over 20,000 steps, up to 40 standard deviations.
_STEPS = 20_000
_Z = 1.959963984540054
_QUANTILE = f"({_Z} + {(_Z**3 + _Z) / 4} / df + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / (df * df) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / (df * df * df))"
_MOMENTS = " UNION ALL ".join(f"SELECT '{m}' AS metric, model, COUNT({m}) AS n, AVG({m}) AS mean, VAR_SAMP({m}) AS var FROM results WHERE success GROUP BY model" for m in METRICS)
_TESTED = f"""moments AS ({_MOMENTS}),
 pairs AS (SELECT a.metric, a.model AS model1, b.model AS model2, a.n AS n1, b.n AS n2, a.mean - b.mean AS difference, a.var / a.n AS s1, b.var / b.n AS s2, SQRT(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)) AS pooled FROM moments a JOIN moments b ON b.metric = a.metric AND a.model < b.model),
 welch AS (SELECT *, difference / SQRT(s1 + s2) AS t, (s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) AS df FROM pairs),
 points AS (SELECT metric, model1, model2, df, LEAST(ABS(t), 40) / {_STEPS} AS step, UNNEST(GENERATE_SERIES(0, {_STEPS})) AS k FROM welch),
 areas AS (SELECT metric, model1, model2, SUM(CASE WHEN k IN (0, {_STEPS}) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * EXP(LGAMMA((df + 1) / 2) - LGAMMA(df / 2) - 0.5 * LN(df * PI()) - (df + 1) / 2 * LN(1 + step * k * step * k / df)) * step / 3) AS half FROM points GROUP BY metric, model1, model2),
 tested AS (SELECT w.*, GREATEST(1 - 2 * half, 0) AS p_value, {_QUANTILE} * SQRT(s1 + s2) AS reach FROM welch w JOIN areas a ON a.metric = w.metric AND a.model1 = w.model1 AND a.model2 = w.model2)"""
_SETTINGS = """asked AS (SELECT model, LIST(DISTINCT doc_id ORDER BY doc_id) AS docs, LIST(DISTINCT field ORDER BY field) AS fields FROM extractions GROUP BY model),
 ready AS (SELECT model, MIN(CASE WHEN production_ready THEN confidence_score END) AS threshold FROM results GROUP BY model),
 set_ AS (SELECT a.*, threshold FROM asked a LEFT JOIN ready r ON r.model = a.model),
 fair AS (SELECT a.model AS model1, b.model AS model2, a.fields = b.fields AS identical_pipeline, a.docs = b.docs AS standardized_prompts, a.threshold IS NOT DISTINCT FROM b.threshold AS same_confidence_thresholds FROM set_ a JOIN set_ b ON a.model < b.model)"""
_SCORE = "(CASE WHEN identical_pipeline THEN 1.0E0 ELSE 0 END + CASE WHEN standardized_prompts THEN 1 ELSE 0 END + CASE WHEN same_confidence_thresholds THEN 1 ELSE 0 END) / 3"
_ALL_FAIR = "identical_pipeline AND standardized_prompts AND same_confidence_thresholds"
_USES = "CONCAT_WS(',', CASE WHEN processing_speed > 0.5 THEN 'real_time_processing' END, CASE WHEN average_f1 > 0.85 THEN 'high_accuracy_requirements' END, CASE WHEN production_ready_rate > 0.8 THEN 'automated_processing' END)"

ORACLES = {
    "d14_significance": with_views("", "results").rstrip() + f", {_TESTED} SELECT metric, model1, model2, n1, n2, ROUND(difference, 6) AS difference, ROUND(t, 6) AS t, ROUND(df, 6) AS df, ROUND(p_value, 6) AS p_value, p_value < 0.05 AS significant, ROUND(difference - reach, 6) AS low, ROUND(difference + reach, 6) AS high, ROUND(difference / pooled, 6) AS effect FROM tested",
    "d2_fairness": with_views("", "extractions", "results").rstrip()
    + f", {_SETTINGS} SELECT *, ROUND({_SCORE}, 6) AS score, CASE WHEN {_ALL_FAIR} THEN 'low' ELSE 'medium' END AS bias_risk, CASE WHEN {_ALL_FAIR} THEN 'Configuration ensures fair model comparison' ELSE 'Enable all fairness settings for unbiased comparison' END AS recommendation, "
    + "CONCAT_WS('; ', "
    + ", ".join(f"CASE WHEN NOT {c} THEN 'Missing: {t}' END" for c, t in comparison.FAIRNESS.items())
    + ") AS issues FROM fair",
    "e8_full_comparison": with_views("", "extractions", "results").rstrip()
    + f""", {_RANKED}, {_TESTED}, {_SETTINGS}, hits AS (SELECT model1 AS model, (difference > 0) <> (metric = 'processing_time') AS better FROM tested WHERE p_value < 0.05 UNION ALL SELECT model2, (difference < 0) <> (metric = 'processing_time') FROM tested WHERE p_value < 0.05),
 won AS (SELECT model, COUNT(CASE WHEN better THEN 1 END) AS better, COUNT(CASE WHEN NOT better THEN 1 END) AS worse FROM hits GROUP BY model),
 least AS (SELECT model, MIN(score) AS fairness FROM (SELECT model1 AS model, {_SCORE} AS score FROM fair UNION ALL SELECT model2, {_SCORE} FROM fair) f GROUP BY model)
 SELECT f.model, CAST(overall_rank AS INT) AS overall_rank, CASE WHEN overall_rank = 1 THEN CASE WHEN production_ready_rate >= 0.9 THEN 'ready' WHEN production_ready_rate >= 0.7 THEN 'conditional' ELSE 'not_ready' END END AS status,
  CASE WHEN overall_rank = 1 THEN CASE WHEN production_ready_rate >= 0.9 THEN 'high' WHEN production_ready_rate >= 0.7 THEN 'medium' END END AS confidence, {_USES} AS use_cases, COALESCE(better, 0) AS better, COALESCE(worse, 0) AS worse, ROUND(fairness, 6) AS fairness
 FROM final f LEFT JOIN won w ON w.model = f.model LEFT JOIN least l ON l.model = f.model""",
}
