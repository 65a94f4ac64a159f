"""Queries over processing results, model comparison and prompt strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxloom.operators import batch, comparison, prompts
from taxloom.sources.views import view, with_views

_GRADE = "CASE WHEN confidence_score >= 0.9 THEN 'excellent' WHEN confidence_score >= 0.7 THEN 'good' WHEN confidence_score >= 0.5 THEN 'fair' WHEN confidence_score >= 0.3 THEN 'poor' ELSE 'very_poor' END"


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    """Doubles whose last bits depend on the order of summation, cut to `places`."""
    return df.withColumns({n: F.round(n, places) for n in names})


def _results(spark, d):
    return view(spark, d, "results")


def _models(spark, d):
    return batch.dataset_metrics(_results(spark, d))


def batch_summary(spark, d):
    out = batch.summary(_results(spark, d), ["model"])
    return rounded(out, "success_rate", "total_processing_time", "average_confidence", "ready_rate", "average_processing_time", "awk_fallback_rate", "average_highlights", "average_ato", "documents_per_second")


def dataset_summary(spark, d):
    return rounded(_models(spark, d), "average_precision", "average_recall", "average_f1", "average_confidence", "average_processing_time", "total_processing_time", "production_ready_rate", "awk_fallback_rate", "highlight_rate")


def efficiency(spark, d):
    base, ratio, level = batch.efficiency(F.col("processing_time"), F.col("highlights_detected") / 2)
    return rounded(_results(spark, d).select("doc_id", base.alias("baseline"), ratio.alias("ratio"), level.alias("level")), "ratio")


def top_documents(spark, d):
    rows = _results(spark, d).filter("success").orderBy(F.desc("confidence_score"), "doc_id").limit(10)
    return rows.select("doc_id", "model", "confidence_score")


def production_status(spark, d):
    status = batch.production_status(F.col("confidence_score"), 0.7)
    return _results(spark, d).groupBy("model", status.alias("status")).agg(F.count("*").alias("n"))


def monitor(spark, d):
    s = batch.summary(_results(spark, d), ["model"])
    lights = [batch.traffic_light(F.round(k, 9), t).alias(k) for k, t in batch.TARGETS.items()]
    return s.select("model", *lights)


def ranking(spark, d):
    names = [f"rank_{m}" for m in comparison.WEIGHTS]
    return rounded(comparison.rankings(_models(spark, d)).select("model", *names, "overall_score", "overall_rank"), "overall_score")


def pairwise(spark, d):
    return rounded(comparison.pairwise(_models(spark, d)), "f1_difference", "time_difference")


def parity(spark, d):
    return rounded(comparison.parity(_models(spark, d)), "f1_std", "f1_cv", "time_std", "time_cv")


def speeds(spark, d):
    return rounded(comparison.speeds(_models(spark, d)), "documents_per_second", "accuracy_per_second", "relative_speed")


def deployment(spark, d):
    return comparison.deployment(comparison.rankings(_models(spark, d)))


def best_model(spark, d):
    return comparison.best_by_f1(_models(spark, d)).select("model", "average_f1")


def first_failures(spark, d):
    return batch.first_failures(_results(spark, d)).select("model", "place", "doc_id", batch.error_type(F.col("error")).alias("error_type"))


def strategies(spark, d):
    return rounded(prompts.by_strategy(view(spark, d, "prompt_runs")), "average", "least", "most", places=9)


def optimal(spark, d):
    return rounded(prompts.optimal(prompts.by_strategy(view(spark, d, "prompt_runs"))), "average", "least", "most")


def prompt_comparison(spark, d):
    return rounded(prompts.comparison(prompts.by_strategy(view(spark, d, "prompt_runs")), "detailed", "concise"), "average_a", "average_b", "certainty")


_MODELS = """models AS (SELECT model,
 COALESCE(AVG(CASE WHEN success THEN precision_score END), 0) AS average_precision, COALESCE(AVG(CASE WHEN success THEN recall_score END), 0) AS average_recall,
 COALESCE(AVG(CASE WHEN success THEN f1_score END), 0) AS average_f1, COALESCE(AVG(CASE WHEN success THEN confidence_score END), 0) AS average_confidence,
 COALESCE(AVG(CASE WHEN success THEN processing_time END), 0) AS average_processing_time, SUM(processing_time) AS total_processing_time, COUNT(*) AS total_documents,
 COUNT(CASE WHEN success AND production_ready THEN 1 END) AS production_ready_count,
 AVG(CASE WHEN success THEN CASE WHEN production_ready THEN 1.0 ELSE 0.0 END END) AS production_ready_rate,
 AVG(CASE WHEN success THEN CASE WHEN awk_fallback_used THEN 1.0 ELSE 0.0 END END) AS awk_fallback_rate,
 AVG(CASE WHEN success THEN CASE WHEN highlights_detected > 0 THEN 1.0 ELSE 0.0 END END) AS highlight_rate
 FROM results GROUP BY model)"""
_RANKED = _MODELS + """, sped AS (SELECT *, 1.0 / average_processing_time AS processing_speed FROM models),
ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY average_f1 DESC, model) AS rank_average_f1, ROW_NUMBER() OVER (ORDER BY average_precision DESC, model) AS rank_average_precision,
 ROW_NUMBER() OVER (ORDER BY average_recall DESC, model) AS rank_average_recall, ROW_NUMBER() OVER (ORDER BY production_ready_rate DESC, model) AS rank_production_ready_rate,
 ROW_NUMBER() OVER (ORDER BY processing_speed DESC, model) AS rank_processing_speed, COUNT(*) OVER () AS n FROM sped),
total AS (SELECT *, 0.3 * (n + 1 - rank_average_f1) + 0.2 * (n + 1 - rank_average_precision) + 0.2 * (n + 1 - rank_average_recall) + 0.2 * (n + 1 - rank_production_ready_rate) + 0.1 * (n + 1 - rank_processing_speed) AS overall_score FROM ranked),
final AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ROUND(overall_score, 9) DESC, model) AS overall_rank FROM total)"""


def _with(ctes: str, sql: str) -> str:
    return with_views("", "results").rstrip() + ", " + ctes + " " + sql


_STRATEGY = "strategies AS (SELECT doc_type, strategy, COUNT(*) AS samples, AVG(0.4 * confidence + 0.6 * accuracy) AS average, MIN(0.4 * confidence + 0.6 * accuracy) AS least, MAX(0.4 * confidence + 0.6 * accuracy) AS most FROM prompt_runs GROUP BY doc_type, strategy)"
_PROMPT = with_views("", "prompt_runs").rstrip() + ", " + _STRATEGY + " "

QUERIES = {
    "g12_batch_summary": batch_summary,
    "g12_quality_histogram": lambda s, d: batch.histogram(_results(s, d), ["model"]),
    "p25_error_taxonomy": lambda s, d: batch.errors(_results(s, d), ["model"]),
    "g11_dataset_summary": dataset_summary,
    "g9_efficiency": efficiency,
    "r7_top_documents": top_documents,
    "q8_production_status": production_status,
    "t1_monitor_lights": monitor,
    "r1_model_ranking": ranking,
    "j13_pairwise_models": pairwise,
    "g24_parity": parity,
    "g25_speeds": speeds,
    "d1_deployment": deployment,
    "d3_recommendations": lambda s, d: comparison.recommendations(_models(s, d)),
    "r10_best_model": best_model,
    "d6_first_failures": first_failures,
    "g27_strategies": strategies,
    "r9_optimal_strategy": optimal,
    "g28_prompt_summary": lambda s, d: prompts.summary(view(s, d, "prompt_runs")),
    "d11_strategy_comparison": prompt_comparison,
    "d12_prompt_advice": lambda s, d: prompts.advice(prompts.by_strategy(view(s, d, "prompt_runs"))),
}

ORACLES = {
    "g12_batch_summary": with_views(
        """SELECT *, ready_rate >= 0.8 AS overall_ready FROM (SELECT model, COUNT(*) AS total_documents, COUNT(CASE WHEN success THEN 1 END) AS successful, COUNT(CASE WHEN NOT success THEN 1 END) AS failed,
 ROUND(AVG(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, ROUND(SUM(processing_time), 6) AS total_processing_time,
 ROUND(AVG(CASE WHEN success THEN confidence_score END), 6) AS average_confidence, MIN(CASE WHEN success THEN confidence_score END) AS min_confidence, MAX(CASE WHEN success THEN confidence_score END) AS max_confidence,
 COUNT(CASE WHEN success AND confidence_score >= 0.7 THEN 1 END) AS above_threshold, COUNT(CASE WHEN success AND confidence_score < 0.7 THEN 1 END) AS below_threshold,
 COUNT(CASE WHEN success AND production_ready THEN 1 END) AS ready_count, ROUND(AVG(CASE WHEN success THEN CASE WHEN production_ready THEN 1.0 ELSE 0.0 END END), 6) AS ready_rate,
 ROUND(AVG(CASE WHEN success THEN processing_time END), 6) AS average_processing_time, MIN(CASE WHEN success THEN processing_time END) AS min_processing_time, MAX(CASE WHEN success THEN processing_time END) AS max_processing_time,
 ROUND(AVG(CASE WHEN success THEN CASE WHEN awk_fallback_used THEN 1.0 ELSE 0.0 END END), 6) AS awk_fallback_rate, ROUND(AVG(CASE WHEN success THEN highlights_detected END), 6) AS average_highlights,
 ROUND(AVG(CASE WHEN success THEN ato_compliance_score END), 6) AS average_ato, COUNT(CASE WHEN success AND ato_compliance_score >= 0.8 THEN 1 END) AS high_compliance,
 ROUND(COUNT(CASE WHEN success THEN 1 END) / SUM(processing_time), 6) AS documents_per_second FROM results GROUP BY model) t""",
        "results",
    ),
    "g12_quality_histogram": with_views(f"SELECT model, {_GRADE} AS grade, COUNT(*) AS n FROM results WHERE success GROUP BY 1, 2", "results"),
    "p25_error_taxonomy": with_views("SELECT model, SPLIT_PART(COALESCE(error, 'Unknown error'), ':', 1) AS error_type, COUNT(*) AS n FROM results WHERE NOT success GROUP BY 1, 2", "results"),
    "g11_dataset_summary": _with(_MODELS, "SELECT model, ROUND(average_precision, 6) AS average_precision, ROUND(average_recall, 6) AS average_recall, ROUND(average_f1, 6) AS average_f1, ROUND(average_confidence, 6) AS average_confidence, ROUND(average_processing_time, 6) AS average_processing_time, ROUND(total_processing_time, 6) AS total_processing_time, total_documents, production_ready_count, ROUND(production_ready_rate, 6) AS production_ready_rate, ROUND(awk_fallback_rate, 6) AS awk_fallback_rate, ROUND(highlight_rate, 6) AS highlight_rate FROM models"),
    "g9_efficiency": with_views("SELECT doc_id, baseline, ROUND(baseline / processing_time, 6) AS ratio, CASE WHEN baseline / processing_time >= 2 THEN 'excellent' WHEN baseline / processing_time >= 1.5 THEN 'good' WHEN baseline / processing_time >= 1 THEN 'acceptable' WHEN baseline / processing_time >= 0.5 THEN 'poor' ELSE 'very_poor' END AS level FROM (SELECT doc_id, processing_time, CASE WHEN highlights_detected <= 1 THEN 2.0E0 WHEN highlights_detected <= 3 THEN 5.0E0 ELSE 10.0E0 END AS baseline FROM results) t", "results"),
    "r7_top_documents": with_views("SELECT doc_id, model, confidence_score FROM results WHERE success ORDER BY confidence_score DESC, doc_id LIMIT 10", "results"),
    "q8_production_status": with_views("SELECT model, CASE WHEN confidence_score >= 0.7 THEN 'ready' WHEN confidence_score >= 0.7 * 0.8 THEN 'monitor' ELSE 'not_ready' END AS status, COUNT(*) AS n FROM results GROUP BY 1, 2", "results"),
    "t1_monitor_lights": with_views("SELECT model, CASE WHEN s >= 0.95 THEN 'green' WHEN s >= 0.8 * 0.95 THEN 'yellow' ELSE 'red' END AS success_rate, CASE WHEN r >= 0.8 THEN 'green' WHEN r >= 0.8 * 0.8 THEN 'yellow' ELSE 'red' END AS ready_rate, CASE WHEN v >= 0.5 THEN 'green' WHEN v >= 0.4 THEN 'yellow' ELSE 'red' END AS documents_per_second, CASE WHEN c >= 0.7 THEN 'green' WHEN c >= 0.8 * 0.7 THEN 'yellow' ELSE 'red' END AS average_confidence FROM (SELECT model, AVG(CASE WHEN success THEN 1.0 ELSE 0.0 END) AS s, AVG(CASE WHEN success THEN CASE WHEN production_ready THEN 1.0 ELSE 0.0 END END) AS r, COUNT(CASE WHEN success THEN 1 END) / SUM(processing_time) AS v, AVG(CASE WHEN success THEN confidence_score END) AS c FROM results GROUP BY model) t", "results"),
    "r1_model_ranking": _with(_RANKED, "SELECT model, rank_average_f1, rank_average_precision, rank_average_recall, rank_production_ready_rate, rank_processing_speed, ROUND(overall_score, 6) AS overall_score, overall_rank FROM final"),
    "j13_pairwise_models": _with(_MODELS, "SELECT a.model AS model1, b.model AS model2, ROUND(ABS(a.average_f1 - b.average_f1), 6) AS f1_difference, ROUND(ABS(a.average_processing_time - b.average_processing_time), 6) AS time_difference, ABS(a.average_f1 - b.average_f1) > 0.05 AS significant_performance, ABS(a.average_processing_time - b.average_processing_time) > 1.0 AS significant_speed FROM models a JOIN models b ON a.model < b.model"),
    "g24_parity": _with(_MODELS + ", p AS (SELECT COUNT(*) AS models, COALESCE(STDDEV_SAMP(average_f1), 0) AS f1_std, AVG(average_f1) AS f1_mean, COALESCE(STDDEV_SAMP(average_processing_time), 0) AS time_std, AVG(average_processing_time) AS time_mean FROM models)", "SELECT models, ROUND(f1_std, 6) AS f1_std, ROUND(f1_std / f1_mean, 6) AS f1_cv, ROUND(time_std, 6) AS time_std, ROUND(time_std / time_mean, 6) AS time_cv, f1_std <= 0.05 AS similar_performance, time_std / time_mean <= 0.5 AS similar_speed, CASE WHEN models < 2 THEN 'insufficient_models' WHEN f1_std <= 0.05 AND time_std / time_mean <= 0.5 THEN 'fair' ELSE 'potential_bias' END AS status FROM p"),
    "g25_speeds": _with(_MODELS + ", v AS (SELECT model, total_documents / total_processing_time AS ds, average_f1 / average_processing_time AS accs FROM models)", "SELECT model, ROUND(ds, 6) AS documents_per_second, ROUND(accs, 6) AS accuracy_per_second, CASE WHEN ds >= 1 THEN 'fast' WHEN ds >= 0.5 THEN 'moderate' ELSE 'slow' END AS speed_category, ROUND(ds / (SELECT MAX(ds) FROM v), 6) AS relative_speed, ds = (SELECT MAX(ds) FROM v) AS fastest FROM v"),
    "d1_deployment": _with(_RANKED, "SELECT model, overall_rank, CASE WHEN overall_rank = 1 THEN CASE WHEN production_ready_rate >= 0.9 THEN 'ready' WHEN production_ready_rate >= 0.7 THEN 'conditional' ELSE 'not_ready' END END AS status, CASE WHEN overall_rank = 1 THEN CASE WHEN production_ready_rate >= 0.9 THEN 'high' WHEN production_ready_rate >= 0.7 THEN 'medium' END END AS confidence, CONCAT_WS(',', CASE WHEN processing_speed > 0.5 THEN 'real_time_processing' END, CASE WHEN average_f1 > 0.85 THEN 'high_accuracy_requirements' END, CASE WHEN production_ready_rate > 0.8 THEN 'automated_processing' END) AS use_cases FROM final"),
    "d3_recommendations": _with(_MODELS, "SELECT model, CASE WHEN production_ready_rate >= 0.9 THEN 'ready for production' WHEN production_ready_rate >= 0.7 THEN 'suitable with monitoring' ELSE 'needs improvement before production' END AS advice FROM models UNION ALL SELECT model, 'high fallback rate' FROM models WHERE awk_fallback_rate > 0.3 UNION ALL SELECT model, 'slow processing' FROM models WHERE average_processing_time > 10 UNION ALL SELECT model, 'low F1 score' FROM models WHERE average_f1 < 0.8"),
    "r10_best_model": _with(_MODELS, "SELECT model, ROUND(average_f1, 6) AS average_f1 FROM models ORDER BY average_f1 DESC, model LIMIT 1"),
    "d6_first_failures": with_views("SELECT model, place, doc_id, SPLIT_PART(COALESCE(error, 'Unknown error'), ':', 1) AS error_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model ORDER BY position) AS place FROM results WHERE NOT success) t WHERE place <= 5", "results"),
    "g27_strategies": _PROMPT + "SELECT doc_type, strategy, samples, ROUND(average, 9) AS average, ROUND(least, 9) AS least, ROUND(most, 9) AS most FROM strategies",
    "r9_optimal_strategy": _PROMPT + "SELECT doc_type, strategy, samples, ROUND(average, 6) AS average, ROUND(least, 6) AS least, ROUND(most, 6) AS most FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_type ORDER BY ROUND(average, 9) DESC, strategy) AS place FROM strategies WHERE samples >= 10 AND average >= 0.7) t WHERE place = 1",
    "g28_prompt_summary": with_views("SELECT COUNT(DISTINCT doc_type) AS doc_types, COUNT(DISTINCT strategy) AS strategies, COUNT(*) AS samples, (SELECT strategy FROM prompt_runs GROUP BY strategy ORDER BY COUNT(*) DESC, strategy LIMIT 1) AS most_used FROM prompt_runs", "prompt_runs"),
    "d11_strategy_comparison": _PROMPT + "SELECT doc_type, ROUND(a, 6) AS average_a, ROUND(b, 6) AS average_b, CASE WHEN a >= b THEN 'detailed' ELSE 'concise' END AS winner, ROUND(LEAST(ABS(a - b) * 5, 1.0), 6) AS certainty, CASE WHEN LEAST(ABS(a - b) * 5, 1.0) > 0.8 THEN 'strong' WHEN LEAST(ABS(a - b) * 5, 1.0) > 0.5 THEN 'moderate' ELSE 'weak' END AS band FROM (SELECT doc_type, MAX(CASE WHEN strategy = 'detailed' THEN average END) AS a, MAX(CASE WHEN strategy = 'concise' THEN average END) AS b FROM strategies GROUP BY doc_type) t WHERE a IS NOT NULL AND b IS NOT NULL",
    "d12_prompt_advice": _PROMPT + ", per AS (SELECT doc_type, SUM(samples) AS samples, MAX(average) AS best, MIN(average) AS worst FROM strategies GROUP BY doc_type) SELECT doc_type, 'prefer the best strategy' AS advice FROM per WHERE best - worst > 0.2 UNION ALL SELECT doc_type, 'collect more samples' FROM per WHERE samples < 10 UNION ALL SELECT doc_type, 'improve the prompts' FROM per WHERE best < 0.7",
}
