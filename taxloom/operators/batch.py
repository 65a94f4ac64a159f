"""Batch analytics over processing results: a row is one document read by one model.

All of it is grouped aggregation with map-side combining; what leaves a group
is a handful of numbers, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grade thresholds on overall confidence, best first.
GRADES = [("excellent", 0.90), ("good", 0.70), ("fair", 0.50), ("poor", 0.30)]
#: Seconds that a document of each complexity should take.
BASELINES = {"simple": 2.0, "normal": 5.0, "complex": 10.0}
#: Monitor targets: success and ready rates, documents a second, confidence.
TARGETS = {"success_rate": 0.95, "ready_rate": 0.8, "documents_per_second": 0.5, "average_confidence": 0.7}


def grade(score: Column) -> Column:
    out = None
    for name, least in GRADES:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("very_poor")


def error_type(error: Column) -> Column:
    """What stands before the first colon."""
    return F.substring_index(F.coalesce(error, F.lit("Unknown error")), ":", 1)


def ok(value: Column) -> Column:
    return F.when(F.col("success"), value)


def rate(condition: Column, of: Column) -> Column:
    """Share of rows that satisfy both among those that satisfy `of`; 0 if there are none."""
    n = F.count_if(of)
    return F.when(n > 0, F.count_if(condition & of) / n).otherwise(0.0)


def summary(results: DataFrame, by: list[str], threshold: float = 0.7) -> DataFrame:
    """Counts, rates, confidence, readiness, speed and compliance of each group."""
    s = F.col("success")
    conf, ato, took = ok(F.col("confidence_score")), ok(F.col("ato_compliance_score")), ok(F.col("processing_time"))
    out = results.groupBy(*by).agg(
        F.count("*").alias("total_documents"),
        F.count_if(s).alias("successful"),
        F.count_if(~s).alias("failed"),
        rate(s, F.lit(True)).alias("success_rate"),
        F.sum("processing_time").alias("total_processing_time"),
        F.avg(conf).alias("average_confidence"),
        F.min(conf).alias("min_confidence"),
        F.max(conf).alias("max_confidence"),
        F.count_if(conf >= threshold).alias("above_threshold"),
        F.count_if(conf < threshold).alias("below_threshold"),
        F.count_if(s & F.col("production_ready")).alias("ready_count"),
        rate(F.col("production_ready"), s).alias("ready_rate"),
        F.avg(took).alias("average_processing_time"),
        F.min(took).alias("min_processing_time"),
        F.max(took).alias("max_processing_time"),
        rate(F.col("awk_fallback_used"), s).alias("awk_fallback_rate"),
        F.avg(ok(F.col("highlights_detected"))).alias("average_highlights"),
        F.avg(ato).alias("average_ato"),
        F.count_if(ato >= 0.8).alias("high_compliance"),
    )
    return out.select("*", (F.col("ready_rate") >= 0.8).alias("overall_ready"), F.try_divide("successful", "total_processing_time").alias("documents_per_second"))


def dataset_metrics(results: DataFrame) -> DataFrame:
    """What model comparison needs of each model; averages over successes."""
    s = F.col("success")
    mean = lambda c: F.coalesce(F.avg(ok(F.col(c))), F.lit(0.0))
    return results.groupBy("model").agg(
        mean("precision_score").alias("average_precision"),
        mean("recall_score").alias("average_recall"),
        mean("f1_score").alias("average_f1"),
        mean("confidence_score").alias("average_confidence"),
        mean("processing_time").alias("average_processing_time"),
        F.sum("processing_time").alias("total_processing_time"),
        F.count("*").alias("total_documents"),
        F.count_if(s & F.col("production_ready")).alias("production_ready_count"),
        rate(F.col("production_ready"), s).alias("production_ready_rate"),
        rate(F.col("awk_fallback_used"), s).alias("awk_fallback_rate"),
        rate(F.col("highlights_detected") > 0, s).alias("highlight_rate"),
    )


def histogram(results: DataFrame, by: list[str]) -> DataFrame:
    """Grades of the successful results."""
    return results.filter("success").groupBy(*by, grade(F.col("confidence_score")).alias("grade")).agg(F.count("*").alias("n"))


def errors(results: DataFrame, by: list[str]) -> DataFrame:
    """Kinds of error of the failed results."""
    return results.filter("not success").groupBy(*by, error_type(F.col("error")).alias("error_type")).agg(F.count("*").alias("n"))


def first_failures(results: DataFrame, n: int = 5) -> DataFrame:
    """The first n failures of each model, by position."""
    w = Window.partitionBy("model").orderBy("position")
    return results.filter("not success").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def efficiency(seconds: Column, complexity: Column) -> tuple[Column, Column, Column]:
    """Baseline, ratio of baseline to time, and how that counts."""
    base = F.when(complexity <= 0.5, BASELINES["simple"]).when(complexity <= 1.5, BASELINES["normal"]).otherwise(BASELINES["complex"])
    ratio = F.when(seconds > 0, base / seconds).otherwise(0.0)
    level = F.when(ratio >= 2, "excellent").when(ratio >= 1.5, "good").when(ratio >= 1, "acceptable").when(ratio >= 0.5, "poor").otherwise("very_poor")
    return base, ratio, level


def production_status(confidence: Column, threshold: float) -> Column:
    return F.when(confidence >= threshold, "ready").when(confidence >= threshold * 0.8, "monitor").otherwise("not_ready")


def traffic_light(value: Column, target: float) -> Column:
    return F.when(value >= target, "green").when(value >= 0.8 * target, "yellow").otherwise("red")
