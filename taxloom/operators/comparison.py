"""Comparison of models: rankings, pairwise differences, parity, speed and deployment.

The input is one row for each model, so the windows without a partition key
see as many rows as there are models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxloom.functions import statistics as stats

#: Weights of the ranks in the overall score.
WEIGHTS = {"average_f1": 0.3, "average_precision": 0.2, "average_recall": 0.2, "production_ready_rate": 0.2, "processing_speed": 0.1}


def rankings(models: DataFrame) -> DataFrame:
    """A rank for each measure, the weighted score of the ranks and the final rank; ties go to the name that sorts first."""
    speed = F.when(F.col("average_processing_time") > 0, 1.0 / F.col("average_processing_time")).otherwise(0.0)
    out = models.withColumn("processing_speed", speed)
    for m in WEIGHTS:
        out = out.withColumn(f"rank_{m}", F.row_number().over(Window.orderBy(F.desc(m), "model")))
    n = F.count("*").over(Window.partitionBy())
    score = sum((w * (n + 1 - F.col(f"rank_{m}")) for m, w in WEIGHTS.items()), F.lit(0.0))
    out = out.withColumn("overall_score", score)
    return out.withColumn("overall_rank", F.row_number().over(Window.orderBy(F.desc(F.round("overall_score", 9)), "model")))


def pairwise(models: DataFrame) -> DataFrame:
    """Differences of every two models, the first name before the second."""
    a = models.select(F.col("model").alias("model1"), F.col("average_f1").alias("f1"), F.col("average_processing_time").alias("t1"))
    b = models.select(F.col("model").alias("model2"), F.col("average_f1").alias("f2"), F.col("average_processing_time").alias("t2"))
    f1, time = F.abs(F.col("f1") - F.col("f2")), F.abs(F.col("t1") - F.col("t2"))
    return a.join(b, F.col("model1") < F.col("model2")).select("model1", "model2", f1.alias("f1_difference"), time.alias("time_difference"), (f1 > 0.05).alias("significant_performance"), (time > 1.0).alias("significant_speed"))


def parity(models: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Whether the models' F1 and speed are close enough for a fair comparison."""
    sd = lambda c: F.coalesce(F.stddev_samp(c), F.lit(0.0))
    out = models.agg(F.count("*").alias("models"), sd("average_f1").alias("f1_std"), F.avg("average_f1").alias("f1_mean"), sd("average_processing_time").alias("time_std"), F.avg("average_processing_time").alias("time_mean"))
    f1_cv = F.when(F.col("f1_mean") > 0, F.col("f1_std") / F.col("f1_mean")).otherwise(0.0)
    time_cv = F.when(F.col("time_mean") > 0, F.col("time_std") / F.col("time_mean")).otherwise(0.0)
    similar, speed = F.col("f1_std") <= tolerance, time_cv <= 0.5
    status = F.when(F.col("models") < 2, "insufficient_models").when(similar & speed, "fair").otherwise("potential_bias")
    return out.select("models", "f1_std", f1_cv.alias("f1_cv"), "time_std", time_cv.alias("time_cv"), similar.alias("similar_performance"), speed.alias("similar_speed"), status.alias("status"))


def speeds(models: DataFrame) -> DataFrame:
    """Documents and accuracy a second, and speed against the fastest model."""
    per_second = F.when(F.col("total_processing_time") > 0, F.col("total_documents") / F.col("total_processing_time")).otherwise(0.0)
    accuracy = F.when(F.col("average_processing_time") > 0, F.col("average_f1") / F.col("average_processing_time")).otherwise(0.0)
    category = F.when(per_second >= 1.0, "fast").when(per_second >= 0.5, "moderate").otherwise("slow")
    out = models.select("model", per_second.alias("documents_per_second"), accuracy.alias("accuracy_per_second"), category.alias("speed_category"))
    best = F.max("documents_per_second").over(Window.partitionBy())
    return out.select("*", (F.col("documents_per_second") / best).alias("relative_speed"), (F.col("documents_per_second") == best).alias("fastest"))


def deployment(ranked: DataFrame) -> DataFrame:
    """The verdict on the best model, and what each model suits."""
    r = F.col("production_ready_rate")
    status = F.when(r >= 0.9, "ready").when(r >= 0.7, "conditional").otherwise("not_ready")
    level = F.when(r >= 0.9, "high").when(r >= 0.7, "medium")
    uses = F.filter(F.array(F.when(F.col("processing_speed") > 0.5, "real_time_processing"), F.when(F.col("average_f1") > 0.85, "high_accuracy_requirements"), F.when(r > 0.8, "automated_processing")), lambda x: x.isNotNull())
    first = F.col("overall_rank") == 1
    return ranked.select("model", "overall_rank", F.when(first, status).alias("status"), F.when(first, level).alias("confidence"), F.array_join(uses, ",").alias("use_cases"))


def best_by_f1(models: DataFrame, places: int = 6) -> DataFrame:
    """The model of the highest mean F1; what is equal to `places` is a tie, which goes to the name that sorts first, so the order of summation decides nothing."""
    return models.withColumn("average_f1", F.round("average_f1", places)).orderBy(F.desc("average_f1"), "model").limit(1)


def recommendations(models: DataFrame) -> DataFrame:
    """One row for each piece of advice that a model's figures call for."""
    r = F.col("production_ready_rate")
    advice = F.array(
        F.when(r >= 0.9, "ready for production").when(r >= 0.7, "suitable with monitoring").otherwise("needs improvement before production"),
        F.when(F.col("awk_fallback_rate") > 0.3, "high fallback rate"),
        F.when(F.col("average_processing_time") > 10, "slow processing"),
        F.when(F.col("average_f1") < 0.8, "low F1 score"),
    )
    return models.select("model", F.explode(F.filter(advice, lambda x: x.isNotNull())).alias("advice"))


def metric_winners(models: DataFrame, a: str, b: str) -> DataFrame:
    """metric, a, b and winner of two models' figures; less is better for processing_time."""
    names = [c for c in models.columns if c != "model"]
    each = models.select("model", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")).select("model", "m.*")
    pick = lambda name: F.max(F.when(F.col("model") == name, F.col("value")))
    rows = each.groupBy("metric").agg(pick(a).alias("a"), pick(b).alias("b"))
    first = (F.col("metric") == "processing_time") == (F.col("a") < F.col("b"))
    return rows.withColumn("winner", F.when(F.col("a") == F.col("b"), "tie").when(first, a).otherwise(b))


def production_grade(rate: Column) -> Column:
    return F.when(rate >= 0.9, "excellent").when(rate >= 0.7, "good").when(rate >= 0.5, "fair").otherwise("poor")


#: What makes a comparison fair.
FAIRNESS = {
    "identical_pipeline": "Identical pipeline ensures fair comparison",
    "standardized_prompts": "Standardized prompts eliminate prompt bias",
    "same_confidence_thresholds": "Same thresholds ensure consistent evaluation",
}


def significance(results: DataFrame, metrics: list[str], alpha: float = 0.05, by: str = "model") -> DataFrame:
    """Welch's test for each metric and every two models, the first name before the second.

    Counts, means and variances merge, so a model's rows are never gathered;
    what is joined has a row for each model and metric. Null figures don't count.
    """
    moments = []
    for m in metrics:
        moments.append(F.struct(F.lit(m).alias("metric"), F.count(m).alias("n"), F.avg(m).alias("mean"), F.var_samp(m).alias("var")))
    each = results.groupBy(by).agg(F.array(*moments).alias("m")).select(F.col(by).alias("name"), F.explode("m").alias("m")).select("name", "m.*")
    side = lambda k: each.select("metric", *[F.col(c).alias(f"{c}{k}") for c in ("name", "n", "mean", "var")])
    pairs = side(1).join(side(2), "metric").filter("name1 < name2")
    t, df = stats.welch(*[F.col(f"{c}{k}") for k in (1, 2) for c in ("n", "mean", "var")])
    rows = pairs.withColumns({"t": t, "df": df}).withColumn("difference", F.col("mean1") - F.col("mean2"))
    rows = rows.withColumns({"p_value": F.when(F.col("t").isNotNull(), stats.two_sided(F.col("t"), F.col("df"))), "reach": F.when(F.col("t").isNotNull(), stats.quantile(alpha, F.col("df")) * F.sqrt(F.col("var1") / F.col("n1") + F.col("var2") / F.col("n2")))})
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / F.nullif(F.col("n1") + F.col("n2") - 2, F.lit(0)))
    return rows.select(
        "metric",
        F.col("name1").alias("model1"),
        F.col("name2").alias("model2"),
        "n1",
        "n2",
        "difference",
        "t",
        "df",
        "p_value",
        F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"),
        (F.col("difference") - F.col("reach")).alias("low"),
        (F.col("difference") + F.col("reach")).alias("high"),
        (F.col("difference") / F.nullif(pooled, F.lit(0.0))).alias("effect"),
    )


def fairness(settings: DataFrame) -> DataFrame:
    """settings (a row for each comparison, with FAIRNESS' flags) with score, bias_risk, issues and recommendation."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    score = sum((flag(c).cast("int") for c in FAIRNESS), F.lit(0)) / len(FAIRNESS)
    issues = F.filter(F.array(*[F.when(~flag(c), f"Missing: {text}") for c, text in FAIRNESS.items()]), lambda x: x.isNotNull())
    rows = settings.withColumns({"score": score, "issues": issues})
    fair = F.size("issues") == 0
    return rows.withColumns({"bias_risk": F.when(fair, "low").otherwise("medium"), "recommendation": F.when(fair, "Configuration ensures fair model comparison").otherwise("Enable all fairness settings for unbiased comparison")})


def settings_of(readings: DataFrame, results: DataFrame) -> DataFrame:
    """What models' outputs show of how they were run, for every two: the same fields read (pipeline), the same documents asked (prompts), the same confidence to be ready.

    readings: model, doc_id, field; results: model, confidence_score, production_ready.
    """
    ids = F.struct(F.count_distinct("doc_id").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("mix"))
    asked = readings.select("model", "doc_id").distinct().groupBy("model").agg(ids.alias("documents"))
    fields = readings.select("model", "field").distinct().groupBy("model").agg(F.sort_array(F.collect_list("field")).alias("fields"))
    ready = results.groupBy("model").agg(F.min(F.when(F.col("production_ready"), F.col("confidence_score"))).alias("threshold"))
    each = asked.join(fields, "model").join(ready, "model", "left")
    side = lambda k: each.select(*[F.col(c).alias(f"{c}{k}") for c in each.columns])
    pairs = side(1).join(side(2), F.col("model1") < F.col("model2"))
    return pairs.select("model1", "model2", (F.col("fields1") == F.col("fields2")).alias("identical_pipeline"), (F.col("documents1") == F.col("documents2")).alias("standardized_prompts"), F.col("threshold1").eqNullSafe(F.col("threshold2")).alias("same_confidence_thresholds"))


def full_comparison(models: DataFrame, results: DataFrame, readings: DataFrame, metrics: list[str], alpha: float = 0.05) -> DataFrame:
    """A row for each model: rank, deployment, in how many metrics it is significantly better or worse than others, and the lowest fairness of its comparisons."""
    ranked = rankings(models)
    tested = significance(results, metrics, alpha).filter("significant")
    sides = [tested.select(F.col(f"model{k}").alias("model"), (F.col("difference") * sign > 0).alias("higher"), "metric") for k, sign in ((1, 1), (2, -1))]
    less_is_better = F.col("metric") == "processing_time"
    won = sides[0].unionByName(sides[1]).withColumn("better", F.col("higher") != less_is_better).groupBy("model").agg(F.count_if("better").alias("better"), F.count_if(~F.col("better")).alias("worse"))
    fair = fairness(settings_of(readings, results))
    fair = fair.select(F.col("model1").alias("model"), "score").unionByName(fair.select(F.col("model2").alias("model"), "score")).groupBy("model").agg(F.min("score").alias("fairness"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("better", "worse")}
    return deployment(ranked).join(won, "model", "left").join(fair, "model", "left").withColumns(zero)
