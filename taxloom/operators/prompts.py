"""Performance of prompt strategies by document type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def composite(runs: DataFrame) -> DataFrame:
    """Adds performance: two fifths confidence, three fifths accuracy."""
    return runs.withColumn("performance", 0.4 * F.col("confidence") + 0.6 * F.col("accuracy"))


def by_strategy(runs: DataFrame) -> DataFrame:
    return composite(runs).groupBy("doc_type", "strategy").agg(F.count("*").alias("samples"), F.avg("performance").alias("average"), F.min("performance").alias("least"), F.max("performance").alias("most"))


def optimal(strategies: DataFrame, samples: int = 10, average: float = 0.7) -> DataFrame:
    """The best strategy of each type among those with enough samples and performance."""
    w = Window.partitionBy("doc_type").orderBy(F.desc(F.round("average", 9)), "strategy")
    held = strategies.filter((F.col("samples") >= samples) & (F.col("average") >= average))
    return held.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")


def comparison(strategies: DataFrame, a: str, b: str) -> DataFrame:
    """Two strategies side by side: winner, and how sure that is."""
    pick = lambda s: F.max(F.when(F.col("strategy") == s, F.col("average")))
    rows = strategies.groupBy("doc_type").agg(pick(a).alias("average_a"), pick(b).alias("average_b")).filter("average_a is not null and average_b is not null")
    gap = F.abs(F.col("average_a") - F.col("average_b"))
    sure = F.least(gap * 5, F.lit(1.0))
    band = F.when(sure > 0.8, "strong").when(sure > 0.5, "moderate").otherwise("weak")
    return rows.select("*", F.when(F.col("average_a") >= F.col("average_b"), a).otherwise(b).alias("winner"), sure.alias("certainty"), band.alias("band"))


def summary(runs: DataFrame) -> DataFrame:
    """Distinct types and strategies, samples, and the strategy used most (the first name on a tie)."""
    used = runs.groupBy("strategy").agg(F.count("*").alias("n"))
    top = used.agg(F.min(F.struct((-F.col("n")).alias("n"), "strategy"))["strategy"].alias("most_used"))
    return runs.agg(F.count_distinct("doc_type").alias("doc_types"), F.count_distinct("strategy").alias("strategies"), F.count("*").alias("samples")).join(F.broadcast(top))


def advice(strategies: DataFrame) -> DataFrame:
    """What to do about each document type: too few samples, poor results or a wide gap between strategies."""
    per = strategies.groupBy("doc_type").agg(F.sum("samples").alias("samples"), F.max("average").alias("best"), F.min("average").alias("worst"))
    notes = F.array(F.when(F.col("best") - F.col("worst") > 0.2, "prefer the best strategy"), F.when(F.col("samples") < 10, "collect more samples"), F.when(F.col("best") < 0.7, "improve the prompts"))
    return per.select("doc_type", F.explode(F.filter(notes, lambda x: x.isNotNull())).alias("advice"))
