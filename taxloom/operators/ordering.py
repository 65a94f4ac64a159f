"""Places in an order without a window that holds a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def places(df: DataFrame, by: str, order: str, *, pieces: int = 64, tie: str | None = None) -> DataFrame:
    """df with `place`, from 1, of each row among those of its `by`, in the order of a number.

    Ranges of the number, from its quantiles, are numbered and counted; a row's
    place is how many of its group lie in earlier ranges and its place in its
    own. So a group is sorted in as many tasks as there are pieces. Equal
    numbers go by `tie`; rows without a number come first.
    """
    bounds = sorted(set(df.approxQuantile(order, [k / pieces for k in range(1, pieces)], 0.002)))
    piece = sum(((F.col(order) > b).cast("int") for b in bounds), F.lit(0))
    rows = df.withColumn("piece", F.coalesce(piece, F.lit(-1)))
    counts = rows.groupBy(by, "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col(by).alias("by_"), F.col("piece").alias("piece_"), F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(by, "piece").orderBy(F.asc_nulls_first(order), *([tie] if tie else [])))
    ranked = rows.withColumn("own", own).join(offsets, F.col(by).eqNullSafe(F.col("by_")) & (F.col("piece") == F.col("piece_")))
    return ranked.withColumn("place", (F.col("before") + F.col("own")).cast("int")).drop("piece", "own", "by_", "piece_", "before")
