"""Monitoring as a stream: results arrive as files and the figures follow, without reading anything twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from taxloom.operators.batch import TARGETS, rate, traffic_light


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files that appear in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def running(results: DataFrame) -> DataFrame:
    """Totals of all results so far by model; the state is a row of sums for each model."""
    s = F.col("success")
    return results.groupBy("model").agg(
        F.count("*").alias("total_documents"),
        rate(s, F.lit(True)).alias("success_rate"),
        rate(F.col("production_ready"), s).alias("ready_rate"),
        F.avg(F.when(s, F.col("confidence_score"))).alias("average_confidence"),
        F.try_divide(F.count_if(s), F.sum("processing_time")).alias("documents_per_second"),
    )


def lights(totals: DataFrame) -> DataFrame:
    """Totals with a traffic light for each target."""
    return totals.select("*", *[traffic_light(F.col(k), t).alias(f"{k}_light") for k, t in TARGETS.items()])


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums by kind in event-time windows; what comes later than `late` is left out and its state dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def monitor(results: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keeps `folder` at the latest lights: each trigger overwrites it with the whole, small state.

    Without `every` it works off what is there and stops.
    """

    def publish(state: DataFrame, _: int) -> None:
        lights(state).write.mode("overwrite").parquet(folder)

    writer = running(results).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def append_log(runs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends rows as they arrive."""
    return runs.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
