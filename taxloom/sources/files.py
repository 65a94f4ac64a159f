"""Files in and out: images, ground truth and saved results; JSON, CSV and text reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = "*.{jpg,jpeg,png,tiff,bmp,JPG,JPEG,PNG,TIFF,BMP}"
#: Columns of a batch export, in its order.
EXPORT = ["doc_id", "model", "success", "confidence_score", "ato_compliance_score", "processing_time", "production_ready", "awk_fallback_used", "highlights_detected"]


def stem(path: Column) -> Column:
    """A file's name without folder and suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def images(spark: SparkSession, folder: str, first: int | None = None, pattern: str = IMAGES) -> DataFrame:
    """path, stem, length of the images in a folder, by path; the pixels are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", stem(F.col("path")).alias("stem"), "length")
    return found.orderBy("path").limit(first) if first else found


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's stem), field, value from one JSON object in each file."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder)
    fields = F.from_json("value", "map<string,string>")
    named = rows.select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.explode(fields).alias("field", "value"))
    return named.filter("value is not null")


def paired(found: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images with a truth of the same stem, and those without."""
    ids = truth.select(F.col("doc_id").alias("stem")).distinct()
    return found.join(ids, "stem", "left_semi"), found.join(ids, "stem", "left_anti")


def saved_results(spark: SparkSession, path: str) -> DataFrame:
    """Results of saved batch reports, a row each."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*")


def write_report(results: DataFrame, summary: DataFrame, folder: str) -> None:
    """Results as JSON lines beside the summary; failed rows carry their error."""
    results.write.mode("overwrite").json(f"{folder}/results")
    summary.write.mode("overwrite").json(f"{folder}/analysis")


def simple_images(spark: SparkSession, folder: str, first: int) -> DataFrame:
    """The first images of a folder: all .jpg before all .png, each by path."""
    found = images(spark, folder, pattern="*.{jpg,png}")
    return found.orderBy(F.col("path").endswith(".png"), "path").limit(first)


def write_list(results: DataFrame, folder: str) -> None:
    """All results as JSON lines with the export's columns; failed ones have nulls."""
    results.select(*EXPORT).write.mode("overwrite").json(folder)


def as_json(results: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col and `document`: each result as one JSON object, nulls included."""
    return results.select(id_col, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def write_comparison(ranking: DataFrame, pairs: DataFrame, folder: str) -> None:
    """One JSON document with the ranking of the models and their differences; there are few models."""
    rows = lambda df, name: df.agg(F.collect_list(F.struct("*")).alias(name))
    both = rows(ranking, "ranking").join(F.broadcast(rows(pairs, "differences")))
    both.coalesce(1).write.mode("overwrite").json(folder)


def write_csv(results: DataFrame, folder: str) -> None:
    """Successful results with the export's columns and a header."""
    results.filter("success").select(*EXPORT).write.mode("overwrite").option("header", True).csv(folder)


def transactions_csv(txns: DataFrame, folder: str) -> None:
    """Transactions; confidence with three decimals, nulls empty."""
    columns = [F.coalesce(F.format_string("%.3f", c) if c == "confidence" else F.col(c).cast("string"), F.lit("")).alias(c) for c in txns.columns]
    txns.select(*columns).write.mode("overwrite").option("header", True).csv(folder)


def write_text(fields: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """`field: value` lines for each document, leaving out empty fields and those that start with an underscore."""
    shown = fields.filter(~F.col("field").startswith("_") & (F.coalesce("value", F.lit("")) != ""))
    lines = F.sort_array(F.collect_list(F.concat_ws(": ", "field", "value")))
    shown.groupBy(id_col).agg(F.array_join(lines, "\n").alias("text")).select("text").write.mode("overwrite").option("lineSep", "\n\n").text(folder)


def model(docs: DataFrame, answer, schema: str) -> DataFrame:
    """The seam for a model: `answer` maps an iterator of pandas frames to another, partition by partition."""
    return docs.mapInPandas(answer, schema)
