"""A whole batch in one pass: documents from text to grade, and an error row for each one that fails.

What can fail in a document is asked for in stages by expressions that yield
an error instead of raising one, in order and only until the first, so a broken
document costs no task and no second look. Failed rows go on through the same
plan with empty texts and come out as errors, so nothing is read twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.functions import validators as v
from taxloom.operators import classification as cl
from taxloom.operators import compliance as co
from taxloom.operators import confidence as cf
from taxloom.operators import extraction as ex
from taxloom.operators.texts import bound

#: Names of rule fields in the confidence model.
RENAMED = {"date": "date", "total": "total_amount", "supplier": "supplier_name", "gst": "gst_amount", "abn": "abn", "invoice_number": "invoice_number"}
#: What is said of a document that failed.
FLAG, ADVICE = "batch_processing_error", "Review error logs"
#: Labelled amounts and dates of a paper, as they stand.
AMOUNTS, DAYS = r"(?m)^(?:SUBTOTAL|GST|TAX|TOTAL):[ \t]*(\S+)", r"(?m)^(?:DATE:|Invoice date)[ \t]*(\S+)"

Stages = list[tuple[str, Column]]


def with_fields(docs: DataFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """docs (doc_id, doc_type, text, highlights_detected) with what the rules read, as a map under the names that later steps use."""
    rows = ex.extract(docs)
    names = {f: RENAMED.get(f, f) for f in ex.FIELDS}
    both = F.map_from_arrays(F.array(*map(F.lit, names.values())), F.array(*[F.coalesce(F.col(f"{f}.value"), F.lit("")) for f in names]))
    return rows.select("doc_id", "doc_type", "text", "highlights_detected", *keep, both.alias("fields"))


def graded(docs: DataFrame, this_year: int, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """Text to fields to compliance to grade, as one chain without a shuffle; flags and advice are arrays.

    The words of all steps are looked for together, once in each text.
    """
    rows, found = co.looked_up(with_fields(docs, keep), [*cl.WORDS, *cf.WORDS])
    held = found["low"]
    rows = cl.classify(co.assess(rows, this_year, held=found, names=[RENAMED.get(f, f) for f in ex.FIELDS]).withColumnRenamed("advice", "compliance_advice"), held)
    fields = F.col("fields")
    rows = rows.withColumn("count", sum((F.coalesce(fields[n] != "", F.lit(False)).cast("int") for n in RENAMED.values()), F.lit(0)))
    rows = rows.withColumns({"extraction": cf.extraction_quality(fields, F.col("count")), "business": cf.business_recognition(F.col("text"), fields, F.col("highlights_detected"), held)})
    out = cf.assess(F.col("score"), F.col("extraction"), F.col("compliance_score"), F.col("passed"), F.col("business"), fields, F.col("count"))
    return rows.select("doc_id", *keep, "predicted", "extraction", "business", "compliance_score", *[c.alias(k) for k, c in out.items()])


def _first_bad(text: Column, pattern: str, bad: Callable[[Column], Column], error: str) -> Column:
    """The error that the first bad value behind a label makes, or null."""
    values = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), bad)
    return F.concat(F.lit(f"{error}: "), F.get(values, 0))


def stages(this_year: int) -> Stages:
    """What is asked of a document before it is graded: a name and an error (type and message) or null."""
    text, kind = F.col("text"), F.col("doc_type")
    no_number = lambda x: F.regexp_replace(x, "[$,]", "").try_cast("double").isNull()
    return [
        ("load", F.when(text.isNull(), "TypeError: no text").when(F.btrim(text, F.lit(" \t\n\r")) == "", "ValueError: empty text")),
        ("type", F.when(~kind.isin(*ex.TYPES), F.concat(F.lit("ValueError: unknown document type "), kind))),
        ("amounts", _first_bad(text, AMOUNTS, no_number, "NumberError")),
        ("dates", _first_bad(text, DAYS, lambda x: bound(v.parse_date(x), lambda d: v.date_issue(x, this_year, d).isNotNull()), "DateError")),
    ]


def isolated(docs: DataFrame, asked: Stages) -> DataFrame:
    """docs with failed_stage and error, both null for documents that pass; stages after the first failure are not asked."""
    first = F.coalesce(*[F.concat(F.lit(f"{name}|"), error) for name, error in asked])
    rows = docs.withColumn("failure", first)
    stage = F.substring_index("failure", "|", 1)
    return rows.withColumns({"failed_stage": stage, "error": F.expr("substring(failure, length(substring_index(failure, '|', 1)) + 2)")}).drop("failure")


def run(docs: DataFrame, this_year: int, types: DataFrame | None = None, asked: Stages | None = None) -> DataFrame:
    """A row for each row of docs: its grade, or an error row.

    `types` (doc_id, doc_type) gives the documents' types; a document that it
    leaves out fails in stage `type`, as the two must match. Documents without
    a type, where none are given, count as `other`.
    """
    rows = docs
    asked = asked or stages(this_year)
    if types is not None:
        rows = docs.drop("doc_type").join(types.select("doc_id", "doc_type"), "doc_id", "left")
        asked = [("type", F.when(F.col("doc_type").isNull(), F.lit("ValueError: document_types must match the documents"))), *asked]
    rows = isolated(rows, asked)
    well = F.col("error").isNull()
    shown = rows.withColumns({"text": F.when(well, F.col("text")).otherwise(""), "doc_type": F.when(well, F.coalesce("doc_type", F.lit("other"))).otherwise("other"), "highlights_detected": well & F.coalesce("highlights_detected", F.lit(False))})
    out = graded(shown, this_year, ["failed_stage", "error"])
    one = lambda text: F.array(F.lit(text))
    failed = {"predicted": F.lit("error"), "grade": F.lit("very_poor"), "production_ready": F.lit(False), "flags": one(FLAG), "advice": one(ADVICE)} | {c: F.lit(0.0) for c in ("extraction", "business", "compliance_score", "overall")}
    return out.withColumns({c: F.when(F.col("error").isNull(), F.col(c)).otherwise(x) for c, x in failed.items()})


def failures(batch: DataFrame) -> DataFrame:
    """How many documents failed, by stage and type of error."""
    return batch.filter("error is not null").groupBy("failed_stage", F.substring_index("error", ":", 1).alias("error_type")).agg(F.count("*").alias("n"))
