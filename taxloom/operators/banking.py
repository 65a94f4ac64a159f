"""Bank transactions: work expenses, duplicates, summaries and statement lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Category, words that mark it, weight and tax office category, in the order in which they are tried.
CATEGORIES = [
    ("fuel", "bp|shell|caltex|ampol|mobil|7-eleven|fuel|petrol|diesel|unleaded", 0.9, "Work-related car expenses"),
    ("parking", "parking|secure parking|wilson|ace park|meter|space", 0.8, "Work-related car expenses"),
    ("toll", "toll|citylink|eastlink|etag|westconnex|tunnel", 0.9, "Work-related car expenses"),
    ("transport", "uber|taxi|cab|train|bus|metro|opal|myki|translink", 0.7, "Work-related travel expenses"),
    ("accommodation", r"hotel|motel|accommodation|booking\.com|airbnb|hilton|marriott", 0.8, "Work-related travel expenses"),
    ("meals", "restaurant|cafe|lunch|dinner|coffee|meal|food|catering", 0.6, "Meal entertainment expenses"),
    ("office_supplies", "officeworks|staples|office supplies|stationery|paper|ink|pens", 0.8, "Office expenses"),
    ("professional_services", "legal|lawyer|accountant|consultant|professional|advisory|pwc|deloitte|kpmg", 0.9, "Professional fees"),
    ("equipment", "computer|laptop|software|equipment|tools|machinery|printer|scanner", 0.8, "Business equipment"),
    ("communications", "telstra|optus|vodafone|phone|internet|mobile|telecommunications", 0.7, "Phone and internet expenses"),
    ("insurance", "insurance|allianz|aami|nrma|professional indemnity|public liability", 0.8, "Insurance expenses"),
    ("banking", "bank fee|transaction fee|merchant fee|account fee|banking", 0.9, "Bank charges"),
]
OTHER = "Other business expenses"
#: Words that make an expense likelier to be for work.
BUSINESS_WORDS = ["business", "company", "pty", "ltd", "enterprise", "corporate", "office", "work", "professional", "commercial", "industrial", "client", "customer", "project", "contract", "invoice", "meeting", "conference", "training", "workshop", "seminar", "subscription", "license", "software", "service", "maintenance"]
#: Words that mark a transaction of interest in a statement.
PATTERN_WORDS = ["uber", "taxi", "fuel", "parking", "toll", "hotel", "flight", "restaurant", "cafe", "office", "supplies", "equipment"]
LINE = r"^(\d{1,2}/\d{1,2}(?:/\d{2,4})?)\s+(.{5,50}?)\s+([\-\+]?\$?\d+(?:\.\d{2})?)\s*$"


def categorized(txns: DataFrame) -> DataFrame:
    """Adds category, tax office category, work_score, confidence and indicators to debits that look like work expenses.

    The heaviest category that matches wins, the first listed on a tie; each
    business word adds a tenth, three tenths at most.
    """
    d = F.lower("description")
    hits = F.array(*[F.when(d.rlike(rf"\b(?:{p})\b"), F.struct(F.lit(w).alias("w"), F.lit(-k).alias("k"))) for k, (_, p, w, _) in enumerate(CATEGORIES)])
    best = F.array_max(F.filter(hits, lambda h: h.isNotNull()))
    words = F.filter(F.array(*[F.when(d.contains(w), w) for w in BUSINESS_WORDS]), lambda w: w.isNotNull())
    rows = txns.filter("amount < 0").select("*", best.alias("best"), words.alias("indicators"))
    score = F.coalesce("best.w", F.lit(0.0)) + F.least(0.1 * F.size("indicators"), F.lit(0.3))
    pick = lambda k, other: F.when(F.col("best").isNull(), other).otherwise(F.element_at(F.array(*[F.lit(c[k]) for c in CATEGORIES]), 1 - F.col("best.k")))
    out = rows.select("*", pick(0, "other").alias("category"), pick(3, OTHER).alias("ato_category"), score.alias("work_score"))
    out = out.withColumn("confidence", F.least("work_score", F.lit(1.0)))
    return out.filter(F.round("confidence", 9) >= 0.3).drop("best")


def deduplicated(expenses: DataFrame, by: list[str]) -> DataFrame:
    """The first of the expenses that share a date, 20 characters of description and an amount."""
    w = Window.partitionBy(*by, "date", F.substring("description", 1, 20), F.abs("amount")).orderBy("ord")
    return expenses.withColumn("copy", F.row_number().over(w)).filter("copy = 1").drop("copy")


def expense_summary(expenses: DataFrame) -> DataFrame:
    """Count, amount and confidence in all, by category and by tax office category, in one pass of grouping sets."""
    cents = F.abs(F.round(F.col("amount") * 100)).cast("long")
    rows = expenses.select("category", "ato_category", cents.alias("cents"), "confidence")
    sets = rows.groupingSets([[], [F.col("category")], [F.col("ato_category")]], "category", "ato_category")
    return sets.agg(F.count("*").alias("n"), (F.sum("cents") / 100).alias("total_amount"), F.avg("confidence").alias("average_confidence"))


def statement_lines(texts: DataFrame) -> DataFrame:
    """id, line, date, description, amount of every line of `text` that is a transaction."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).select("id", "line", F.trim("raw").alias("raw"))
    part = lambda k: F.regexp_extract("raw", LINE, k)
    amount = F.regexp_replace(part(3), r"[$,]", "").try_cast("double")
    return lines.filter(F.col("raw").rlike(LINE)).select("id", "line", part(1).alias("date"), F.trim(part(2)).alias("description"), amount.alias("amount"))


def patterns(txns: DataFrame, by: list[str]) -> DataFrame:
    """Debits, credits, sums, confidence and the share of work-related transactions."""
    debit, cents = F.col("amount") < 0, F.round(F.abs("amount") * 100).cast("long")
    work = F.lower("description").rlike("|".join(PATTERN_WORDS))
    return txns.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(debit).alias("debits"),
        F.count_if(~debit).alias("credits"),
        (F.coalesce(F.sum(F.when(debit, cents)), F.lit(0)) / 100).alias("debit_amount"),
        (F.coalesce(F.sum(F.when(~debit, cents)), F.lit(0)) / 100).alias("credit_amount"),
        F.avg("confidence").alias("average_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.count_if(work).alias("work_count"),
        (100.0 * F.count_if(work) / F.count("*")).alias("work_percentage"),
    )


def is_big_four(category: Column) -> Column:
    return F.coalesce(category == "big_four", F.lit(False))
