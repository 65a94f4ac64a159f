"""Field-level evaluation of extractions against ground truth, in long form.

extractions: model, doc_id, field, value, confidence; truth: doc_id, field,
value. One join on (doc_id, field) feeds all metrics; both sides shuffle on
doc_id alone, so grouping by document afterwards moves nothing again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ABN_FIELDS = ["abn", "abn_number"]
AMOUNT_FIELDS = ["total_amount", "amount", "subtotal", "gst_amount"]
DATE_FIELDS = ["date", "transaction_date", "invoice_date"]
#: Names under which a receipt benchmark's fields may stand.
SROIE = {"company": "supplier_name", "date": "date", "total": "total_amount", "address": "address"}


def _plain(value: Column) -> Column:
    return F.lower(F.trim(value))


def same_value(field: Column, read: Column, true: Column) -> Column:
    """Equality as the field demands: ABNs without spaces, amounts as numbers, dates without separators."""
    a, b = _plain(read), _plain(true)
    number = lambda v: F.regexp_replace(v, r"[$,\s]", "").try_cast("double")
    x, y = number(a), number(b)
    amounts = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)
    bare = lambda v: F.regexp_replace(v, r"[-/\s]", "")
    solid = lambda v: F.regexp_replace(v, r"[\s-]", "")
    return F.when(field.isin(ABN_FIELDS), solid(a) == solid(b)).when(field.isin(AMOUNT_FIELDS), amounts).when(field.isin(DATE_FIELDS), bare(a) == bare(b)).otherwise(a == b)


def similarity(read: Column, true: Column) -> Column:
    """1 less the edit distance over the longer length, on trimmed lower-case text."""
    a, b = _plain(read), _plain(true)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def paired(extractions: DataFrame, truth: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Every true field of every document that a model read, with what the model made of it (null: left out).

    `models` names the (model, doc_id) pairs; by default those with any field.
    """
    pairs = models if models is not None else extractions.select("model", "doc_id").distinct()
    due = pairs.join(truth.select("doc_id", "field", F.col("value").alias("true_value")), "doc_id")
    return due.join(extractions, ["model", "doc_id", "field"], "left")


def prf(extractions: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the field sets of each document."""
    read = extractions.select("model", "doc_id", "field", F.lit(1).alias("read"))
    pairs = read.select("model", "doc_id").distinct()
    due = pairs.join(truth.select("doc_id", "field"), "doc_id").withColumn("due", F.lit(1))
    both = read.join(due, ["model", "doc_id", "field"], "full")
    counts = both.groupBy("model", "doc_id").agg(F.count_if(F.col("read").isNotNull() & F.col("due").isNotNull()).alias("tp"), F.count_if(F.col("due").isNull()).alias("fp"), F.count_if(F.col("read").isNull()).alias("fn"))
    counts = counts.filter("tp + fn > 0")
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.col("tp") / (F.col("tp") + F.col("fn"))
    out = counts.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def match_rates(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Exact and fuzzy match rates over the true fields of each document; a field left out matches nothing."""
    exact = F.coalesce(same_value(F.col("field"), F.col("value"), F.col("true_value")), F.lit(False))
    fuzzy = F.coalesce(similarity(F.col("value"), F.col("true_value")) >= threshold, F.lit(False))
    return pairs.groupBy("model", "doc_id").agg(F.avg(exact.cast("int")).alias("exact_match"), F.avg(fuzzy.cast("int")).alias("fuzzy_match"), F.count("*").alias("fields"))


def field_accuracy(pairs: DataFrame) -> DataFrame:
    """Share of each true field that a model reads exactly, case and outer space aside."""
    right = F.coalesce(_plain(F.col("value")) == _plain(F.col("true_value")), F.lit(False))
    return pairs.groupBy("model", "field").agg(F.count_if(right).alias("right"), F.count("*").alias("n"), F.avg(right.cast("int")).alias("accuracy"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, from sums in one pass; 0 for fewer than two rows or no variance."""
    n, sx, sy = F.count("*"), F.sum(x), F.sum(y)
    vx, vy = n * F.sum(x * x) - sx * sx, n * F.sum(y * y) - sy * sy
    return F.when((n < 2) | (vx <= 1e-9) | (vy <= 1e-9), 0.0).otherwise((n * F.sum(x * y) - sx * sy) / F.sqrt(F.greatest(vx * vy, F.lit(1e-300))))


def confidence_correlation(pairs: DataFrame, by: list[str]) -> DataFrame:
    """How confidence goes with being right, over the fields that were read."""
    right = F.coalesce(same_value(F.col("field"), F.col("value"), F.col("true_value")), F.lit(False)).cast("double")
    rows = pairs.filter(F.col("confidence").isNotNull()).withColumn("right", right)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), correlation(F.col("confidence"), F.col("right")).alias("correlation"))


def missing_truth(extractions: DataFrame, truth: DataFrame) -> DataFrame:
    """Documents that were read but have no truth at all."""
    return extractions.select("doc_id").distinct().join(truth, "doc_id", "left_anti")


def sroie_scores(extractions: DataFrame, truth: DataFrame) -> DataFrame:
    """precision, recall and f1 of each benchmark field of each document, alike for one value: 1 or 0; fields absent on both sides count as right.

    Readings and truth move once, by document, and meet on (document, field);
    what follows are counts of each (model, document), so no field is made
    for a model before it is known whether it was read. A field of a model
    yields a row for each reading and true value, or one if it has neither.
    """
    names = list(SROIE)
    place = lambda c: F.coalesce(*[F.when(c == f, F.lit(k)) for k, f in enumerate(SROIE.values())])
    value = lambda c: F.when(place(F.col("field")).isNotNull(), F.nullif(c, F.lit("")))
    # A reading of no model in particular is none of anybody's, though its document was read.
    read = extractions.filter("doc_id is not null").select("doc_id", "model", F.when(F.col("model").isNotNull(), place(F.col("field"))).alias("at"), value("value").alias("value")).repartition("doc_id")
    true = truth.filter("doc_id is not null").select(F.col("doc_id").alias("due"), place(F.col("field")).alias("true_at"), value("value").alias("true_value")).repartition("due")

    count = lambda c: F.count_if(c).cast("int")
    facts = true.groupBy("due").agg(*[x for k in range(len(names)) for x in (count(F.col("true_at") == k).alias(f"n{k}"), count((F.col("true_at") == k) & F.col("true_value").isNull()).alias(f"absent{k}"))])
    # The field is no key of the join: with one, Spark would deal both sides by it too and move what follows again.
    met = read.join(true.filter("true_at is not null"), (F.col("doc_id") == F.col("due")) & (F.col("at") - F.col("true_at") == 0), "left")

    a, b, at = _plain(F.col("value")), _plain(F.col("true_value")), F.col("at")
    number = lambda v: F.regexp_replace(v, r"[$,\s]", "").try_cast("double")
    x, y = number(a), number(b)
    total = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < 0.01).otherwise(a == b)
    bare = lambda v: F.regexp_replace(v, r"[-/\s]", "")
    same = (a == b) | F.when(at == names.index("total"), total).when(at == names.index("date"), bare(a) == bare(b))
    right = (F.col("value").isNull() & F.col("true_value").isNull()) | F.coalesce(same, F.lit(False))
    told = met.select("model", "doc_id", "at", right.alias("right"))
    counts = told.groupBy("model", "doc_id").agg(*[x for k in range(len(names)) for x in (count(at == k).alias(f"rows{k}"), count((at == k) & F.col("right")).alias(f"right{k}"))])

    rows = counts.join(facts, F.col("doc_id") == F.col("due"))
    c = F.col

    def scores(k: int, name: str):
        # Not read: right where the truth has no value either.
        n = F.when(c(f"rows{k}") > 0, c(f"rows{k}")).otherwise(F.greatest(c(f"n{k}"), F.lit(1)))
        good = F.when(c(f"rows{k}") > 0, c(f"right{k}")).when(c(f"n{k}") > 0, c(f"absent{k}")).otherwise(1)
        return F.struct(F.lit(name).alias("name"), F.lit(SROIE[name]).alias("field"), n.alias("n"), good.alias("good"))

    each = rows.select("model", "doc_id", F.explode(F.array(*[scores(k, name) for k, name in enumerate(names)])).alias("s")).select("model", "doc_id", "s.*")
    # Nearly always one row; a value that is there more than once yields as many.
    one = F.when(c("n") == 1, F.array(c("good").cast("double"))).otherwise(F.transform(F.sequence(F.lit(1), c("n")), lambda i: (i <= c("good")).cast("double")))
    out = each.select("model", "doc_id", "name", "field", F.explode(one).alias("f1"))
    return out.withColumns({"precision": F.col("f1"), "recall": F.col("f1")})


def sroie_fields(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "name").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("sample_count"))


def sroie_leaderboard(scores: DataFrame) -> DataFrame:
    """Models by mean F1 over documents, and their place in each field."""
    fields = scores.groupBy("model", "name").agg(F.sum("f1").alias("f1"), F.count("f1").alias("n"))
    # The few sums of fields add up to those of models, so scores are read once.
    sums = fields.select("model", F.explode(F.array(F.lit("overall"), F.col("name"))).alias("name"), "f1", "n")
    means = sums.groupBy("name", "model").agg((F.sum("f1") / F.nullif(F.sum("n"), F.lit(0))).alias("f1"))
    return means.select("name", "model", "f1", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("f1"), "model")).alias("place"))


def standardized(extractions: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """One canonical value for each document: of a field's aliases, the first with a value."""
    order = {a: (name, k) for name, many in aliases.items() for k, a in enumerate(many)}
    name = F.create_map(*[F.lit(x) for a, (n, _) in order.items() for x in (a, n)])[F.col("field")]
    rank = F.create_map(*[F.lit(x) for a, (_, k) in order.items() for x in (a, k)])[F.col("field")]
    rows = extractions.filter("value <> ''").select("model", "doc_id", name.alias("name"), rank.alias("rank"), "value").filter("name is not null")
    return rows.groupBy("model", "doc_id", "name").agg(F.min(F.struct("rank", "value"))["value"].alias("value"))


#: Forms of dates and amounts that count as well written.
DATE_FORMS = [r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$", r"^\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}$"]
AMOUNT_FORM = r"^\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?$"


def abn_form(value: Column) -> Column:
    return F.coalesce(F.regexp_replace(value, r"\s", "").rlike(r"^\d{11}$"), F.lit(False))


def date_form(value: Column) -> Column:
    t = F.trim(value)
    return F.coalesce(t.rlike(DATE_FORMS[0]) | t.rlike(DATE_FORMS[1]), F.lit(False))


def amount_form(value: Column) -> Column:
    return F.coalesce(F.trim(value).rlike(AMOUNT_FORM), F.lit(False))


def gst_adds_up(total: Column, subtotal: Column) -> Column:
    """Whether a total is its subtotal and a tenth, to the cent."""
    number = lambda v: F.regexp_replace(v, r"[$,\s]", "").try_cast("double")
    return F.coalesce(F.abs(number(total) - (number(subtotal) + number(subtotal) * 0.1)) <= 0.01, F.lit(False))


def ato_scores(extractions: DataFrame, truth: DataFrame) -> DataFrame:
    """The share of tax office checks that each document's reading passes; only what the truth has is checked.

    An ABN that is badly written but equal to a well-written true one counts 0.8.
    """
    pick = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    names = ["abn", "date", "total_amount", "subtotal", "gst_amount"]
    # Each side becomes one row before they meet, so no true field is copied for each model.
    true = truth.groupBy("doc_id").agg(*[pick(f, "value").alias(f"t_{f}") for f in names])
    read = extractions.filter("model is not null").groupBy("model", "doc_id").agg(*[pick(f, "value").alias(f"r_{f}") for f in names])
    rows = read.join(true, "doc_id")
    t, r = (lambda f: F.col(f"t_{f}")), (lambda f: F.col(f"r_{f}"))
    abn = F.when(abn_form(r("abn")), 1.0).when(abn_form(t("abn")) & F.coalesce(r("abn") == t("abn"), F.lit(False)), 0.8).otherwise(0.0)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    checks = [
        (t("abn").isNotNull(), abn),
        (t("gst_amount").isNotNull() & t("total_amount").isNotNull(), one(gst_adds_up(r("total_amount"), r("subtotal")))),
        (t("date").isNotNull(), one(date_form(r("date")))),
        *[(t(f).isNotNull(), one(amount_form(r(f)))) for f in ("total_amount", "subtotal", "gst_amount")],
    ]
    n = sum((c.cast("int") for c, _ in checks), F.lit(0))
    points = sum((F.when(c, p).otherwise(0.0) for c, p in checks), F.lit(0.0))
    return rows.select("model", "doc_id", n.alias("checks"), F.when(n > 0, points / n).otherwise(0.0).alias("ato_score"))


def benchmark_overall(results: DataFrame) -> DataFrame:
    """Of each model's documents (success, f1_score, processing_time): mean F1, success rate and times, over the successful ones."""
    good = lambda c: F.when(F.col("success"), F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.groupBy("model").agg(
        zero(F.avg(good("f1_score"))).alias("average_f1"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.count("*").alias("total_documents"),
        F.count_if("success").alias("successful_documents"),
        zero(F.avg(good("processing_time"))).alias("avg_processing_time"),
        zero(F.min(good("processing_time"))).alias("min_processing_time"),
        zero(F.max(good("processing_time"))).alias("max_processing_time"),
        zero(F.sum(good("processing_time"))).alias("total_processing_time"),
    )


def benchmark_summary(overall: DataFrame) -> DataFrame:
    """Best, worst and mean over the models of benchmark_overall."""
    return overall.agg(
        F.count("*").alias("num_models"),
        F.max("average_f1").alias("best_f1_score"),
        F.min("average_f1").alias("worst_f1_score"),
        F.avg("average_f1").alias("average_f1_score"),
        F.min("avg_processing_time").alias("fastest_avg_time"),
        F.max("avg_processing_time").alias("slowest_avg_time"),
    )
