"""Prompts judged by rules: each that applies is an issue of a kind and severity that takes its penalty from its kind's score.

Scores are 1 less the penalties, 0 at least; kinds combine by fixed weights,
and a critical issue vetoes, whatever the scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.operators.prompt_library import named_type

#: Bounds of a prompt's length, words of the tax context, and a score that passes.
SHORTEST, LONGEST, PASS = 100, 4000, 0.7
CONTEXT = ["australian", "ato", "gst", "abn", "business"]
#: Words that a prompt for a type should hold.
TYPE_WORDS = {
    "fuel_receipt": ["fuel", "petrol", "diesel", "litres", "station"],
    "tax_invoice": ["tax invoice", "abn", "gst", "supplier"],
    "business_receipt": ["receipt", "business", "items", "total"],
    "bank_statement": ["bank", "statement", "transaction", "balance"],
    "meal_receipt": ["meal", "restaurant", "food", "dining"],
    "accommodation": ["hotel", "accommodation", "booking", "stay"],
    "travel_document": ["travel", "flight", "transport", "journey"],
    "parking_toll": ["parking", "toll", "vehicle", "duration"],
    "professional_services": ["professional", "services", "consulting", "legal"],
    "equipment_supplies": ["equipment", "supplies", "tools", "assets"],
}
#: What a model's prompts should be.
MODELS = {
    "internvl3": {"length": (500, 2000), "words": ["extract", "analyze", "image"], "highlights": True},
    "llama32_vision": {"length": (300, 1500), "words": ["compliance", "ato", "business"], "highlights": False},
}
SEVERITIES = ["critical", "warning", "minor"]


@dataclass
class Rule:
    kind: str
    severity: str
    penalty: float
    applies: Column


def _holds(text: Column, words: list[str]) -> Column:
    """How many of the words stand in a text as words."""
    return sum((text.rlike(rf"(?i)\b{w}\b").cast("int") for w in words), F.lit(0))


def _share(text: Column, doc_type: Column) -> Column:
    """The share of its type's words that a prompt holds; null for types without any."""
    out = F.lit(None).cast("double")
    for kind, words in TYPE_WORDS.items():
        out = F.when(doc_type == kind, _holds(text, words) / len(words)).otherwise(out)
    return out


def rules(text: Column, low: Column, share: Column, context: Column) -> list[Rule]:
    """All rules for prompts that are meant for both models, in the order in which issues are told."""
    n = F.length(text)
    out = [
        Rule("structure", "critical", 0.5, n < SHORTEST),
        Rule("structure", "warning", 0.2, n > LONGEST),
        Rule("structure", "warning", 0.1, ~text.rlike("(?i)(?:extract|analyze|process)")),
        Rule("structure", "minor", 0.05, ~text.rlike("(?i)(?:requirements?|fields?|information):")),
        Rule("content", "warning", 0.3, F.coalesce(share < 0.5, F.lit(False))),
        Rule("content", "minor", 0.1, F.coalesce((share >= 0.5) & (share < 0.8), F.lit(False))),
        Rule("content", "warning", 0.1, ~text.rlike("(?i)(?:format|structure|json|output)")),
    ]
    for model, m in MODELS.items():
        out.append(Rule(f"compatibility:{model}", "minor", 0.1, ~n.between(*m["length"])))
        out.append(Rule(f"compatibility:{model}", "warning", 0.2, _holds(text, m["words"]) < len(m["words"])))
        if not m["highlights"]:
            out.append(Rule(f"compatibility:{model}", "warning", 0.2, low.contains("highlight")))
    return out + [
        Rule("compliance", "warning", 0.3, context < 2),
        Rule("compliance", "minor", 0.1, low.contains("gst") & ~text.contains("10%")),
        Rule("compliance", "minor", 0.1, low.contains("date") & ~low.contains("dd/mm/yyyy")),
        Rule("compliance", "minor", 0.1, low.contains("abn") & ~low.contains("xx xxx xxx xxx")),
    ]


def _score(of: list[tuple[int, Rule]], kind: str) -> Column:
    lost = sum((F.when(F.get("hits", F.lit(i)), r.penalty).otherwise(0.0) for i, r in of if r.kind == kind), F.lit(0.0))
    return F.greatest(1.0 - lost, F.lit(0.0))


def judged(prompts: DataFrame) -> DataFrame:
    """prompts (prompt_id, text) with doc_type, effectiveness, compatibility, score, issues (kind_severity, in order) and passed; null texts are empty."""
    text = F.coalesce("text", F.lit(""))
    own = prompts.withColumns({"text": text, "doc_type": named_type(F.col("prompt_id"))})
    own = own.withColumns({"low": F.lower("text"), "share": _share(F.col("text"), F.col("doc_type")), "context": _holds(F.col("text"), CONTEXT)})
    all_rules = rules(F.col("text"), F.col("low"), F.col("share"), F.col("context"))
    of = list(enumerate(all_rules))
    own = own.withColumn("hits", F.array(*[r.applies for r in all_rules])).drop("low", "share", "context")
    effect = (_score(of, "structure") + _score(of, "content") + _score(of, "compliance")) / 3
    fit = sum((_score(of, f"compatibility:{m}") for m in MODELS), F.lit(0.0)) / len(MODELS)
    names = F.array(*[F.lit(_named(r)) for r in all_rules])
    told = F.transform(F.filter(F.arrays_zip(F.col("hits").alias("hit"), names.alias("name")), lambda x: x["hit"]), lambda x: x["name"])
    out = own.withColumns({"effectiveness": effect, "compatibility": fit, "issues": told}).drop("hits")
    vetoed = F.exists("issues", lambda i: i.endswith("_critical"))
    total = (F.col("effectiveness") + F.col("compatibility")) / 2
    return out.withColumn("score", total).withColumn("passed", (F.round("score", 9) >= PASS) & ~vetoed)


def _named(rule: Rule) -> str:
    return f"{rule.kind.split(':')[0]}_{rule.severity}"


def _times(kind: str) -> Column:
    """How often an issue was raised against a prompt."""
    return F.size(F.filter("issues", lambda i: i == kind))


def kinds_of_issues() -> list[str]:
    """Names of all issues that rules can raise, in their order."""
    none = F.lit("")
    return list(dict.fromkeys(_named(r) for r in rules(none, none, F.lit(0.0), F.lit(0))))


def library_report(checks: DataFrame, order: str = "prompt_id") -> DataFrame:
    """One row over judged prompts: total, passed, failed, average, a column for each kind of issue, the most common one, and advice.

    All in one pass: a kind's count and where it was first met (by `order`,
    which settles ties) are aggregates that merge.
    """
    kinds = kinds_of_issues()
    counts = []
    for k in kinds:
        n = _times(k)
        counts += [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(k), F.min(F.when(n > 0, F.struct(F.col(order), F.array_position("issues", k).alias("at")))).alias(f"first_{k}")]
    rows = checks.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average"), *counts)
    rows = rows.withColumn("failed", F.col("total") - F.col("passed"))
    met = F.filter(F.array(*[F.struct((-F.col(k)).alias("n"), F.col(f"first_{k}").alias("first"), F.lit(k).alias("kind")) for k in kinds]), lambda x: x["n"] < 0)
    top = F.get(F.array_sort(met), 0)
    advice = F.array(
        F.when(F.round("average", 9) < PASS, "Overall prompt quality below threshold - review and improve prompts"),
        F.when(F.col("failed") > F.col("passed"), "More prompts failed than passed - significant improvements needed"),
        F.when(top.isNotNull(), F.concat(F.lit("Most common issue: "), top["kind"], F.lit(" ("), (-top["n"]).cast("string"), F.lit(" occurrences)"))),
    )
    return rows.select("total", "passed", "failed", "average", *kinds, top["kind"].alias("most_common"), F.filter(advice, lambda a: a.isNotNull()).alias("recommendations"))


def counts_by_type(prompts: DataFrame) -> DataFrame:
    """doc_type and how many prompts tell of it by their names."""
    return prompts.groupBy(named_type(F.col("prompt_id")).alias("doc_type")).agg(F.count("*").alias("prompts"))
