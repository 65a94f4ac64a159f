"""Prioritised extraction rules, compiled into column expressions.

A rule is a pattern for one field of some document types. For each type and
field the rules are tried from the highest priority down, in listed order on a
tie. All rules are columns of one row, so no row is multiplied and nothing is
shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.functions.validators import abn_format, digits

TYPES = ["business_receipt", "fuel_receipt", "tax_invoice", "bank_statement", "meal_receipt", "accommodation", "travel_document", "parking_toll", "equipment_supplies", "professional_services", "other", "unknown"]
_MONEY = r"\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"
_ABN = r"(\d{2}\s?\d{3}\s?\d{3}\s?\d{3})"
_NAME = r"[\s:]*([A-Z][A-Za-z\s&,.-]+?)(?:\n|$|(?:abn|phone|address))"
_PAPERS = ["tax_invoice", "business_receipt"]


@dataclass(frozen=True)
class Rule:
    field: str
    priority: int
    pattern: str
    types: tuple[str, ...] = tuple(TYPES)
    valid: str | None = None


#: Patterns, fields, priorities and document types of the rules, in their order.
RULES = [
    Rule("date", 15, r"DATE:\s*(\d{1,2}/\d{1,2}/\d{4})"),
    Rule("supplier", 15, r"STORE:\s*(.+?)(?:\n|$)"),
    Rule("total", 15, r"TOTAL:\s*" + _MONEY),
    Rule("total", 20, r"SUBTOTAL:\s*\$[\d,.]+\s*GST[^$]*\$[\d,.]+\s*TOTAL:\s*" + _MONEY, ("business_receipt", "tax_invoice")),
    Rule("total", 18, r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s*\$\d{1,2}(?:\.\d{2})?\s*\$(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*SUBTOTAL:\s*GST.*?TOTAL:", ("business_receipt",)),
    Rule("total", 17, r"TOTAL:\s*\$?(\d{3,}(?:\.\d{2})?)", ("business_receipt",)),
    Rule("gst", 15, r"TAX:\s*(\d+(?:\.\d{2})?)"),
    Rule("abn", 15, r"ABN:\s*" + _ABN),
    Rule("date", 10, r"(?:date|invoice\s+date|issue\s+date|transaction\s+date)[\s:]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
    Rule("date", 8, r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})"),
    Rule("date", 9, r"(\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4})"),
    Rule("total", 10, r"(?:total|amount\s+due|grand\s+total|final\s+total)[\s:]*" + _MONEY),
    Rule("subtotal", 9, r"(?:subtotal|sub\s+total)[\s:]*" + _MONEY),
    Rule("amount", 6, r"\$(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*$"),
    Rule("gst", 10, r"(?:gst|tax|vat)[\s:]*" + _MONEY),
    Rule("total", 9, r"(?:including|incl\.?)\s+gst[\s:]*" + _MONEY, tuple(_PAPERS)),
    Rule("abn", 10, r"(?:abn|australian\s+business\s+number)[\s:]*" + _ABN, tuple(_PAPERS), r"^\d{11}$"),
    Rule("abn", 6, r"\b" + _ABN + r"\b", tuple(_PAPERS), r"^\d{11}$"),
    Rule("invoice_number", 10, r"(?:invoice\s+(?:no|number)|inv\s+no)[\s:]*([A-Z0-9-]+)", tuple(_PAPERS)),
    Rule("reference", 8, r"(?:ref|reference)[\s:]*([A-Z0-9-]+)"),
    Rule("invoice_number", 15, r"RECEIPT:\s*[^#]*#(\d+)", ("business_receipt",)),
    Rule("invoice_number", 12, r"(?:receipt\s+(?:no|number)|rcpt\s+no)[\s:]*#?([A-Z0-9]+)", ("business_receipt",)),
    Rule("supplier", 9, r"(?:supplier|vendor|from)" + _NAME, tuple(_PAPERS)),
    Rule("customer", 9, r"(?:customer|to|bill\s+to)" + _NAME, ("tax_invoice",)),
    Rule("reference", 9, r"(?:pump|pump\s+no)[\s:]*(\d+)", ("fuel_receipt",)),
    Rule("litres", 10, r"(\d+\.?\d*)\s*(?:l|litres?|liters?)", ("fuel_receipt",)),
    Rule("price_per_litre", 10, r"(\d+\.?\d*)\s*(?:c/l|cents?/litre?|cents?/liter?)", ("fuel_receipt",)),
    Rule("fuel_type", 9, r"(?:unleaded|premium|diesel|e10|e85)[\s:]*(\w+)", ("fuel_receipt",)),
    Rule("bsb", 10, r"(?:bsb|bank\s+state\s+branch)[\s:]*(\d{3}[-\s]?\d{3})", ("bank_statement",)),
    Rule("account_number", 10, r"(?:account\s+(?:no|number)|acc\s+no)[\s:]*(\d{6,12})", ("bank_statement",)),
    Rule("quantity", 8, r"(?:qty|quantity)[\s:]*(\d+)", ("business_receipt", "meal_receipt")),
    Rule("unit_price", 8, r"(?:unit\s+price|price\s+each|each)[\s:]*\$?(\d+\.?\d*)", ("business_receipt",)),
    Rule("supplier", 9, r"\b(woolworths|coles|aldi|target|kmart|bunnings|officeworks)\b", ("business_receipt",)),
    Rule("supplier", 9, r"\b(bp|shell|caltex|ampol|mobil|7-eleven)\b", ("fuel_receipt",)),
    Rule("supplier", 9, r"\b(anz|commonwealth\s+bank|westpac|nab|ing|macquarie)\b", ("bank_statement",)),
]
FIELDS = list(dict.fromkeys(r.field for r in RULES))
#: Words near a field that make its value more credible.
CONTEXT = {"date": ["date", "invoice", "transaction"], "total": ["total", "amount", "due"], "gst": ["gst", "tax", "vat"], "abn": ["abn", "business", "number"]}


def rules_for(doc_type: str, field: str, rules: list[Rule] | None = None) -> list[Rule]:
    """The rules of a field that apply to a type, in the order in which they are tried."""
    return sorted((r for r in rules or RULES if r.field == field and doc_type in r.types), key=lambda r: -r.priority)


def needed(pattern: str) -> list[str]:
    """Texts in lower case of which one is in whatever a pattern matches, case aside; none if that is not plain to see.

    A pattern is looked at where it starts: with a literal, or with a group of
    alternatives that do.
    """
    rest = pattern.removeprefix(r"\b")
    group = re.match(r"\((?:\?:)?((?:\\.|[^()\[\]?\\])*(?:\?(?:\\.|[^()\[\]?\\])*)*)\)(?![?*{|])", rest)
    outside = re.sub(r"\\.|\[[^\]]*\]", "", rest)
    while outside != (inner := re.sub(r"\([^()]*\)", "", outside)):
        outside = inner
    out = []
    for way in [] if "|" in outside else group[1].split("|") if group else [rest]:
        start = re.match(r"[A-Za-z0-9 :-]*", way)[0]
        out.append((start[:-1] if way[len(start) : len(start) + 1] in ("?", "*", "{") else start).lower())
    return out if all(len(x) > 1 for x in out) else []


def found(text: Column, rule: Rule) -> Column:
    """What a rule reads, trimmed; null if it does not match or the value is not valid. The pattern is tried once."""
    value = F.array_remove(F.array(F.trim(F.regexp_extract(text, "(?im)" + rule.pattern, 1))), "")
    return F.get(F.filter(value, lambda x: x.rlike(rule.valid)) if rule.valid else value, 0)


def cleaned(field: str, value: Column) -> Column:
    """A raw value in its field's form."""
    if field in ("total", "subtotal", "amount"):
        number = F.regexp_replace(value, r"[$,\s]", "")
        return F.when(number.try_cast("double").isNotNull(), number).otherwise(value)
    if field == "abn":
        return abn_format(value)
    if field == "bsb":
        d = digits(value)
        return F.when(F.length(d) == 6, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3))).otherwise(value)
    if field in ("supplier", "customer"):
        return title(F.regexp_replace(value, r"\s+", " "))
    if field == "fuel_type":
        return F.when(F.lower(value).isin("unleaded", "premium", "diesel", "e10", "e85"), F.initcap(F.lower(value))).otherwise(title(value))
    if field in ("litres", "price_per_litre"):
        return F.format_string("%.2f", value.try_cast("double"))
    return value


def title(value: Column) -> Column:
    """Capitals after every character that is not a letter, the rest in lower case."""
    letters = F.split(F.lower(value), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(letters, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def confidence(value: Column, points: Column, field: str, low: Column) -> Column:
    """Credibility of a value: its rule's points for priority and validation, the value's length and words in the text."""
    n = F.length(value)
    score = points + F.when(n > 1, 0.2).otherwise(0.0) + F.when(n > 5, 0.1).otherwise(0.0)
    for word in CONTEXT.get(field, []):
        score = score + F.when(low.contains(word), 0.05).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def points(rule: Rule) -> float:
    return rule.priority / 10 * 0.4 + (0.2 if rule.valid else 0.0)


def extract(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Adds a struct of value and confidence for each field of doc_type, text rows; null where no rule reads anything.

    A field's rules are tried until one reads something, and only in texts of
    their types that hold a word with which the pattern starts. What is read
    carries its rule's place in front. One order of a field's rules serves all
    types.
    """
    rules = rules or RULES
    rows = docs.withColumn("low", F.lower("text"))
    fields = list(dict.fromkeys(r.field for r in rules))

    def tried(k: int, rule: Rule) -> Column:
        read, near = F.concat(F.lit(f"{k:06d}"), found(F.col("text"), rule)), needed(rule.pattern)
        if near:
            read = F.when(_any([F.col("low").contains(w) for w in near]), read)
        return read if set(rule.types) == set(TYPES) else F.when(F.col("doc_type").isin(*rule.types), read)

    order = {f: sorted((k for k, r in enumerate(rules) if r.field == f), key=lambda k: -rules[k].priority) for f in fields}
    rows = rows.withColumns({f: F.coalesce(*[tried(k, rules[k]) for k in order[f]]) for f in fields})
    of = F.array(*[F.lit(points(r)) for r in rules])
    rows = rows.withColumns({f: F.when(F.col(f).isNotNull(), F.struct(F.substring(f, 7, 1 << 30).alias("value"), F.get(of, F.substring(f, 1, 6).cast("int")).alias("points"))) for f in fields})
    done = {f: F.when(F.col(f).isNotNull(), F.struct(cleaned(f, F.col(f)["value"]).alias("value"), confidence(F.col(f)["value"], F.col(f)["points"], f, F.col("low")).alias("confidence"))) for f in fields}
    return rows.withColumns(done).drop("low")


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def long_form(extracted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each field that was read."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.value").alias("value"), F.col(f"{f}.confidence").alias("confidence")) for f in FIELDS if f in extracted.columns])
    rows = extracted.select(id_col, "doc_type", F.explode(F.filter(fields, lambda x: x["value"].isNotNull())).alias("f"))
    return rows.select(id_col, "doc_type", "f.field", "f.value", "f.confidence")


def rule_statistics() -> dict[str, dict[str, int]]:
    """How many rules there are for each field and each type."""
    return {"field": {f: sum(r.field == f for r in RULES) for f in FIELDS}, "type": {t: sum(t in r.types for r in RULES) for t in TYPES}}
