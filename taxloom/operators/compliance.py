"""Compliance of extracted fields with what the tax office asks of each document type.

Fields come as a map from name to text. The score adds completeness (.30),
formats (.25), business (.20), tax sums (.15) and the type's own demands (.10).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.functions import validators as v
from taxloom.operators import registry as reg
from taxloom.operators.words import MOST_SOUGHT, Held, sought

#: Required and optional fields of each type, and whether GST and ABN must be there.
REQUIRED = {
    "tax_invoice": (["date", "total_amount", "supplier_name", "abn"], ["gst_amount", "invoice_number", "customer_name"], True),
    "business_receipt": (["date", "total_amount", "supplier_name"], ["gst_amount", "receipt_number"], False),
    "fuel_receipt": (["date", "total_amount", "supplier_name", "fuel_type"], ["litres", "price_per_litre", "gst_amount"], False),
    "bank_statement": (["date", "account_number", "bsb"], ["statement_period", "opening_balance", "closing_balance"], False),
    "meal_receipt": (["date", "total_amount", "supplier_name"], ["gst_amount", "receipt_number"], False),
    "accommodation": (["date", "total_amount", "supplier_name"], ["check_in_date", "check_out_date", "nights", "gst_amount"], False),
    "travel_document": (["date", "total_amount", "supplier_name"], ["flight_number", "passenger_name", "gst_amount"], False),
    "parking_toll": (["date", "total_amount"], ["location", "duration", "vehicle_registration"], False),
    "professional_services": (["date", "total_amount", "supplier_name", "description"], ["hours", "rate", "gst_amount", "abn"], True),
    "equipment_supplies": (["date", "total_amount", "supplier_name", "description"], ["quantity", "unit_price", "gst_amount", "abn"], False),
}
DATES = ["date", "check_in_date", "check_out_date", "invoice_date"]
AMOUNTS = ["total_amount", "subtotal", "gst_amount", "unit_price"]
WEIGHTS = {"completeness": 0.30, "formats": 0.25, "business_score": 0.20, "tax": 0.15, "specific": 0.10}
PASS, MOST_ISSUES = 0.4, 3


#: Every field that is asked for.
NAMES = list(dict.fromkeys([*DATES, *AMOUNTS, "abn", "bsb", "supplier_name", *(f for req, opt, _ in REQUIRED.values() for f in [*req, *opt])]))


def _value(name: str) -> Column:
    return F.col(f"asked.{name}")


def _has(name: str) -> Column:
    return F.col(f"told.{name}")


def _number(name: str) -> Column:
    return F.regexp_replace(_value(name), "[$,]", "").try_cast("double")


def _by_type(doc_type: Column, pick: Callable[..., Column], other: Column) -> Column:
    out = None
    for kind, spec in REQUIRED.items():
        out = F.when(doc_type == kind, pick(*spec)) if out is None else out.when(doc_type == kind, pick(*spec))
    return out.otherwise(other)


def _present(names: list[str]) -> Column:
    return sum((_has(n).cast("int") for n in names), F.lit(0))


def completeness(doc_type: Column) -> Column:
    """Share of required fields, and up to a fifth more for optional ones; half for a type without any."""
    share = lambda names: _present(names) / len(names)
    return _by_type(doc_type, lambda req, opt, _: F.least(share(req) + share(opt) * 0.2, F.lit(1.0)), F.lit(0.5))


def lacking(doc_type: Column) -> Column:
    """Whether a required field is missing, or the type is unknown."""
    return _by_type(doc_type, lambda req, _, __: _present(req) < len(req), F.lit(True))


def _format_checks(this_year: int) -> dict[str, Column]:
    """Whether each ABN, BSB, date and amount is well formed."""
    bsb = (F.length("bsb_digits") == 6) & v.bank_of(F.when(F.length("bsb_digits") >= 3, F.substring("bsb_digits", 1, 3).cast("int"))).isNotNull()
    day = lambda n: v.date_issue(_value(n), this_year, F.col(f"day_{n}")).isNull()
    amount = lambda n: F.coalesce(_number(n) >= 0, F.lit(False))
    return {"abn": F.col("abn_wrong").isNull(), "bsb": F.coalesce(bsb, F.lit(False))} | {n: day(n) for n in DATES} | {n: amount(n) for n in AMOUNTS}


def tax() -> Column:
    """1 if subtotal, GST and total agree, 0.3 if not; less is known where parts are missing."""
    have = [_has(n) for n in ("subtotal", "gst_amount", "total_amount")]
    s, g, t = (_number(n) for n in ("subtotal", "gst_amount", "total_amount"))
    partly = F.when(have[2] & ~have[1] & ~have[0], F.when(t.isNotNull(), 0.7).otherwise(0.5)).otherwise(0.8)
    whole = F.when(s.isNull() | g.isNull() | t.isNull(), 0.2).when(v.gst_valid(s, g, t), 1.0).otherwise(0.3)
    return F.when(have[0] & have[1] & have[2], whole).otherwise(partly)


def specific(doc_type: Column) -> Column:
    """What the type must have, less for each thing that it lacks."""
    must = _by_type(doc_type, lambda _, __, m: F.lit(m), F.lit(False))
    loss = F.when(must & ~_has("gst_amount"), 0.4).otherwise(0.0) + F.when(must & ~_has("abn"), 0.4).otherwise(0.0)
    loss = loss + F.when((doc_type == "fuel_receipt") & ~_has("fuel_type"), 0.2).otherwise(0.0)
    loss = loss + F.when((doc_type == "bank_statement") & ~(_has("account_number") & _has("bsb")), 0.3).otherwise(0.0)
    loss = loss + F.when((doc_type == "professional_services") & ~_has("description"), 0.2).otherwise(0.0)
    return F.greatest(1.0 - loss, F.lit(0.0))


def looked_up(docs: DataFrame, words: list[str], registry: tuple[reg.Business, ...] | None = None) -> tuple[DataFrame, dict[str, Held]]:
    """docs with low and low_supplier (text and supplier in lower case) and masks of the registry's keywords in both, and of more words in low."""
    rows = docs.withColumns({"low": F.lower("text"), "low_supplier": F.lower(F.coalesce(F.col("fields")["supplier_name"], F.lit("")))})
    known = reg.keywords(registry)
    if len(known) > MOST_SOUGHT:
        return (rows, {}) if not words else sought(rows, {"low": words})
    return sought(rows, {"low": [*known, *words], "low_supplier": known})


def assess(docs: DataFrame, this_year: int, registry: tuple[reg.Business, ...] | None = None, held: dict[str, Held] | None = None, names: list[str] | None = None) -> DataFrame:
    """Adds the components, compliance_score, n_issues, passed and advice to doc_type, text, fields rows.

    Each step is a column that the next ones refer to, so nothing is computed
    twice. `held` tells that docs comes from `looked_up`, `names` which fields
    there may be, if that is known.
    """
    fields, kind = F.col("fields"), F.col("doc_type")
    supplier = F.coalesce(_value("supplier_name"), F.lit(""))
    given = held is not None
    rows, held = (docs, held) if given else looked_up(docs, [], registry)
    rows = rows.withColumn("asked", F.struct(*[(fields[n] if names is None or n in names else F.lit(None).cast("string")).alias(n) for n in NAMES]))
    rows = rows.withColumn("told", F.struct(*[F.coalesce(F.trim(_value(n)) != "", F.lit(False)).alias(n) for n in NAMES]))
    rows = rows.withColumn("known", reg.by_low_name(F.col("low_supplier"), registry))
    rows = reg.with_best(rows, "low", "seen", registry, held.get("low") if "low_supplier" in held else None)
    # Suppliers count where the text names no business.
    rows = rows.withColumn("low_supplier", F.when(F.col("seen").isNull() & (supplier != ""), F.col("low_supplier")))
    rows = reg.with_best(rows, "low_supplier", "supplier_seen", registry, held.get("low_supplier"))
    rows = rows.withColumns({
        "seen": F.coalesce("seen", "supplier_seen"),
        "context": reg.context_count(F.col("known"), kind, fields),
        "abn_digits": v.digits(_value("abn")),
        "bsb_digits": v.digits(_value("bsb")),
        **{f"day_{n}": v.parse_date(_value(n)) for n in DATES},
    })
    rows = rows.withColumn("abn_wrong", v.abn_issue(_value("abn"), F.col("abn_digits")))
    checks = _format_checks(this_year)
    rows = rows.withColumns({"n_checks": _present(list(checks)), "n_wrong": sum(((_has(n) & ~good).cast("int") for n, good in checks.items()), F.lit(0))})
    suits = F.col("context") == 0
    business = F.when(F.col("seen").isNotNull(), F.col("seen.confidence") * F.when(suits, 1.0).otherwise(0.5)).when(_has("supplier_name"), 0.3).otherwise(0.0)
    rows = rows.withColumns({
        "completeness": completeness(kind),
        "formats": F.when(F.col("n_checks") > 0, 1.0 - F.col("n_wrong") / F.col("n_checks")).otherwise(1.0),
        "business_score": business,
        "tax": tax(),
        "specific": specific(kind),
        "lacking": lacking(kind),
        "unsuited": F.when(F.col("seen").isNotNull(), F.col("context")).otherwise(1),
    })
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.col(name) * weight
    issues = F.col("lacking").cast("int") + F.col("n_wrong") + F.col("unsuited") + F.col("tax").isin(0.2, 0.3, 0.5).cast("int") + (F.col("specific") < 1).cast("int")
    rows = rows.withColumns({"compliance_score": score, "n_issues": issues})
    rows = rows.withColumn("passed", (F.round("compliance_score", 9) >= PASS) & (F.col("n_issues") <= MOST_ISSUES))
    score = F.round("compliance_score", 9)
    advice = F.array(
        F.when(score < 0.3, "significant manual review").when(score < 0.6, "additional validation"),
        F.when(_has("abn") & F.col("abn_wrong").isNotNull(), "verify the ABN"),
        F.when(F.col("tax") < 0.5, "check the GST sums"),
        F.when(F.col("seen").isNull(), "verify the supplier"),
    )
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("advice", F.when(F.col("passed"), none).otherwise(F.filter(advice, lambda a: a.isNotNull())))
    own = ["asked", "told", "low_supplier", "supplier_seen", "known", "context", "abn_digits", "bsb_digits", *(f"day_{n}" for n in DATES), "abn_wrong", "n_checks", "n_wrong", "lacking", "unsuited"]
    return rows.drop(*own, *([] if given else ["low"]), *(h.column for k, h in held.items() if not given or k == "low_supplier"))
