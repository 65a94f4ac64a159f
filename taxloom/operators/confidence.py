"""Confidence in an extraction: four components, caps, grade, flags and advice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxloom.operators.batch import grade
from taxloom.operators.words import Held

#: Weights of the components; their order is that of the sum.
WEIGHTS = {"classification": 0.25, "extraction": 0.35, "compliance": 0.25, "business": 0.15}
KEY_FIELDS = ["date", "total_amount", "supplier_name", "business_name"]
#: Names and places that show an Australian business.
BUSINESSES = ["woolworths", "coles", "aldi", "target", "kmart", "bunnings", "bp", "shell", "caltex", "ampol", "mobil", "7-eleven", "anz", "commonwealth bank", "westpac", "nab", "ing", "macquarie", "qantas", "jetstar", "virgin australia", "tigerair"]
PLACES = ["australia", "sydney", "melbourne", "brisbane", "perth", "adelaide"]
PRODUCTION, LEAST_FIELDS, LEAST_COMPLIANCE, LEAST_CLASS = 0.70, 3, 0.60, 0.60


def _has(fields: Column, name: str) -> Column:
    return F.coalesce(fields[name] != "", F.lit(False))


def field_count(fields: Column) -> Column:
    return F.size(F.map_filter(fields, lambda _, v: v.isNotNull() & (v != "")))


def extraction_quality(fields: Column, count: Column | None = None) -> Column:
    """Six fields are full marks for number; key fields and GST for kind. `count` is field_count, if that is known."""
    count = field_count(fields) if count is None else count
    kinds = sum((F.when(_has(fields, f), 1.0).otherwise(0.0) for f in KEY_FIELDS), F.lit(0.0)) + F.when(_has(fields, "gst_amount"), 0.5).otherwise(0.0)
    score = F.least(count / 6.0, F.lit(1.0)) * 0.6 + kinds / 5.0 * 0.4
    return F.when(F.size(fields) == 0, 0.0).otherwise(F.least(score, F.lit(1.0)))


#: All words that are looked for in a text.
WORDS = [*BUSINESSES, *PLACES, "abn", "gst"]


def business_recognition(text: Column, fields: Column, highlights: Column, held: Held | None = None) -> Column:
    """How surely a business is recognised; `held` tells which of WORDS a row's text holds, if that is known."""
    low = F.lower(text)
    count = held.count if held else lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    says = (lambda w: F.expr(held.has(w))) if held else low.contains
    score = 0.3 * count(BUSINESSES) + 0.1 * count(PLACES) + F.when(says("abn") | _has(fields, "abn"), 0.2).otherwise(0.0) + F.when(says("gst") | _has(fields, "gst_amount"), 0.2).otherwise(0.0) + F.when(highlights, 0.1).otherwise(0.0)
    return F.least(score, F.lit(1.0))


def assess(classification: Column, extraction: Column, compliance: Column, passed: Column, business: Column, fields: Column, count: Column | None = None) -> dict[str, Column]:
    """overall (capped), grade, production_ready, flags and advice; `count` is field_count, if that is known."""
    raw = classification * 0.25 + extraction * 0.35 + compliance * 0.25 + business * 0.15
    poor_class = classification < LEAST_CLASS
    overall = F.when(poor_class, F.least(raw, F.lit(0.5))).otherwise(raw)
    overall = F.when(~passed, F.least(overall, F.lit(0.4))).otherwise(overall)
    listed = lambda pairs: F.array_remove(F.array(*[F.when(c, t).otherwise("") for c, t in pairs]), "")
    few, below = (field_count(fields) if count is None else count) < LEAST_FIELDS, F.round(raw, 9) < PRODUCTION
    flags = [(poor_class, "low_classification_confidence"), (few, "insufficient_fields"), (compliance < LEAST_COMPLIANCE, "low_ato_compliance"), (~passed, "ato_compliance_failed"), (business < 0.3, "low_business_recognition"), (below, "below_production_threshold")]
    final = F.round(overall, 9)
    advice = [(classification < 0.6, "verify the document type"), (extraction < 0.6, "review extracted fields"), (compliance < 0.6, "verify compliance"), (business < 0.5, "verify the business"), (below, "below production threshold"), (~passed, "compliance failed"), (few, "insufficient fields"), (final >= 0.9, "ready for automated processing"), ((final < 0.9) & (final >= 0.7), "needs manual review"), (final < 0.7, "needs manual processing")]
    return {"overall": overall, "grade": grade(final), "production_ready": final >= PRODUCTION, "flags": listed(flags), "advice": F.sort_array(listed(advice))}
