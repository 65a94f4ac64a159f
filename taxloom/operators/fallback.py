"""Whether what a model read is good enough, or rules have to read the paper again.

Fields come as a map from name to text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is no receipt number, what says nothing, which names are not data, and the fields that hold dates.
NO_NUMBER = ["is", "it", "to", "of", "and", "the", "a", "an"]
NOTHING = ["n/a", "na", "not available", "not visible", "none", "", "-"]
METADATA = ["extracted_by", "fields_count", "extraction_method", "handler_type"]
DATES = ["invoice_date", "transaction_date", "date"]
LEAST_TOTAL = 5.0


def data(fields: Column) -> Column:
    """The fields that hold something, metadata aside."""
    return F.map_filter(fields, lambda k, v: ~k.isin(*METADATA) & F.coalesce(F.trim(v) != "", F.lit(False)))


def issues(fields: Column) -> Column:
    """How many of the fields that matter most cannot be right."""
    total = F.trim(F.regexp_replace(fields["total_amount"], "[$,]", ""))
    number, name = F.trim(fields["receipt_number"]), F.trim(fields["supplier_name"])
    wrong = [
        fields["total_amount"].isNotNull() & F.coalesce(total.try_cast("double") < LEAST_TOTAL, F.lit(True)),
        number.isNotNull() & ((F.length(number) <= 2) | F.lower(number).isin(*NO_NUMBER)),
        name.isNotNull() & (F.length(name) <= 2),
        *[fields[d].isNotNull() & (~fields[d].rlike("[0-9]") | (F.length(F.trim(fields[d])) < 8)) for d in DATES],
    ]
    return sum((F.coalesce(w, F.lit(False)).cast("int") for w in wrong), F.lit(0))


def meaningless(fields: Column) -> Column:
    """How many values say nothing."""
    said = F.transform(F.map_values(fields), lambda v: F.lower(F.trim(v)))
    return F.size(F.filter(said, lambda v: (F.length(v) <= 1) | v.isin(*NOTHING)))


def insufficient(fields: Column) -> Column:
    """Fewer than three fields, an important one that is wrong, or more than half that say nothing."""
    held = data(fields)
    return (F.size(held) < 3) | (issues(held) > 0) | (meaningless(held) > F.floor(F.size(held) / 2))


def preliminary_grade(fields: Column) -> Column:
    """A grade by the number of fields, what is wrong with them and how many say nothing."""
    held = data(fields)
    n, bad, empty = F.size(held), issues(held), meaningless(held)
    return (
        F.when((n < 3) | (bad >= 3), "very_poor")
        .when((n < 5) | (bad >= 2) | (empty > F.floor(n / 2)), "poor")
        .when((n < 7) | (bad >= 1) | (empty > F.floor(n / 3)), "fair")
        .when((n >= 8) & (bad == 0) & (empty == 0), "excellent")
        .otherwise("good")
    )
