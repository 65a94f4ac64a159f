"""Checks of Australian identifiers, dates, amounts and GST as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABN_WEIGHTS = [1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
#: Prefix ranges by bank in the order in which they are tried.
BANK_RANGES = [
    ("ANZ", "big_four", 10, 19),
    ("ANZ", "big_four", 70, 79),
    ("ANZ", "big_four", 550, 559),
    ("Commonwealth Bank", "big_four", 60, 69),
    ("Commonwealth Bank", "big_four", 730, 739),
    ("Westpac", "big_four", 30, 39),
    ("Westpac", "big_four", 340, 349),
    ("Westpac", "big_four", 730, 789),
    ("NAB", "big_four", 80, 89),
    ("NAB", "big_four", 300, 319),
    ("Bendigo Bank", "regional", 630, 639),
    ("Suncorp", "regional", 484, 484),
    ("Suncorp", "regional", 640, 649),
    ("ING", "online", 923, 923),
    ("Macquarie", "regional", 182, 182),
    ("Bank of Queensland", "regional", 124, 124),
    ("HSBC", "international", 342, 342),
    ("Citibank", "international", 243, 243),
]
#: Categories of banks that only the fuller check knows.
LATER = ["international"]
#: Date shapes: what the text must match, and how the rest is read.
_DATE_SHAPES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\s+\d{1,2}\s+\d{4}$", "d M yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"),
]
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_FULL = "january february march april may june july august september october november december".split()
GST_RATE, GST_TOLERANCE, GST_THRESHOLD = 0.10, 0.005, 75000.0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(F.regexp_replace(value, r"\s+", " ")) == "")


def abn_checksum(d: Column) -> Column:
    """Whether 11 digits pass: the first less one times ten plus the weighted rest is a multiple of 89."""
    at = lambda i: F.substring(d, i, 1).cast("int")
    total = (at(1) - 1) * 10
    for k, w in enumerate(ABN_WEIGHTS):
        total = total + at(k + 2) * w
    return (at(1) >= 1) & (total % 89 == 0)


def abn_issue(value: Column, own: Column | None = None) -> Column:
    """What is wrong with an ABN, or null; `own` are its digits, if they are known."""
    d = digits(value) if own is None else own
    wrong = F.when(blank(value), "ABN is required").when(F.length(d) != 11, F.concat(F.lit("ABN must be 11 digits, got "), F.length(d).cast("string")))
    return F.when(wrong.isNotNull(), wrong).when(~abn_checksum(d), "ABN checksum validation failed")


def abn_format(value: Column) -> Column:
    """XX XXX XXX XXX for 11 digits, else the digits."""
    d = digits(value)
    return F.when(F.length(d) == 11, F.concat_ws(" ", F.substring(d, 1, 2), F.substring(d, 3, 3), F.substring(d, 6, 3), F.substring(d, 9, 3))).otherwise(d)


def bsb_format(value: Column) -> Column:
    """XXX-XXX for six digits, else the digits."""
    d = digits(value)
    return F.when(F.length(d) == 6, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3))).otherwise(d)


def bank_of(prefix: Column, what: str = "bank") -> Column:
    """Bank or category whose range holds an integer prefix; the first range listed wins."""
    out = None
    for bank, category, lo, hi in BANK_RANGES:
        value = bank if what == "bank" else category
        out = F.when(prefix.between(lo, hi), value) if out is None else out.when(prefix.between(lo, hi), value)
    return out


def bsb_prefix(value: Column) -> Column:
    """The first three digits as an integer, or null."""
    d = F.substring(digits(value), 1, 6)
    return F.when(F.length(d) >= 3, F.substring(d, 1, 3).cast("int"))


def bsb_issues(value: Column) -> Column:
    """All that is wrong with a BSB, as an array; empty for a valid one."""
    d = digits(value)
    n = F.length(d)
    six = F.substring(d, 1, 6)
    found = F.array(
        F.when((n > 0) & (n < 6), F.concat(F.lit("BSB too short: "), n.cast("string"), F.lit(" digits (expected 6)"))),
        F.when(n > 6, F.concat(F.lit("BSB too long: "), n.cast("string"), F.lit(" digits (expected 6)"))),
        F.when((n >= 3) & bank_of(bsb_prefix(value)).isNull(), "BSB not recognized as valid Australian bank"),
        F.when(six == "000000", "Invalid BSB: 000-000 is not a valid bank code"),
        F.when(six == "123456", "BSB appears to be a placeholder (123-456)"),
    )
    return F.when(blank(value), F.array(F.lit("BSB is required"))).when(n == 0, F.array(F.lit("BSB contains no digits"))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def bsb_well_formed(value: Column) -> Column:
    """Whether a BSB has six digits, whatever stands between them."""
    return F.coalesce(F.length(digits(value)) == 6, F.lit(False))


def bsb_suggestions(value: Column) -> Column:
    """What to do about what bsb_issues finds, as an array; empty for a valid BSB."""
    d = digits(value)
    n = F.length(d)
    six = F.substring(d, 1, 6)
    unknown = (n >= 3) & bank_of(bsb_prefix(value)).isNull()
    found = F.array(
        F.when((n > 0) & (n < 6), F.concat(F.lit("Add "), (6 - n).cast("string"), F.lit(" more digits to complete BSB"))),
        F.when(n > 6, "Remove extra digits - BSB should be exactly 6 digits"),
        F.when(unknown, "Verify BSB with your bank"),
        F.when(unknown, "Check for typos in the BSB number"),
        F.when(unknown, "Ensure BSB belongs to an Australian bank"),
        F.when(six == "000000", "Use your bank's actual BSB number"),
        F.when(six == "123456", "Replace with your bank's actual BSB number"),
    )
    return F.when(blank(value), F.array(F.lit("Please provide a 6-digit BSB number"))).when(n == 0, F.array(F.lit("BSB should be 6 digits (e.g., 123-456)"))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def bsb_checked(value: Column) -> Column:
    """The plainer check of compliance: exactly six digits and one of nine banks, as valid, formatted, issue and bank."""
    d = digits(value)
    short = F.when(blank(value), "BSB is required").when(F.length(d) != 6, F.concat(F.lit("BSB must be 6 digits, got "), F.length(d).cast("string")))
    prefix = F.substring(d, 1, 3).cast("int")
    bank = F.lit(None).cast("string")
    for name, category, lo, hi in reversed(BANK_RANGES):
        if category not in LATER:
            bank = F.when(prefix.between(lo, hi), name).otherwise(bank)

    def told(x: Column) -> Column:
        issue = F.when(x["short"].isNotNull(), x["short"]).when(x["bank"].isNull(), "BSB not recognized as valid Australian bank")
        shown = F.when(blank(x["value"]), "").when(F.length(x["d"]) == 6, bsb_format(x["d"])).otherwise(x["d"])
        return F.struct(issue.isNull().alias("valid"), F.coalesce(shown, F.lit("")).alias("formatted"), issue.alias("issue"), F.when(x["short"].isNull(), x["bank"]).alias("bank"))

    both = F.struct(value.alias("value"), d.alias("d"), short.alias("short"), F.when(F.length(d) == 6, bank).alias("bank"))
    return F.element_at(F.transform(F.array(both), told), 1)


def bsb_nearest(value: Column, within: int = 20) -> Column:
    """The bank whose range is nearest to an unknown six-digit BSB's prefix, at most `within` away; the first listed on a tie."""
    prefix = bsb_prefix(value)
    near = F.array(*[F.struct(F.least(F.abs(prefix - lo), F.abs(prefix - hi)).alias("distance"), F.lit(k).alias("ord"), F.lit(bank).alias("bank")) for k, (bank, _, lo, hi) in enumerate(BANK_RANGES)])
    best = F.array_min(F.filter(near, lambda x: x["distance"] <= within))
    return F.when((F.length(F.substring(digits(value), 1, 6)) == 6) & bank_of(prefix).isNull(), best["bank"])


def parse_date(value: Column) -> Column:
    """A date in any of the supported day-first shapes, or null. Two-digit years from 69 on are 19xx."""
    t = F.trim(value)
    reads = []
    for shape, fmt in _DATE_SHAPES:
        text = F.regexp_replace(t, r"\s+", " ")
        d = F.to_date(F.try_to_timestamp(text, F.lit(fmt)))
        if fmt.endswith("yy") and not fmt.endswith("yyyy"):
            d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
        reads.append(F.when(t.rlike(shape), d))
    word = F.lower(F.regexp_extract(t, r"^\d{1,2}\s+([A-Za-z]+)\s+\d{4}$", 1))
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), word)
    month = F.when(month > 0, month).otherwise(F.array_position(F.array(*map(F.lit, _FULL)), word))
    named = F.concat_ws("/", F.regexp_extract(t, r"^(\d{1,2})\s", 1), month.cast("string"), F.regexp_extract(t, r"(\d{4})$", 1))
    reads.append(F.when(month > 0, F.to_date(F.try_to_timestamp(named, F.lit("d/M/yyyy")))))
    return F.coalesce(*reads)


def date_issue(value: Column, this_year: int, parsed: Column | None = None) -> Column:
    """What is wrong with a date, or null; `parsed` is the date that it tells, if that is known."""
    d = parse_date(value) if parsed is None else parsed
    wrong = F.when(blank(value), "Date is required").when(d.isNull(), F.concat(F.lit("Invalid date format. Expected DD/MM/YYYY, got: "), value))
    late = F.concat(F.lit("Date year "), F.year(d).cast("string"), F.lit(f" outside reasonable range (1950-{this_year + 2})"))
    return wrong.when((F.year(d) < 1950) | (F.year(d) > this_year + 2), late)


def financial_year(d: Column) -> Column:
    """July to June, as 2023-2024."""
    start = F.year(d) - F.when(F.month(d) >= 7, 0).otherwise(1)
    return F.concat(start.cast("string"), F.lit("-"), (start + 1).cast("string"))


def amount_value(value: Column) -> Column:
    """The size of a well-formed amount, or null."""
    t = F.trim(value)
    number = F.regexp_replace(t, r"[$,]", "").cast("double")
    return F.when(t.rlike(r"^-?\$?(\d{1,3}(,\d{3})*|\d+)(\.\d{1,2})?$"), F.abs(number))


def amount_issue(value: Column) -> Column:
    t = F.trim(value)
    wrong = F.when(blank(value), "Amount is required").when(amount_value(value).isNull(), "Invalid amount format")
    return wrong.when(t.startswith("-") & (amount_value(value) > 0), "Amount cannot be negative")


def gst_valid(subtotal: Column, gst: Column, total: Column) -> Column:
    """Whether GST is a tenth of the subtotal and the total their sum, within half a cent; no GST at all is valid."""
    expected = subtotal * GST_RATE
    sound = (subtotal >= 0) & (gst >= 0) & (total >= 0)
    close = (F.abs(gst - expected) <= GST_TOLERANCE) & (F.abs(total - (subtotal + expected)) <= GST_TOLERANCE)
    return F.when((gst == 0) & (total == subtotal), True).otherwise(sound & close)


def gst_rounded(subtotal: Column, gst: Column, total: Column) -> Column:
    """As gst_valid, against GST rounded to cents."""
    expected = F.floor(subtotal * GST_RATE * 100 + 0.5) / 100
    return F.when((gst == 0) & (total == subtotal), True).otherwise((F.abs(gst - expected) <= GST_TOLERANCE) & (F.abs(total - (subtotal + expected)) <= GST_TOLERANCE))


def gst_part(total: Column) -> Column:
    """GST in an inclusive total."""
    return total * (GST_RATE / (1 + GST_RATE))
