"""Free text: response cleanup, bank names, prompt routing, table rows and highlighted transactions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns that name a bank, with its official name and category.
BANKS = [
    ("ANZ Bank", "big_four", r"\b(?:anz|australia and new zealand)\b"),
    ("Commonwealth Bank of Australia", "big_four", r"\b(?:commonwealth|cba|commbank)\b"),
    ("Westpac Banking Corporation", "big_four", r"\bwestpac\b"),
    ("NAB Bank", "big_four", r"\b(?:nab|national australia bank)\b"),
    ("ING Australia", "online", r"\bing\s*(?:direct|bank)?\b"),
    ("Macquarie Bank", "regional", r"\bmacquarie\s*(?:bank)?\b"),
    ("Bendigo and Adelaide Bank", "regional", r"\bbendigo\s*(?:bank)?\b"),
    ("Suncorp Bank", "regional", r"\bsuncorp\s*(?:bank)?\b"),
    ("Bank of Queensland", "regional", r"\b(?:boq|bank of queensland)\b"),
    ("HSBC Bank Australia", "international", r"\bhsbc\b"),
    ("Citibank Australia", "international", r"\bcitibank\b"),
]
BANK_CONTEXT = ["statement", "account", "balance", "transaction", "bsb", "deposit", "withdrawal", "banking"]
#: What a response says, in the order asked, and the prompt that it leads to.
ROUTES = [
    ("fuel_receipt", ["costco", "bp", "shell", "caltex", "ampol", "mobil", "7-eleven", "united petroleum", "ulp", "unleaded", "diesel", "e10", "u91", "u95", "u98", "premium", "litre", " l ", ".l ", "price/l", "per litre", "fuel", "petrol", "gasoline"]),
    ("business_receipt", ["woolworths", "coles", "aldi", "target", "kmart", "bunnings", "officeworks", "harvey norman", "jb hi-fi", "big w", "myer", "ikea"]),
    ("accommodation", ["hotel", "motel", "resort", "accommodation", "booking", "reservation", "hilton", "marriott", "hyatt", "ibis", "mercure", "novotel", "crowne plaza", "check-in", "check-out", "guest", "room", "nights", "rate per night"]),
    ("professional_services", ["tax invoice", "invoice", "consulting", "legal", "accounting", "professional services", "deloitte", "pwc", "kpmg", "ey", "bdo", "law firm", "solicitor", "barrister", "chartered accountant", "tax agent", "legal advice", "consultation"]),
    ("meal_receipt", ["restaurant", "cafe", "coffee", "dining", "meal", "lunch", "dinner", "breakfast", "mcdonald's", "kfc", "subway", "domino's", "pizza hut", "hungry jack's", "menu", "table", "covers", "service charge", "gratuity"]),
    ("parking_toll", ["parking", "toll", "secure parking", "wilson parking", "care park", "parking fee", "hourly rate", "entry time", "exit time", "vehicle", "registration"]),
    ("equipment_supplies", ["computer", "laptop", "equipment", "supplies", "software", "hardware", "printer", "scanner", "monitor", "keyboard", "mouse", "cable", "electronics"]),
]
#: Words that tie a highlight to work, and words of its categories.
WORK_WORDS = ["business", "office", "work", "professional", "corporate", "fuel", "parking", "toll", "taxi", "uber", "hotel", "restaurant", "software", "equipment", "supplies", "training", "conference", "legal", "accounting", "consulting", "insurance", "bank fee"]
WORK_CATEGORIES = {
    "fuel": ["bp", "shell", "caltex", "ampol", "fuel", "petrol"],
    "parking": ["parking", "wilson", "secure"],
    "transport": ["uber", "taxi", "train", "bus"],
    "meals": ["restaurant", "cafe", "lunch", "dinner"],
    "office": ["officeworks", "supplies", "equipment"],
}
_STOPS = [r"(?is)Thank you.*$", r"(?is)Visit.*costco\.au.*$", r"(?is)Member #\d+.*$", r"(?is)\d{2}/\d{2}/\d{4}.*Thank.*$"]
#: Statements of at most so many highlights and transactions are matched one by one.
FEW_MARKS, MOST_TXNS = 64, 4096


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed once for a row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _told(text: Column, pattern: str, group: int) -> Column:
    """What a pattern's group reads, or null if that is nothing."""
    return bound(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))


def cleanup(text: Column, most: int = 1000) -> Column:
    """A model's answer without repeated words and phrases, cut at a receipt's closing words, in single spaces, `most` characters at most."""
    t = F.regexp_replace(text, r"(?i)\b(\w+)(?:\s+\1){2,}", "$1")
    t = F.regexp_replace(t, r"(?i)\b((?:\w+\s+){1,3})(?:\1){2,}", "$1")
    t = F.regexp_replace(t, r"(?i)\b(\w{1,5})\s+(?:\1\s+){4,}", "")
    out = None
    for p in _STOPS:
        shorter = F.trim(F.regexp_replace(t, p, ""))
        out = F.when(t.rlike(p), shorter) if out is None else out.when(t.rlike(p), shorter)
    t = F.regexp_replace(out.otherwise(t), r"\s+", " ")
    return F.trim(F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t))


def banks(text: Column) -> Column:
    """An array of (confidence, -order, bank, category) of the banks that a text names, the surest first."""
    low = F.lower(text)
    context = F.size(F.filter(F.array(*map(F.lit, BANK_CONTEXT)), lambda w: low.contains(w)))
    found = F.array(*[F.struct(F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(0))).alias("hits"), F.lit(-k).alias("ord"), F.lit(name).alias("bank"), F.lit(category).alias("category")) for k, (name, category, pattern) in enumerate(BANKS)])

    def one(b: Column, near: Column) -> Column:
        around = F.when(near >= 3, 0.2).when(near >= 1, 0.1).otherwise(0.0)
        score = F.lit(0.6) + F.when(F.exists(b["hits"], lambda h: F.length(h) > 10), 0.3).otherwise(0.0) + F.when(F.size(b["hits"]) > 1, 0.1).otherwise(0.0) + around
        return F.struct(F.round(F.least(score, F.lit(1.0)), 9).alias("confidence"), b["ord"].alias("ord"), b["bank"].alias("bank"), b["category"].alias("category"))

    named = F.filter(found, lambda b: F.size(b["hits"]) > 0)
    # The context is counted once, for texts that name a bank.
    return F.flatten(F.transform(F.array(context), lambda near: F.sort_array(F.transform(named, lambda b: one(b, near)), asc=False)))


def primary_bank(text: Column, least: float = 0.7) -> Column:
    """The surest bank in an array of one, or an empty array if none is sure enough: to be exploded, which computes it once."""
    return F.filter(F.slice(banks(text), 1, 1), lambda b: b["confidence"] >= least)


def route(response: Column, doc_type: Column) -> Column:
    """The prompt for a response: by the first group of signs that it shows, else by the document's type."""
    low = F.lower(response)
    out = None
    for kind, words in ROUTES:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, f"{kind}_extraction_prompt") if out is None else out.when(hit, f"{kind}_extraction_prompt")
    known = doc_type.isin("business_receipt", "fuel_receipt", "tax_invoice", "bank_statement")
    return out.otherwise(F.when(known, F.concat(doc_type, F.lit("_extraction_prompt"))).otherwise("business_receipt_extraction_prompt"))


def line_items(texts: DataFrame) -> DataFrame:
    """id, line, description, quantity, unit_price, line_total of every line that is an invoice item."""
    item = r"^(.+?)\s+(\d+(?:\.\d+)?)\s+\$?(\d+(?:\.\d{2})?)\s+\$?(\d+(?:\.\d{2})?)$"
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("line", "raw")).filter(F.col("raw").rlike(item))
    part = lambda k: F.regexp_extract("raw", item, k)
    return lines.select("id", "line", F.trim(part(1)).alias("description"), part(2).cast("double").alias("quantity"), part(3).cast("double").alias("unit_price"), part(4).cast("double").alias("line_total"))


def highlighted(text: Column) -> Column:
    """date, amount and what is left as description, of a highlight's text."""
    read = F.struct(_told(text, r"(\d{1,2}/\d{1,2}/\d{2,4})", 1).alias("date"), _told(text, r"([\-\+]?\$?\d+(?:\.\d{2})?)", 1).alias("amount"))

    def parts(r: Column) -> Column:
        rest = F.when(r["date"].isNotNull(), F.replace(text, r["date"], F.lit(""))).otherwise(text)
        rest = bound(rest, lambda left: F.when(r["amount"].isNotNull(), F.replace(left, r["amount"], F.lit(""))).otherwise(left))
        return F.struct(r["date"].alias("date"), r["amount"].alias("amount"), F.trim(rest).alias("description"))

    return bound(read, parts)


def work_score(text: Column) -> Column:
    """score, category and indicators of a highlight's text."""

    def of(low: Column) -> Column:
        words = F.filter(F.array(*map(F.lit, WORK_WORDS)), lambda w: low.contains(w))
        kinds = F.array(*[F.struct(F.round(0.3 * sum((low.contains(w).cast("int") for w in ws), F.lit(0)), 9).alias("s"), F.lit(-k).alias("ord"), F.lit(c).alias("c")) for k, (c, ws) in enumerate(WORK_CATEGORIES.items())])
        return bound(F.struct(words.alias("words"), F.array_max(kinds).alias("best")), scored)

    def scored(x: Column) -> Column:
        best = x["best"]
        score = F.least(0.2 * F.size(x["words"]) + F.least(best["s"], F.lit(0.6)), F.lit(1.0))
        return F.struct(score.alias("score"), F.when(best["s"] > 0, best["c"]).alias("category"), x["words"].alias("indicators"))

    return bound(F.lower(text), of)


def _two_of(words: Column) -> Column:
    """Every two of the words, joined."""
    return F.flatten(F.transform(words, lambda a, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda b: F.concat(a, F.lit(" "), b))))


def _signs(marks: DataFrame, by: str, words: Callable[[Column], Column]) -> DataFrame:
    """What may agree with a highlight, as rows: every two of its words, and every part of its amount's text, marked as one."""
    told = marks.select(by, "mark", F.explode(_two_of(words("marked"))).alias("sign"))
    n, i = F.length("shown"), F.col("i")
    starts = marks.select(by, "mark", "shown", F.explode(F.sequence(F.lit(1), n + 1)).alias("i"))
    parts = starts.select(by, "mark", "shown", "i", F.explode(F.sequence(F.when(i > n, 0).otherwise(1), n - i + 1)).alias("k"))
    return told.unionByName(parts.select(by, "mark", F.concat(F.lit("="), F.substring("shown", i, F.col("k"))).alias("sign")))


def enhanced(txns: DataFrame, marks: DataFrame, by: str, few: int = FEW_MARKS, most: int = MOST_TXNS) -> DataFrame:
    """Transactions with the first highlight of the same statement that matches, and the score that it lifts.

    A highlight matches if two words of the descriptions agree, or if its
    amount's text holds the transaction's. In statements of at most `few`
    highlights and `most` transactions each meets each in a join by `by`. In
    longer ones what may agree becomes a key, so they too cost no more than
    their rows. Both ways find the same.
    """
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    left = txns.select(by, "ord", "description", "amount", "work_score")
    right = marks.select(by, F.col("ord").alias("mark"), F.col("description").alias("marked"), F.col("amount").alias("shown"), "color")
    sizes = left.select(by, F.lit(1).alias("t"), F.lit(0).alias("m")).unionByName(right.select(by, F.lit(0).alias("t"), F.lit(1).alias("m"))).groupBy(by).agg(F.sum("t").alias("t"), F.sum("m").alias("m"))
    long = sizes.filter((F.col("t") > 0) & (F.col("m") > 0) & ((F.col("m") > few) | (F.col("t") > most))).select(by)

    asked = left.select(by, "ord", "amount", words("description").alias("words"))
    held = right.join(long, by, "left_anti").select(by, "mark", "color", "shown", words("marked").alias("marked"))
    agree = F.contains("shown", "amount") | (F.size(F.array_intersect("words", "marked")) >= 2)
    near = asked.alias("a").join(held.alias("b"), (F.col(f"a.{by}") == F.col(f"b.{by}")) & agree).select(f"a.{by}", "ord", "mark", "color")

    ordered = lambda c: F.array_sort(words(c))
    longer = right.join(long, by, "left_semi")
    signs = _signs(longer, by, ordered).groupBy(by, "sign").agg(F.min("mark").alias("mark"))
    keys = F.concat(F.coalesce(_two_of(ordered("description")), F.expr("cast(array() as array<string>)")), F.array(F.concat(F.lit("="), F.col("amount"))))
    met = left.join(long, by, "left_semi").select(by, "ord", F.explode(keys).alias("sign")).join(signs, [by, "sign"]).groupBy(by, "ord").agg(F.min("mark").alias("mark"))
    far = met.join(longer.select(by, "mark", "color"), [by, "mark"]).select(by, "ord", "mark", "color")

    first = near.unionByName(far).groupBy(by, "ord").agg(F.min(F.struct("mark", "color")).alias("m"))
    out = left.join(first, [by, "ord"], "left")
    lifted = F.when(F.col("m").isNotNull(), F.least(F.col("work_score") + 0.3, F.lit(1.0))).otherwise(F.col("work_score"))
    return out.select(by, "ord", "description", lifted.alias("work_score"), F.col("m").isNotNull().alias("highlighted"), F.col("m.color").alias("highlight_color"))


def last_amount(text: Column) -> Column:
    """The last amount in a line of recognised text, or null."""
    found = F.regexp_extract_all(text, F.lit(r"\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"), F.lit(1))
    return F.replace(F.element_at(F.when(F.size(found) > 0, found), -1), F.lit(","), F.lit("")).try_cast("double")


def best_engine(readings: DataFrame) -> DataFrame:
    """For each box the reading of the surest engine; the first name on a tie."""
    w = Window.partitionBy("image_id", "ord").orderBy(F.desc("confidence"), F.desc("engine"))
    return readings.withColumn("place", F.row_number().over(w)).filter("place = 1").drop("place")

#: Words in a model's answer that show fuel, and a bank.
FUEL_SIGNS = ["13ulp", "ulp", "unleaded", "diesel", "litre", " l ", ".l ", "price/l", "per litre", "fuel"]
BANK_SIGNS = ["account", "balance", "transaction", "deposit", "withdrawal", "bsb", "opening balance", "closing balance", "statement period", "account number", "sort code", "debit", "credit", "available balance", "current balance"]
FUEL_QUANTITY = r"\d+\.\d{2,3}\s*l\b|\d+\s*litre"
BANK_ACCOUNT = r"\d{3}-\d{3}\s+\d{4,10}|\bbsb\b|\baccount\s+number\b"
BUSINESS_PAPERS = ["receipt", "tax_invoice", "fuel_receipt", "bank_statement", "invoice"]


def _any(low: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: low.contains(w))


def _verdict(kinds: list[tuple[Column, str, float]]) -> Column:
    """document_type, confidence and is_business_document by the first condition that holds, else unknown at a half."""
    out = None
    for when, kind, confidence in kinds:
        value = F.struct(F.lit(kind).alias("document_type"), F.lit(confidence).alias("confidence"), F.lit(kind in BUSINESS_PAPERS and confidence > 0.7).alias("is_business_document"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit("unknown").alias("document_type"), F.lit(0.5).alias("confidence"), F.lit(False).alias("is_business_document")))


def classify_answer(text: Column) -> Column:
    """The type that a model's answer names; signs of fuel and of a bank in it count more than what it says."""
    low = F.lower(text)
    says = lambda *words: _any(low, list(words))
    return _verdict([
        (says("fuel_receipt", "fuel receipt"), "fuel_receipt", 0.90),
        (_any(low, FUEL_SIGNS) | low.rlike(FUEL_QUANTITY), "fuel_receipt", 0.95),
        (says("fuel", "petrol"), "fuel_receipt", 0.85),
        (says("tax_invoice", "tax invoice"), "tax_invoice", 0.85),
        (low.contains("tax") & low.contains("invoice"), "tax_invoice", 0.80),
        (says("bank_statement", "bank statement"), "bank_statement", 0.90),
        (_any(low, BANK_SIGNS) | low.rlike(BANK_ACCOUNT), "bank_statement", 0.95),
        (low.contains("bank"), "bank_statement", 0.75),
        (low.contains("receipt"), "receipt", 0.75),
        (low.contains("invoice"), "tax_invoice", 0.70),
    ])


def classify_answer_plainly(text: Column) -> Column:
    """The type that a model's answer names, and nothing else."""
    low = F.lower(text)
    says = lambda *words: _any(low, list(words))
    return _verdict([
        (says("fuel_receipt", "fuel receipt"), "fuel_receipt", 0.90),
        (says("tax_invoice", "tax invoice"), "tax_invoice", 0.85),
        (says("bank_statement", "bank statement"), "bank_statement", 0.85),
        (low.contains("receipt"), "receipt", 0.75),
        (low.contains("invoice"), "tax_invoice", 0.70),
    ])


def valid_text(text: Column) -> Column:
    """Whether recognised text is worth keeping: 2 to 200 characters with a letter or digit among them."""
    t = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    return F.coalesce(F.length(t).between(2, 200) & t.rlike("[a-zA-Z0-9]"), F.lit(False))


#: What a line of a statement holds.
DAY_FORMS = [r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{2,4}\b"]
AMOUNT_FORM = r"\$?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
REFERENCE_FORM = r"(?:ref|reference)[\s:]*([a-zA-Z0-9-]+)"
BSB_FORM, ACCOUNT_FORM = r"\b\d{3}[-\s]?\d{3}\b", r"\b\d{6,12}\b"
HOLDER_FORM = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
LAST_AMOUNT_FORM, FIRST_DAY_FORM = r"\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)", r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
READ_BSB, READ_ACCOUNT = r"(\d{3}-\d{3})", r"(?i)(?:account|acc)[\s:]*(\d{6,12})"
READ_BALANCE = r"(?i)(?:balance|bal)[\s:]*\$?(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def line_transaction(text: Column) -> Column:
    """date, description, amount, reference and type of a line by its largest amount; null without an amount."""
    bare = lambda a: F.regexp_replace(a, "[$,]", "").try_cast("double")
    amount = F.array_max(F.transform(_all(text, AMOUNT_FORM), bare))
    told = F.struct(F.coalesce(*[_told(text, "(?i)" + p, 0) for p in DAY_FORMS]).alias("date"), _told(text, "(?i)" + REFERENCE_FORM, 1).alias("reference"))

    def described(t: Column) -> Column:
        rest = F.when(t["date"].isNotNull(), F.regexp_replace(F.regexp_replace(text, DAY_FORMS[0], ""), "(?i)" + DAY_FORMS[1], "")).otherwise(text)
        rest = bound(rest, lambda r: F.when(t["reference"].isNotNull(), F.regexp_replace(r, "(?i)" + REFERENCE_FORM, "")).otherwise(r))
        return bound(_single_spaced(F.regexp_replace(rest, AMOUNT_FORM, "")), lambda r: F.when(r == "", "Transaction").otherwise(r))

    def row(a: Column) -> Column:
        return bound(told, lambda t: F.struct(t["date"].alias("date"), described(t).alias("description"), F.abs(a).alias("amount"), t["reference"].alias("reference"), F.when(a < 0, "debit").otherwise("credit").alias("type")))

    return bound(amount, lambda a: F.when(a.isNotNull(), row(a)))


def account_text(text: Column) -> Column:
    """bsb, account_number (the longest run of 6 to 12 digits) and account_holder (the first capitalised name of 10 to 50 letters)."""
    numbers = _all(text, ACCOUNT_FORM)
    longest = F.array_max(F.transform(numbers, lambda n, i: F.struct(F.length(n).alias("size"), (-i).alias("place"), n.alias("n"))))["n"]
    names = F.filter(_all(text, HOLDER_FORM), lambda n: F.length(n).between(10, 50))
    return F.struct(_told(text, BSB_FORM, 0).alias("bsb"), longest.alias("account_number"), F.get(names, 0).alias("account_holder"))


def read_transaction(text: Column) -> Column:
    """amount (the last one), date (the first one) and description of recognised text; null without an amount."""
    amounts, days = _all(text, LAST_AMOUNT_FORM, 1), _all(text, FIRST_DAY_FORM, 1)
    rest = F.aggregate(amounts, text, lambda acc, a: F.replace(F.replace(acc, F.concat(F.lit("$"), a), F.lit("")), a, F.lit("")))
    rest = F.aggregate(days, rest, lambda acc, d: F.replace(acc, d, F.lit("")))
    return F.when(F.size(amounts) > 0, F.struct(last_amount(text).alias("amount"), F.get(days, 0).alias("date"), F.trim(rest).alias("description")))


def read_account(text: Column) -> Column:
    """bsb, account_number and balance in recognised text."""
    got = lambda p: _told(text, p, 1)
    return F.struct(got(READ_BSB).alias("bsb"), got(READ_ACCOUNT).alias("account_number"), F.replace(got(READ_BALANCE), F.lit(","), F.lit("")).try_cast("double").alias("balance"))


def statement_roll_up(readings: DataFrame, by: str = "statement_id") -> DataFrame:
    """Of recognised texts (`by`, ord, text): transactions, their sum, and the last account details told."""
    rows = readings.filter(valid_text(F.col("text"))).withColumns({"t": read_transaction(F.col("text")), "a": read_account(F.col("text"))})
    last = [F.max_by(f"a.{k}", F.when(F.col(f"a.{k}").isNotNull(), F.col("ord"))).alias(k) for k in ("bsb", "account_number", "balance")]
    return rows.groupBy(by).agg(F.count("*").alias("texts"), F.count("t").alias("transactions"), F.sum(F.round(F.col("t.amount") * 100).cast("long")).alias("cents"), *last)


#: Names under which banks are known; a bank's own name comes with its category in BANKS.
BANK_NAMES = {
    "ANZ Bank": ["ANZ", "Australia and New Zealand"],
    "Commonwealth Bank of Australia": ["CBA", "CommBank", "Commonwealth"],
    "Westpac Banking Corporation": ["Westpac", "WBC"],
    "NAB Bank": ["NAB", "National Australia Bank"],
    "ING Australia": ["ING", "ING Direct"],
    "Macquarie Bank": ["Macquarie", "Macquarie Bank"],
    "Bendigo and Adelaide Bank": ["Bendigo", "Bendigo Bank"],
    "Suncorp Bank": ["Suncorp", "Suncorp Bank"],
    "Bank of Queensland": ["BOQ", "Bank of Queensland"],
    "HSBC Bank Australia": ["HSBC"],
    "Citibank Australia": ["Citi", "Citibank"],
}
#: Prefix ranges by official name. Validation has a table of its own (functions.validators), which differs in names, order and one bank.
NAMED_RANGES = {
    "ANZ Bank": [(10, 19), (70, 79), (550, 559)],
    "Commonwealth Bank of Australia": [(60, 69), (730, 739)],
    "Westpac Banking Corporation": [(30, 39), (340, 349), (730, 789)],
    "NAB Bank": [(80, 89), (300, 319)],
    "ING Australia": [(923, 923)],
    "Macquarie Bank": [(182, 182)],
    "Bendigo and Adelaide Bank": [(630, 639)],
    "Suncorp Bank": [(484, 484), (640, 649)],
    "Bank of Queensland": [(140, 149)],
    "HSBC Bank Australia": [(342, 342)],
    "Citibank Australia": [(243, 243)],
}


def _ranges(bank: str) -> str:
    """The ranges of a bank as text."""
    return ",".join(f"{lo}-{hi}" for lo, hi in NAMED_RANGES[bank])


def bank_category(name: Column) -> Column:
    """Category of the first bank whose own name this is, or one of whose names it holds."""
    low, out = F.lower(name), None
    for bank, category, _ in BANKS:
        hit = (low == bank.lower()) | _any(low, [n.lower() for n in BANK_NAMES[bank]])
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out


def is_big_four(name: Column) -> Column:
    """As bank_category, among the four big banks only."""
    low, out = F.lower(name), F.lit(False)
    for bank, category, _ in BANKS:
        if category == "big_four":
            out = out | (low == bank.lower()) | _any(low, [n.lower() for n in BANK_NAMES[bank]])
    return out


def bank_ranges(name: Column) -> Column:
    """Prefix ranges of the first bank whose own name holds this one, or one of whose names is in it."""
    low, out = F.lower(name), None
    for bank in NAMED_RANGES:
        hit = F.lit(bank.lower()).contains(low) | _any(low, [n.lower() for n in BANK_NAMES[bank]])
        out = F.when(hit, _ranges(bank)) if out is None else out.when(hit, _ranges(bank))
    return out.otherwise("")


#: What the content of a highlight is, by the first list of which a word occurs.
CONTENTS = {
    "transaction": ["$", "debit", "credit", "payment"],
    "account_info": ["account", "bsb", "balance"],
    "header": ["statement", "period", "from", "to"],
}
FUEL_WORDS = ["costco", "ulp", "unleaded", "diesel", "litre", "fuel", "petrol"]
#: Transactions with a balance, wherever they stand; a pump, a place and an odometer.
BALANCED = r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s+(.+?)\s+\$?(\d+(?:\.\d{2})?)\s+\$?(\d+(?:\.\d{2})?)"
FUEL_DETAILS = {"pump_number": r"(?i)pump\s+(\d+)", "location": r"(?i)location[:\s]+(.+?)(?:\n|$)", "odometer": r"(?i)odometer[:\s]+(\d+)"}


def content(text: Column) -> Column:
    """What a highlight holds; without a word that tells, an amount makes it a transaction."""

    def of(low: Column) -> Column:
        out = F.when(F.coalesce(low, F.lit("")) == "", "unknown")
        for kind, words in CONTENTS.items():
            out = out.when(_any(low, words), kind)
        return out.when(low.rlike(r"\d+\.\d{2}"), "transaction").otherwise("unknown")

    return bound(F.lower(text), of)


def fuel_after_all(answer: Column) -> Column:
    """Whether an answer that says tax invoice tells of fuel."""
    return _any(F.lower(answer), FUEL_WORDS)


def balanced_transactions(texts: DataFrame) -> DataFrame:
    """id, nth, date, description, amount and balance of all transactions of a text, several on a line included."""
    part = lambda k: _all(F.col("text"), BALANCED, k)
    rows = texts.select("id", F.posexplode(F.arrays_zip(*[part(k).alias(n) for k, n in ((1, "date"), (2, "description"), (3, "amount"), (4, "balance"))])).alias("nth", "t"))
    return rows.select("id", "nth", "t.date", F.trim("t.description").alias("description"), "t.amount", "t.balance")


def fuel_details(text: Column) -> Column:
    return F.struct(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")).alias(k) for k, p in FUEL_DETAILS.items()])
