"""Document types by keywords, format signs and business names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxloom.operators.words import Held, among, listed, sought

#: Words of each document type.
KEYWORDS = {
    "business_receipt": ["woolworths", "coles", "aldi", "target", "kmart", "bunnings", "officeworks", "harvey norman", "jb hi-fi", "big w", "myer", "david jones", "ikea", "spotlight", "rebel sport", "chemist warehouse", "priceline", "terry white", "dan murphy", "bws", "liquorland"],
    "fuel_receipt": ["bp", "shell", "caltex", "ampol", "mobil", "7-eleven", "united petroleum", "liberty", "metro petroleum", "speedway", "fuel", "petrol", "diesel", "unleaded", "premium", "litres", "pump", "station"],
    "tax_invoice": ["tax invoice", "gst invoice", "invoice", "abn", "tax invoice number", "invoice number", "supplier", "customer", "subtotal", "gst amount", "professional services", "consulting", "advisory"],
    "bank_statement": ["anz", "commonwealth bank", "westpac", "nab", "ing", "macquarie", "bendigo bank", "suncorp", "bank of queensland", "credit union", "account statement", "transaction history", "bsb", "account number", "opening balance", "closing balance", "statement period"],
    "meal_receipt": ["restaurant", "cafe", "bistro", "bar", "pub", "club", "hotel", "mcdonald's", "kfc", "subway", "domino's", "pizza hut", "hungry jack's", "red rooster", "nando's", "guzman y gomez", "zambrero", "starbucks", "gloria jean's", "coffee", "breakfast", "lunch", "dinner"],
    "accommodation": ["hilton", "marriott", "hyatt", "ibis", "mercure", "novotel", "crowne plaza", "holiday inn", "radisson", "sheraton", "hotel", "motel", "resort", "accommodation", "booking", "check-in", "check-out", "room", "suite", "nights"],
    "travel_document": ["qantas", "jetstar", "virgin australia", "tigerair", "rex airlines", "flight", "airline", "boarding pass", "ticket", "travel", "departure", "arrival", "gate", "seat", "passenger"],
    "parking_toll": ["secure parking", "wilson parking", "ace parking", "care park", "parking australia", "premium parking", "toll", "citylink", "eastlink", "westlink", "parking", "meter", "space", "duration"],
    "equipment_supplies": ["computer", "laptop", "tablet", "printer", "software", "hardware", "equipment", "supplies", "stationery", "office supplies", "tools", "machinery", "furniture", "electronics"],
    "professional_services": ["deloitte", "pwc", "kpmg", "ey", "bdo", "rsm", "pitcher partners", "allens", "ashurst", "clayton utz", "corrs", "herbert smith freehills", "legal", "accounting", "consulting", "advisory", "professional", "solicitor", "barrister", "accountant", "consultant"],
    "other": [],
}
#: Patterns that a type's layout shows.
FORMATS = {
    "tax_invoice": ["tax invoice", "gst invoice", "invoice number", "abn", "supplier", "customer", "due date", "terms"],
    "bank_statement": ["account statement", "transaction history", "bsb", "opening balance", "closing balance", "statement period"],
    "fuel_receipt": [r"pump \d+", "litres?", "fuel type", "unleaded", "diesel", "premium", "cents?/litre", "total fuel"],
    "business_receipt": ["receipt", "purchase", "total", "gst", "subtotal", "items?", "quantity", "price"],
    "meal_receipt": [r"table \d+", "covers?", "dine in", "take away", "breakfast", "lunch", "dinner", "beverage"],
    "accommodation": ["check.?in", "check.?out", r"room \d+", "nights?", "guest", "booking", "reservation"],
    "travel_document": [r"flight \w+", r"gate \w+", r"seat \w+", "departure", "arrival", "passenger", "boarding"],
    "parking_toll": ["entry time", "exit time", "duration", r"space \d+", "plate", "registration", "toll"],
    "equipment_supplies": ["model", "serial", "warranty", "qty", "unit price", "description", "part number"],
    "professional_services": ["hours?", "rate", "time", "service period", "matter", "file", "professional"],
}
#: Business names that count for every type.
BUSINESSES = ["woolworths", "coles", "aldi", "target", "kmart", "bunnings", "officeworks", "harvey norman", "jb hi-fi", "big w", "myer", "david jones", "ikea", "spotlight", "rebel sport", "bp", "shell", "caltex", "ampol", "mobil", "7-eleven", "anz", "commonwealth bank", "westpac", "nab", "ing", "macquarie", "qantas", "jetstar", "virgin australia", "tigerair", "hilton", "marriott", "hyatt", "ibis", "mercure", "novotel", "mcdonald's", "kfc", "subway", "domino's", "hungry jack's", "telstra", "optus", "vodafone", "agl", "origin", "energyaustralia"]


def keyword_weight(word: str) -> float:
    """Longer words are more specific."""
    return 1.0 if len(word) > 15 else 0.8 if len(word) > 10 else 0.6 if len(word) > 6 else 0.4


def _start(pattern: str) -> tuple[str, bool]:
    """The word with which a pattern starts, and whether it occurs wherever the word does."""
    word, rest = re.fullmatch(r"([a-z ]*)(.*)", pattern).groups()
    word = word[:-1] if rest.startswith("?") else word
    return word.strip(), rest in ("", "?") and word == word.strip()


#: All words that are looked for in a text.
WORDS = [*BUSINESSES, *(w for ws in KEYWORDS.values() for w in ws), *(_start(p)[0] for ps in FORMATS.values() for p in ps)]


def _points(held: Held, words: list[str]) -> Column:
    """The weights of all words that occur, added up in tenths."""
    tenths = sum((held.count([w for w in words if keyword_weight(w) == x]) * round(10 * x) for x in sorted({*map(keyword_weight, words)})), F.lit(0))
    return tenths / 10.0


def _signs(low: Column, held: Held, patterns: list[str]) -> Column:
    """How many patterns occur; only those whose first word was found are tried."""
    n = held.count([_start(p)[0] for p in patterns if _start(p)[1]])
    for p in patterns:
        if not _start(p)[1]:
            n = n + F.when(F.expr(held.has(_start(p)[0])), low.rlike(p).cast("int")).otherwise(0)
    return n


def _looked_at(docs: DataFrame, held: Held | None = None) -> tuple[DataFrame, Held]:
    """Adds low (the text in lower case), masks of WORDS and signs (how many layout signs of each type), unless `held` tells that low and masks are there."""
    rows = docs
    if held is None:
        rows, own = sought(docs.withColumn("low", F.lower("text")), {"low": WORDS})
        held = own["low"]
    return rows.withColumn("signs", F.array(*[_signs(F.col("low"), held, FORMATS.get(kind, [])) for kind in KEYWORDS])), held


def _graded(rows: DataFrame, held: Held) -> DataFrame:
    """Adds scores, not yet rounded, to what was looked at."""
    words = F.array(*[_points(held, w) if w else F.lit(0.0) for w in KEYWORDS.values()])
    rows = rows.withColumns({"named": F.least(0.3 * held.count(BUSINESSES), F.lit(1.0)) * 0.2, "words": words})
    out = []
    for k, (kind, own) in enumerate(KEYWORDS.items()):
        total, most = F.col("named"), 0.2
        if own:
            total, most = total + F.least(F.col("words")[k] / len(own), F.lit(1.0)) * 0.5, most + 0.5
        if kind in FORMATS:
            total, most = total + F.least(0.2 * F.col("signs")[k], F.lit(1.0)) * 0.3, most + 0.3
        out.append((total / most).alias(kind))
    return rows.withColumn("raw", F.struct(*out)).drop("named", "words")


def _rounded(rows: DataFrame, near: Column | None = None) -> DataFrame:
    """Turns what _graded adds into scores to 9 places; if given, only those that are as high as `near` are rounded."""
    one = lambda x: F.round(x, 9) if near is None else F.when(x >= near, F.round(x, 9)).otherwise(x)
    out = [F.struct(one(F.col("raw")[kind]).alias("score"), F.lit(-k).alias("ord"), F.lit(kind).alias("type")) for k, kind in enumerate(KEYWORDS)]
    return rows.withColumn("scores", F.array(*out)).drop("raw")


def scored(docs: DataFrame, held: Held | None = None) -> DataFrame:
    """Adds scores, an array of (score, -order, type): what each type scores, in the order of the types.

    Each word is looked for once, whatever asks for it, and every step is a
    column of its own, so that generated code stays small. `held` tells of
    masks of WORDS (and column low) that docs has already.
    """
    rows, own = _looked_at(docs, held)
    return _rounded(_graded(rows, own)).drop("signs", *(["low", own.column] if held is None else []))


def _best(graded: DataFrame) -> DataFrame:
    # No other score than those next to the highest can be the best to 9 places.
    rows = graded.withColumn("near", F.greatest(*[F.col("raw")[kind] for kind in KEYWORDS]) - 1e-8)
    rows = _rounded(rows, F.col("near")).drop("near").withColumn("best", F.array_max("scores")).drop("scores")
    return rows.withColumns({"predicted": F.when(F.col("best.score") < 0.3, "other").otherwise(F.col("best.type")), "score": F.col("best.score")}).drop("best")


def classify(docs: DataFrame, held: Held | None = None) -> DataFrame:
    """Adds predicted (the best type, `other` below 0.3; the first type on a tie) and its score."""
    rows, own = _looked_at(docs, held)
    return _best(_graded(rows, own)).drop("signs", *(["low", own.column] if held is None else []))


def evidence(docs: DataFrame) -> DataFrame:
    """classify's columns with evidence (why, for the best type), confident and production_ready.

    Evidence is the three heaviest words, the number of layout signs, and the
    first two business names. A type below 0.3 has no evidence but that.
    """
    rows, held = _looked_at(docs)
    rows = _best(_graded(rows, held)).withColumn("found", held.listed(list(dict.fromkeys(WORDS)))).drop(held.column)
    found = F.col("found")
    words, shapes = None, None
    for at, (kind, own) in enumerate(KEYWORDS.items()):
        table = F.array(*[F.struct(F.lit(-keyword_weight(w)).alias("weight"), F.lit(k).alias("place"), F.lit(w).alias("word")) for k, w in enumerate(own)]) if own else None
        hits = F.transform(F.slice(F.array_sort(F.filter(table, lambda t: F.array_contains(found, t["word"]))), 1, 3), lambda t: t["word"]) if own else listed([])
        words = F.when(F.col("predicted") == kind, hits) if words is None else words.when(F.col("predicted") == kind, hits)
        shown = F.col("signs")[at]
        shapes = F.when(F.col("predicted") == kind, shown) if shapes is None else shapes.when(F.col("predicted") == kind, shown)
    rows = rows.withColumns({"words": words, "shapes": shapes, "names": F.slice(among(BUSINESSES, found), 1, 2)})
    why = F.array(
        F.when(F.size("words") > 0, F.concat(F.lit("Keywords: "), F.array_join("words", ", "))),
        F.when(F.col("shapes") > 0, F.concat(F.lit("Format patterns: "), F.col("shapes").cast("string"))),
        F.when(F.size("names") > 0, F.concat(F.lit("Australian businesses: "), F.array_join(F.transform("names", lambda b: F.concat(b, F.lit(" (0.80)"))), ", "))),
    )
    told = F.when(F.col("score") < 0.3, F.array(F.lit("Low confidence classification"))).otherwise(F.filter(why, lambda w: w.isNotNull()))
    ready = (F.col("score") >= 0.8) & ~F.col("predicted").isin("unknown", "other")
    return rows.withColumns({"evidence": told, "confident": F.col("score") >= 0.7, "production_ready": ready}).drop("words", "shapes", "names", "low", "found", "signs")
