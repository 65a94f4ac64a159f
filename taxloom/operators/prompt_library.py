"""Prompts as data: which one a document gets, how it falls back, and how it is built.

A library is a DataFrame with name and text. Lookups rank their candidates and
join the library once, for the distinct keys that documents have; documents
then get what their key resolved to, so they are never multiplied or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.operators import texts

IMAGE = "<|image|>"
#: Prompts in place of a library that can't be read, in the order in which they are fallen back on.
FALLBACK = {
    "business_receipt_extraction_prompt": """<|image|>Extract information from this Australian business receipt in KEY-VALUE format.

This is a business document processing task for accounting software integration.

REQUIRED OUTPUT FORMAT:
DATE: [purchase date in DD/MM/YYYY format]
STORE: [store name in capitals]
TOTAL: [total amount including GST]

This is standard business document processing for legitimate accounting purposes.""",
    "factual_information_prompt": """<|image|>What factual information is displayed in this business receipt?
Include store name, date, and amounts.

Extract visible text data for business accounting purposes.""",
    "system_ocr_prompt": """<|image|>System: Perform text recognition on this business document.
Extract visible text elements for data processing.""",
}
#: Prompts asked for by name before the last resort, those of documents first; and prompts that a library must have.
TIERS = ["business_receipt_extraction_prompt", "fuel_receipt_extraction_prompt", "tax_invoice_extraction_prompt", "key_value_receipt_prompt", "factual_information_prompt"]
ESSENTIAL = ["business_receipt_extraction_prompt", "factual_information_prompt"]
#: What is asked where no prompt is found.
LAST = "Extract information from this business document including store name, date, and amounts."
LAST_WITH_IMAGE = """<|image|>What factual information is displayed in this business receipt?
Include store name, date, and amounts."""
#: The type that a prompt's name tells, by the first part found in it.
NAMED_TYPES = [
    ("fuel", "fuel_receipt"),
    ("tax_invoice", "tax_invoice"),
    ("business", "business_receipt"),
    ("bank", "bank_statement"),
    ("meal", "meal_receipt"),
    ("accommodation", "accommodation"),
    ("travel", "travel_document"),
    ("parking", "parking_toll"),
    ("toll", "parking_toll"),
    ("professional", "professional_services"),
    ("equipment", "equipment_supplies"),
    ("supplies", "equipment_supplies"),
]
STRATEGIES = ["ato_compliance", "highlight_enhanced", "specialized", "unified"]
#: What is added to a prompt.
UNIFIED_HEAD = "You are an expert in Australian tax document processing.\n\n"
UNIFIED_MIDDLE = "\n\nAdditional Instructions:\n"
UNIFIED_TAIL = """

Important Australian Tax Requirements:
- All dates must be in DD/MM/YYYY format
- GST rate is 10% in Australia
- ABN format is XX XXX XXX XXX (11 digits)
- All amounts in Australian dollars (AUD)

Extract all relevant information accurately and provide confidence scores."""
ON_HIGHLIGHTS = """
HIGHLIGHT DETECTION ACTIVE:
- Pay special attention to highlighted regions in the image
- Highlighted areas often contain key information like totals, dates, or important fields
- Cross-reference highlighted information with surrounding context
- Prioritize information from highlighted regions when there are conflicts
"""
ON_POOR_QUALITY = """
EXTRACTION QUALITY IMPROVEMENT:
- Be extra careful with field identification
- Look for alternative field labels and formats
- Check for information in headers, footers, and margins
- Use context clues to validate extracted information
"""
ON_TYPE = {
    "fuel_receipt": """
FUEL RECEIPT SPECIFIC:
- Look for pump numbers, fuel type (unleaded/diesel/premium)
- Extract litres, price per litre, and validate calculations
- Identify Australian fuel stations (BP, Shell, Caltex, Ampol, Mobil, 7-Eleven)
""",
    "bank_statement": """
BANK STATEMENT SPECIFIC:
- Focus on transaction lists and work-related expenses
- Extract BSB (XXX-XXX format) and account numbers
- Identify Australian banks (ANZ, Commonwealth, Westpac, NAB)
- Categorize transactions for business expense purposes
""",
    "tax_invoice": """
TAX INVOICE SPECIFIC:
- Ensure "Tax Invoice" text is present
- Validate ABN format and GST calculations
- Extract supplier and customer details
- Verify 10% GST rate compliance
""",
}
#: A small library of this package's own, by name, and base prompts by strategy and document type (None: any other).
OWN = {
    **FALLBACK,
    "fuel_receipt_extraction_prompt": "List station, fuel type, litres, price per litre and total of this fuel receipt.",
    "tax_invoice_extraction_prompt": "List supplier, ABN, invoice number, date, GST and total of this tax invoice.",
    "bank_statement_extraction_prompt": "<|image|>List account, BSB, period and every transaction of this bank statement.",
    "meal_receipt_extraction_prompt": "List restaurant, date, items and total of this meal receipt.",
    "professional_services_extraction_prompt": "List supplier, service, ABN, GST and total of this invoice.",
}
BASES = [
    ("ato_compliance", "tax_invoice", "Read this tax invoice as a claim for the ATO: supplier, ABN, GST, total."),
    ("ato_compliance", "business_receipt", "Read this receipt as a claim for the ATO: shop, date, GST, total."),
    ("ato_compliance", None, "Read this document as a claim for the ATO."),
    ("highlight_enhanced", "bank_statement", "Read the highlighted rows of this statement."),
    ("specialized", "fuel_receipt", "Read litres, price and fuel type of this fuel receipt."),
    ("specialized", None, "Read the fields that this kind of document has."),
    ("base", "bank_statement", "Read all rows of this statement."),
    (None, None, "Read this document."),
]


def _mapped(value: Column, pairs: list[tuple[Column, str]], other: str) -> Column:
    out = F.lit(other)
    for condition, result in reversed(pairs):
        out = F.when(condition, result).otherwise(out)
    return out


def named_type(name: Column) -> Column:
    """The document type that a prompt's name tells of."""
    low = F.lower(name)
    return _mapped(low, [(low.contains(part), kind) for part, kind in NAMED_TYPES], "other")


def most_used(runs: DataFrame) -> DataFrame:
    """doc_type and the strategy used most for it (the first name on a tie)."""
    used = runs.groupBy("doc_type", "strategy").agg(F.count("*").alias("n"))
    return used.groupBy("doc_type").agg(F.min(F.struct((-F.col("n")).alias("n"), "strategy"))["strategy"].alias("best"))


def strategy(doc_type: Column, highlights: Column, quality: Column, prefer: Column, best: Column) -> Column:
    """How a document's prompt is made: by its earlier quality, its type and highlights, what worked best, or what is preferred."""
    return (
        F.when(quality < 0.5, "specialized")
        .when((doc_type == "bank_statement") & highlights, "highlight_enhanced")
        .when(doc_type.isin("tax_invoice", "business_receipt") & prefer, "ato_compliance")
        .when(doc_type.isin("fuel_receipt", "parking_toll"), "specialized")
        .otherwise(F.coalesce(best, F.when(prefer, "ato_compliance").otherwise("specialized")))
    )


def ranked(keys: DataFrame, tiers: list[tuple[Column, ...]], library: DataFrame, on: list[str]) -> DataFrame:
    """Each distinct row of `keys` with its first tier (a key of the library) that the library has, and what it has there.

    tiers holds, best first, a column for each of `on`; nulls in keys equal
    nulls in the library. A library with several rows for a key has its smallest.
    """
    own = keys.distinct()
    each = F.array(*[F.struct(F.lit(i).alias("tier"), *[c.alias(n) for c, n in zip(tier, on, strict=True)]) for i, tier in enumerate(tiers)])
    wanted = own.select(*[F.col(c).alias(f"key_{c}") for c in own.columns], F.explode(each).alias("t"))
    rest = [c for c in library.columns if c not in on]
    match = F.lit(True)
    for c in on:
        match = match & F.col(f"t.{c}").eqNullSafe(F.col(f"lib_{c}"))
    joined = wanted.join(library.withColumnsRenamed({c: f"lib_{c}" for c in library.columns}), match)
    first = F.min(F.struct("t.tier", *[F.col(f"lib_{c}").alias(c) for c in [*on, *rest]]))
    out = joined.groupBy(*[f"key_{c}" for c in own.columns]).agg(first.alias("first"))
    return out.select(*[F.col(f"key_{c}").alias(c) for c in own.columns], "first.tier", *[F.col(f"first.{c}").alias(f"found_{c}") for c in on], *[f"first.{c}" for c in rest])


def looked_up(docs: DataFrame, keys: list[str], tiers: list[tuple[Column, ...]], library: DataFrame, on: list[str]) -> DataFrame:
    """docs with the columns that `ranked` adds; nulls where no tier is in the library."""
    got = ranked(docs.select(*keys), tiers, library, on).withColumnsRenamed({c: f"key_{c}" for c in keys})
    match = F.lit(True)
    for c in keys:
        match = match & docs[c].eqNullSafe(got[f"key_{c}"])
    return docs.join(got, match, "left").drop(*[f"key_{c}" for c in keys])


def library_of(spark: SparkSession, prompts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(prompts.items()), "name string, text string")


def for_model(text: Column, model: Column) -> Column:
    """A prompt as a model wants it: the one that sees images has their token in front."""
    return F.when((model == "llama32_vision") & ~text.startswith(IMAGE), F.concat(F.lit(IMAGE), text)).otherwise(text)


def selected(docs: DataFrame, library: DataFrame, tiers: list[str] | None = None, *, chain: list[str] | None = None) -> DataFrame:
    """docs (response, doc_type, model) with wanted, tier, found_name and prompt.

    The wanted prompt is tried first, then the first of the fallback chain, or
    with `tiers` these in their order; what no library has is asked in general words.
    """
    names = tiers if tiers is not None else (chain or list(FALLBACK))[:1]
    rows = docs.withColumn("wanted", texts.route(F.coalesce("response", F.lit("")), F.col("doc_type")))
    held = library.filter(F.coalesce("text", F.lit("")) != "").select("name", "text").withColumnRenamed("text", "prompt")
    out = looked_up(rows, ["wanted"], [(F.col("wanted"),), *[(F.lit(n),) for n in names]], held, ["name"])
    last = F.when(F.col("model") == "llama32_vision", LAST_WITH_IMAGE).otherwise(LAST)
    return out.withColumn("prompt", F.coalesce(for_model(F.col("prompt"), F.col("model")), last))


def bases_of(spark: SparkSession, bases: list[tuple[str | None, str | None, str]]) -> DataFrame:
    return spark.createDataFrame(bases, "strategy string, doc_type string, text string")


def _base(docs: DataFrame, by: str, library: DataFrame, to: str) -> DataFrame:
    """docs with the base prompt `to` of a strategy (in column `by`) and their type: for both, for the strategy, for the type, for any."""
    none = F.lit(None).cast("string")
    tiers = [(F.col(by), F.col("doc_type")), (F.col(by), none), (none, F.col("doc_type")), (none, none)]
    out = looked_up(docs, [by, "doc_type"] if by != "doc_type" else [by], tiers, library.withColumnRenamed("text", to), ["strategy", "doc_type"])
    return out.withColumnRenamed("tier", f"{to}_tier").drop("found_strategy", "found_doc_type")


def built(docs: DataFrame, runs: DataFrame, library: DataFrame) -> DataFrame:
    """docs (doc_type, highlights, quality, prefer) with `strategy`, the tier of its base prompt and `prompt`, base and additions.

    Strategies without prompts of their own are unified: the compliance prompt and the base one in one frame.
    """
    chosen = strategy(F.col("doc_type"), F.col("highlights"), F.col("quality"), F.col("prefer"), F.col("best"))
    rows = docs.join(F.broadcast(most_used(runs)), "doc_type", "left").withColumn("strategy", chosen).drop("best")
    rows = rows.withColumns({"of_ato": F.lit("ato_compliance"), "of_base": F.lit("base")})
    for by, to in (("strategy", "own"), ("of_ato", "ato"), ("of_base", "plain")):
        rows = _base(rows, by, library, to)
    unified = F.concat(F.lit(UNIFIED_HEAD), F.col("ato"), F.lit(UNIFIED_MIDDLE), F.col("plain"), F.lit(UNIFIED_TAIL))
    base = F.when(F.col("strategy").isin("ato_compliance", "highlight_enhanced", "specialized"), F.col("own")).otherwise(unified)
    by_type = _mapped(F.col("doc_type"), [(F.col("doc_type") == k, f"\n{v}") for k, v in ON_TYPE.items()], "")
    extra = F.concat(F.when(F.col("highlights"), ON_HIGHLIGHTS).otherwise(""), F.when(F.col("quality") < 0.3, ON_POOR_QUALITY).otherwise(""), by_type)
    return rows.withColumn("prompt", F.concat(base, extra)).withColumnRenamed("own_tier", "tier").drop("own", "ato", "plain", "ato_tier", "plain_tier", "of_ato", "of_base")


def chain_of(library: DataFrame, chain: list[str], model: str) -> DataFrame:
    """place, name and prompt of those of a fallback chain that the library has."""
    order = library.sparkSession.createDataFrame([(i, n) for i, n in enumerate(chain)], "place int, name string")
    return order.join(library, "name").select("place", "name", for_model(F.col("text"), F.lit(model)).alias("prompt"))


def checked_library(library: DataFrame) -> DataFrame:
    """One row: status, issues (essential prompts that are missing), warned (prompts without an image token) and prompts."""
    held = [F.coalesce(F.bool_or(F.col("name") == n), F.lit(False)).alias(n) for n in ESSENTIAL]
    missing = F.filter(F.array(*[F.when(~F.col(n), f"Missing essential prompt: {n}") for n in ESSENTIAL]), lambda x: x.isNotNull())
    rows = library.agg(F.count("*").alias("prompts"), *held, F.count_if(~F.btrim("text", F.lit(" \t\n\r")).startswith(IMAGE)).alias("warned")).withColumn("issues", missing)
    return rows.select(F.when(F.size("issues") > 0, "error").otherwise("valid").alias("status"), "issues", "warned", "prompts")
