"""Recognition of businesses in text against a registry, and lookups in it.

The registry is a parameter; the one that is built in is read from the
package's data files, which hold fixed values. What recognition needs of it
becomes a literal array in the plan that is walked for each row, so there is
no join and the generated code does not grow with the registry.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.functions.validators import digits
from taxloom.operators.words import MOST_SOUGHT, Held, listed, present, quoted, sought

#: What stands for an occurrence of a keyword (of two characters or more), and the pattern of one that is a word of its own.
_MARK = "\x01"
_WHOLE = r"(?<![\w\x01])\x01(?![\w\x01])"
#: Most businesses that `read` takes: a registry is part of the plan.
MOST = 20_000


@dataclass(frozen=True)
class Business:
    key: str
    name: str
    industry: str
    kind: str
    keywords: tuple[str, ...]
    states: tuple[str, ...] = ()
    abn: str = ""


def _data(name: str) -> list[dict]:
    return [json.loads(line) for line in files("taxloom.sources").joinpath("data", name).read_text().splitlines()]


@cache
def default() -> tuple[Business, ...]:
    """The built-in registry, in its order."""
    return tuple(Business(r["key"], r["name"], r["industry"], r["kind"], tuple(r["keywords"]), tuple(r["states"]), r["abn"]) for r in _data("businesses.jsonl"))


@cache
def industry_words() -> dict[str, list[str]]:
    return {r["industry"]: r["words"] for r in _data("industries.jsonl")}


@cache
def aliases() -> dict[str, list[str]]:
    return {r["key"]: r["aliases"] for r in _data("aliases.jsonl")}


#: Names under which some businesses are reported in place of their official ones.
SHORT = {
    "woolworths": "Woolworths",
    "coles": "Coles",
    "jb_hi_fi": "JB Hi-Fi",
    "harvey_norman": "Harvey Norman",
    "big_w": "Big W",
    "bunnings": "Bunnings Warehouse",
    "kmart": "Kmart",
    "target": "Target",
    "officeworks": "Officeworks",
    "chemist_warehouse": "Chemist Warehouse",
}
#: Types of documents that an industry issues; others issue OTHER_TYPES.
EXPECTED = {
    "retail_supermarket": ["business_receipt", "tax_invoice"],
    "retail_department": ["business_receipt", "tax_invoice"],
    "retail_hardware": ["business_receipt", "tax_invoice"],
    "retail_electronics": ["business_receipt", "tax_invoice"],
    "fuel_retail": ["fuel_receipt", "business_receipt"],
    "banking": ["bank_statement"],
    "airline": ["travel_document", "tax_invoice"],
    "accommodation": ["accommodation", "tax_invoice"],
    "food_fast": ["meal_receipt", "business_receipt"],
    "food_cafe": ["meal_receipt", "business_receipt"],
}
OTHER_TYPES = ["business_receipt", "tax_invoice"]
#: What the documents of an industry should show, and how what is missing is called.
NEEDED = {
    "fuel_retail": ("fuel-specific", ["litres", "fuel_type", "price_per_litre"]),
    "banking": ("banking", ["account_number", "bsb"]),
    "airline": ("travel", ["passenger_name", "flight_number"]),
}
#: Plain names of industries; others keep their own.
SIMPLE = {
    "retail_supermarket": "supermarket",
    "retail_electronics": "electronics",
    "retail_furniture": "furniture_electronics",
    "fuel_retail": "fuel_station",
    "food_fast": "restaurant",
}


def read(spark: SparkSession, path: str) -> tuple[Business, ...]:
    """A registry of at most MOST businesses from JSON rows with the fields of Business."""
    rows = spark.read.json(path).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a registry in the plan has at most {MOST} businesses; join larger ones with by_abn and by_keyword")
    return tuple(Business(r.key, r.name, r.industry, r.kind, tuple(r.keywords), tuple(r.states), r.abn) for r in rows)


def _quoted(value: str | float) -> str:
    if not isinstance(value, str):
        return repr(value) + ("D" if isinstance(value, float) else "")
    return quoted(value)


def literal(rows: list[dict]) -> Column:
    """Rows as one constant array of structs."""
    return F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {_quoted(v)}" for k, v in r.items()) + ")" for r in rows) + ")")


def _nested(groups: list[list[dict]]) -> Column:
    """Groups of rows as a constant array of arrays of structs."""
    return F.expr("array(" + ", ".join("array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {_quoted(v)}" for k, v in r.items()) + ")" for r in rows) + ")" for rows in groups) + ")")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def base_confidence(word: str) -> float:
    """Longer keywords are more specific."""
    return 0.9 if len(word) > 15 else 0.85 if len(word) > 10 else 0.8 if len(word) > 6 else 0.75


def short_name(b: Business) -> str:
    return SHORT.get(b.key, b.name)


def keywords(registry: tuple[Business, ...] | None = None) -> list[str]:
    """All keywords, in lower case."""
    return list(dict.fromkeys(w.lower() for b in registry or default() for w in b.keywords))


def _score(low: Column, t: Column) -> Column:
    """Confidence and ord of a keyword (ord, word, base) that a text holds."""
    # One mark for each occurrence: what is left tells how many there are, and what stands beside a mark whether it is a word.
    word = t["word"]

    def of(marked: Column) -> Column:
        times = (F.length(low) - F.length(marked)) / (F.length(word) - 1)
        whole = F.when(marked.rlike(_WHOLE), 0.15).otherwise(0.0)
        sure = F.least(t["base"] + whole + F.when(times > 1, F.least(0.1 * (times - 1), F.lit(0.2))).otherwise(0.0), F.lit(1.0))
        return F.struct(F.round(sure, 9).alias("confidence"), t["ord"].alias("ord"))

    return _let(F.replace(low, word, F.lit(_MARK)), of)


def _names(known: tuple[Business, ...]) -> Callable[[Column], Column]:
    """What turns a confidence and ord into (confidence, ord, name, industry, abn)."""
    names = literal([{"name": short_name(b), "industry": b.industry, "abn": b.abn} for b in known])

    def named(m: Column) -> Column:
        b = F.element_at(names, 1 - m["ord"])
        return F.struct(m["confidence"].alias("confidence"), m["ord"].alias("ord"), b["name"].alias("name"), b["industry"].alias("industry"), b["abn"].alias("abn"))

    return named


def _places(known: tuple[Business, ...]) -> list[dict]:
    """The keywords of all businesses, in their order."""
    return [{"place": place, "ord": -k, "word": w.lower(), "base": base_confidence(w)} for place, (k, w) in enumerate((k, w) for k, b in enumerate(known) for w in b.keywords)]


def matches(text: Column, registry: tuple[Business, ...] | None = None) -> Column:
    """An array of (confidence, ord, name, industry, abn) of all businesses in the text, the surest first, on a tie the first registered.

    A business counts by its first keyword that occurs: by the keyword's
    length, whether it stands as a word, and how often it occurs. `ord` is the
    negative place in the registry.
    """
    known = registry or default()
    places: dict[str, list[dict]] = {}
    for t in _places(known):
        places.setdefault(t["word"], []).append(t)
    words, table = list(places), _nested(list(places.values()))

    def ranked(low: Column) -> Column:
        own = F.transform(F.array_distinct(present(low, words)), lambda w: F.get(table, (F.array_position(listed(words), w) - 1).cast("int")))
        hits = F.array_sort(F.flatten(own))
        first = _let(hits, lambda h: F.filter(h, lambda t, i: (i == 0) | (F.get(h, i - 1)["ord"] != t["ord"])))
        return F.sort_array(F.transform(first, lambda t: _score(low, t)), asc=False)

    return F.transform(_let(F.lower(text), ranked), _names(known))


def with_best(rows: DataFrame, low: str, out: str, registry: tuple[Business, ...] | None = None, held: Held | None = None) -> DataFrame:
    """rows with the surest business in the texts of column `low` (in lower case), as `best` finds it; null without any.

    `held` tells of masks of the registry's keywords that rows has already.
    Registries of more than MOST_SOUGHT keywords are looked for as `best` does.
    """
    known = registry or default()
    if held is None and len(keywords(known)) > MOST_SOUGHT:
        return rows.withColumn(out, best(F.col(low), registry))
    own = held
    if own is None:
        rows, found = sought(rows, {low: keywords(known)})
        own = found[low]
    table, firsts = _places(known), []
    for k in range(len(known)):
        words = [t for t in table if t["ord"] == -k]
        if words:
            firsts.append("CASE " + " ".join(f"WHEN {own.has(t['word'])} THEN '{t['place']}'" for t in words) + " END")
    rows = rows.withColumn(f"{out}_places", F.when(F.col(low).isNotNull(), F.expr("concat_ws(',', " + ", ".join(firsts) + ")")).otherwise(""))
    hits = F.transform(F.split(f"{out}_places", ","), lambda p: _score(F.col(low), F.get(literal(table), p.try_cast("int"))))
    rows = rows.withColumn(out, F.when(F.col(f"{out}_places") != "", F.array_max(hits)))
    shown = F.when(F.col(out).isNotNull(), _names(known)(F.col(out)))
    return rows.withColumn(out, shown).drop(f"{out}_places", *([] if held else [own.column]))


def best_of(text: Column, registry: tuple[Business, ...] | None = None) -> Column:
    """The surest business in an array of one, or an empty array: to be exploded, which computes it once."""
    return F.slice(matches(text, registry), 1, 1)


def best(text: Column, registry: tuple[Business, ...] | None = None) -> Column:
    return F.get(matches(text, registry), 0)


def by_name(name: Column, registry: tuple[Business, ...] | None = None) -> Column:
    """(ord, name, industry, abn) of the first business of which the whole name is a keyword, or null."""
    return _let(F.lower(name), lambda low: by_low_name(low, registry))


def by_low_name(low: Column, registry: tuple[Business, ...] | None = None) -> Column:
    """by_name of a name in lower case."""
    first: dict[str, int] = {}
    for k, b in enumerate(registry or default()):
        for w in b.keywords:
            first.setdefault(w.lower(), k)
    known = registry or default()
    table = literal([{"word": w, "ord": k, "name": known[k].name, "industry": known[k].industry, "abn": known[k].abn} for w, k in first.items()])
    return F.when(low.isin(*first), F.get(table, (F.array_position(listed(list(first)), low) - 1).cast("int")))


def by_contained(name: Column, registry: tuple[Business, ...] | None = None) -> Column:
    """category, confidence and industry of the first business of which a keyword is in the name; `unknown` and 0 without any."""
    words = literal([{"word": w.lower(), "industry": b.industry} for b in registry or default() for w in b.keywords])
    hit = _let(F.lower(F.coalesce(name, F.lit(""))), lambda low: F.get(F.filter(words, lambda t: low.contains(t["word"])), 0))
    return _let(hit, lambda h: F.struct(F.coalesce(category(h["industry"]), F.lit("unknown")).alias("category"), F.when(h.isNull(), 0.0).otherwise(0.9).alias("confidence"), F.coalesce(h["industry"], F.lit("")).alias("industry")))


def category(industry: Column) -> Column:
    """A plain name for an industry."""
    out = None
    for k, v in SIMPLE.items():
        out = F.when(industry == k, v) if out is None else out.when(industry == k, v)
    return out.otherwise(industry)


def expected_types(industry: Column) -> Column:
    listed = lambda names: F.array(*map(F.lit, names))
    out = None
    for k, v in EXPECTED.items():
        out = F.when(industry == k, listed(v)) if out is None else out.when(industry == k, listed(v))
    return out.otherwise(listed(OTHER_TYPES))


def missing(industry: Column, fields: Column) -> Column:
    """What is said of fields that an industry's documents should show and this one does not; null if none is missing."""
    out = None
    for k, (kind, names) in NEEDED.items():
        lacking = F.filter(F.array(*map(F.lit, names)), lambda n: F.coalesce(fields[n], F.lit("")) == "")
        said = F.when(F.size(lacking) > 0, F.concat(F.lit(f"Missing {kind} fields: "), F.array_join(lacking, ", ")))
        out = F.when(industry == k, said) if out is None else out.when(industry == k, said)
    return out


def context_issues(name: Column, doc_type: Column, fields: Column, registry: tuple[Business, ...] | None = None) -> Column:
    """What does not suit the named business, an array: an unknown name, an unusual type, another ABN, missing fields."""

    def of(b: Column) -> Column:
        known = F.filter(F.array(*_unsuited(b, doc_type, fields)), lambda x: x.isNotNull())
        return F.when(b.isNull(), F.array(F.concat(F.lit("Business '"), F.coalesce(name, F.lit("")), F.lit("' not found in Australian business registry")))).otherwise(known)

    return _let(by_name(F.coalesce(name, F.lit("")), registry), of)


def _unsuited(b: Column, doc_type: Column, fields: Column) -> list[Column]:
    """What does not suit a business (of by_name), null where something does."""
    unusual = F.when(~F.array_contains(expected_types(b["industry"]), doc_type), F.concat(F.lit("Document type '"), doc_type, F.lit("' unusual for "), b["industry"], F.lit(" business")))
    abn = F.coalesce(fields["abn"], F.lit(""))
    other = F.when((abn != "") & (b["abn"] != "") & (digits(abn) != digits(b["abn"])), F.concat(F.lit("ABN mismatch: extracted "), abn, F.lit(" vs registered "), b["abn"]))
    return [unusual, other, missing(b["industry"], fields)]


def context_count(b: Column, doc_type: Column, fields: Column) -> Column:
    """How many context_issues there are, of the business that by_name finds."""
    return F.when(b.isNull(), 1).otherwise(sum((c.isNotNull().cast("int") for c in _unsuited(b, doc_type, fields)), F.lit(0)))


def by_abn(rows: DataFrame, registry: DataFrame, abn_col: str = "abn") -> DataFrame:
    """rows with the registered name and industry of their ABN, digits only on both sides; the first one registered."""
    first = F.min(F.struct("ord", "name", "industry"))
    known = registry.select(digits(F.col("abn")).alias("abn_digits"), "ord", "name", "industry").filter("abn_digits <> ''").groupBy("abn_digits").agg(first.alias("first"))
    known = known.select("abn_digits", F.col("first.name").alias("registered_name"), F.col("first.industry").alias("registered_industry"))
    return rows.withColumn("abn_digits", digits(F.col(abn_col))).join(known, "abn_digits", "left").drop("abn_digits")


def as_frame(spark: SparkSession, registry: tuple[Business, ...] | None = None) -> DataFrame:
    rows = [(k, b.key, b.name, b.industry, b.kind, list(b.keywords), list(b.states), b.abn) for k, b in enumerate(registry or default())]
    return spark.createDataFrame(rows, "ord int, key string, name string, industry string, kind string, keywords array<string>, states array<string>, abn string")


def statistics(registry: DataFrame) -> DataFrame:
    """Businesses by industry, kind and state."""
    per = [registry.groupBy(F.lit(k).alias("by"), F.col(k).alias("value")).agg(F.count("*").alias("n")) for k in ("industry", "kind")]
    states = registry.select(F.explode("states").alias("state")).groupBy(F.lit("state").alias("by"), F.col("state").alias("value")).agg(F.count("*").alias("n"))
    return per[0].unionByName(per[1]).unionByName(states)
