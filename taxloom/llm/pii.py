"""Personal data by patterns, and terms that give it away by corpus statistics.

Base spans (e-mail, IP, card and phone numbers) come from regular expressions
whose possessive quantifiers keep them linear. What is protected is an entity
or a class of them: the value itself, an e-mail's domain and name, the network
of an IP, the issuer of a card, the area of a phone number. All terms of a
document that holds one are candidates. An entity's information is
IC(e) = -log2 p(e), p(e) being the share of documents that hold it, and a term tells
PMI(t; e) = log2(p(e | t) / p(e)) of it; what it leaves to be told are

    IC(e) - PMI(t; e) = -log2 p(e | t)  bits,

which does not depend on the corpus' size. p(e | t) is taken from the other
documents that hold the term (leaving one out, with PRIOR documents of the
corpus' average added), so a term of one document tells nothing, however rare.
Terms that leave `generalise` bits or fewer, and tell at least GAIN, become a
placeholder wherever they stand in documents with that entity; those that leave
`remove` bits or fewer go. Copies are documents like others: a term that stands
in them alone gives their entity away. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxloom.llm.shared import Scratch, by_bitmap, join_counted, keep

KINDS = ["email", "ip", "card", "phone"]
#: Bits about an entity that a term may leave at most to be generalised, and to be removed; bits that it tells at least.
GENERALISE, REMOVE, GAIN = 1.25, 0.35, 1.0
#: Documents of the corpus' average that are added to those that hold a term.
PRIOR = 0.25
#: Copies of a text from which its terms may reach it by broadcast.
MANY = 64
#: Letters in a term at least.
TERM = r"\p{L}{4,}+"
#: Items that are handled by a growing array at a time.
STEP = 128

#: A match starts where the last one ended or where the run of its first class starts: so a run is tried once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.ascii(F.substring(d, i, F.lit(1))) - 48
        x = F.when((n - i) % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return acc + x

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    n = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _blocks(items: Column) -> Column:
    """The items in arrays of STEP, in order."""
    n = F.floor((F.size(items) + (STEP - 1)) / STEP).cast("int")
    return F.when(F.size(items) == 0, F.slice(F.array(items), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(items, i * STEP + 1, F.lit(STEP))))


def _before(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """What all earlier values combine to, for each of an array of ints.

    An array that grows by one is copied each time, so it grows within blocks
    of STEP values; blocks start from what the blocks before them come to.
    """
    none = F.expr("cast(array() as array<int>)")

    def scan(items: Column, start: Column) -> Column:
        add = lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, F.struct(start.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    def all_of(blocks: Column) -> Column:
        starts = scan(F.transform(blocks, lambda b: F.aggregate(b, F.lit(zero), combine)), F.lit(zero))
        return F.flatten(F.zip_with(blocks, starts, scan))

    return _let(_blocks(values), all_of)


def _placed(text: Column, pattern: str, kind: str) -> Column:
    """All matches with code-point offsets: what splitting leaves between them tells where they stand."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("value"))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))

    def of(both: Column) -> Column:
        ends = F.transform(both, lambda x: F.length(x["gap"]) + size(x["value"]))
        at = _before(ends, lambda a, b: a + b, 0)
        one = lambda x, a: F.struct(F.lit(kind).alias("kind"), (a + F.length(x["gap"])).alias("start"), (a + F.length(x["gap"]) + size(x["value"])).alias("end"), x["value"].alias("value"))
        return F.filter(F.zip_with(both, at, one), lambda s: s["value"].isNotNull())

    return _let(both, of)


def base_spans(text: Column) -> Column:
    """The base spans of a text, by kind as listed and then by start."""
    hint = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": text.rlike(r"\+[0-9]")}
    none = F.expr(f"cast(array() as {_SPAN})")

    def of(kind: str) -> Column:
        return F.when(hint[kind], F.filter(_placed(text, PATTERNS[kind], kind), lambda s: _passes(kind, s["value"]))).otherwise(none)

    return F.concat(*map(of, KINDS))


def count_of(kind: str, base: Column) -> Column:
    return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (null is empty) and the key of the text."""
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return own.withColumn("key", F.xxhash64("text"))


def frequencies(texts: DataFrame) -> DataFrame:
    """term (hash) and df over `text`: how many rows hold each term, lower-cased."""
    words = F.filter(F.split(F.lower("text"), r"\P{L}++"), lambda w: F.length(w) >= 4)
    each = texts.select(F.explode(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("df"))


def _classes(base: Column) -> Column:
    """What base spans tell of: hashes of their values and of the classes that these belong to."""

    def of(s: Column) -> Column:
        kind, value, digits = s["kind"], F.lower(s["value"]), _digits(s["value"])
        named = lambda level, v: F.xxhash64(kind, F.lit(level), v)
        name = F.regexp_replace(F.substring_index(value, "@", 1), "[^a-z]", "")
        pool = (
            F.when(kind == "email", named("domain", F.substring_index(value, "@", -1)))
            .when(kind == "ip", named("network", F.substring_index(value, ".", 2)))
            .when(kind == "card", named("issuer", F.substring(digits, 1, 6)))
            .otherwise(named("area", F.substring(digits, 1, 4)))
        )
        return F.array(named("value", value), pool, F.when((kind == "email") & (F.length(name) >= 3), named("name", name)))

    return F.filter(F.array_distinct(F.flatten(F.transform(base, of))), lambda c: c.isNotNull())


def _left(df_te: Column, df_t: Column, df_e: Column, total: float, prior: float) -> Column:
    """Bits that a term leaves about an entity, from the other documents that hold the term."""
    given = (df_te - 1 + prior * df_e / total) / (df_t - 1 + prior)
    return -F.log2(given)


def disclosures(held: DataFrame, texts: DataFrame, total: float, scratch: Scratch, generalise: float, prior: float = PRIOR, gain: float = GAIN) -> tuple[DataFrame, DataFrame]:
    """(pairs, strong): key, entity, term of texts, and entity, term, df, df_e, df_te and `left` bits of those that reveal.

    held has key, text, base and n (documents of that text) of each text with
    base spans, `texts` every document, total their number. Only entities of two
    documents or more can be revealed, and only by terms of two or more, and not
    by terms of too many others.
    """
    each = scratch.cut(held.select("key", F.col("n").alias("copies"), F.explode(_classes(F.col("base"))).alias("entity")))
    shared = scratch.cut(each.groupBy("entity").agg(F.count("*").alias("n"), F.sum("copies").alias("df_e")).filter("df_e > 1"))
    entities = scratch.cut(join_counted(each, shared, "entity").drop("n"))
    # A term in more documents than this leaves too much, even if all of the entity's hold it.
    most = 1 - prior + (F.col("df_e") - 1 + prior * F.col("df_e") / total) * 2.0**generalise + 1e-6
    reach = entities.groupBy("key").agg(F.max(most).alias("reach"))
    widest = reach.agg(F.max("reach")).first()[0]
    few = frequencies(texts).filter((F.col("df") > 1) & (F.col("df") <= F.lit(widest).cast("double")))
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda w: F.xxhash64(F.lower(w))))
    terms = held.select("key", "text").join(reach, "key").select("key", "reach", F.explode(words).alias("term")).join(few, "term").filter("df <= reach")
    pairs = scratch.cut(terms.select("key", "term", "df").join(entities, "key").filter(F.col("df") <= most))
    counted = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("df_te"), F.first("df_e").alias("df_e"), F.first("df").alias("df")).filter("df_te > 1")
    bits = _left(F.col("df_te"), F.greatest("df", "df_te"), F.col("df_e"), total, prior)
    strong = counted.withColumn("left", bits).filter((F.col("left") <= generalise) & (-F.log2(F.col("df_e") / total) - F.col("left") >= gain))
    return pairs, scratch.cut(strong)


def revealing(held: DataFrame, texts: DataFrame, total: float, scratch: Scratch, generalise: float, remove: float, prior: float = PRIOR) -> DataFrame:
    """key, n (copies) and `terms` (spans with what to do) of texts in which terms reveal an entity."""
    pairs, strong = disclosures(held, texts, total, scratch, generalise, prior)
    hits = pairs.select("key", "entity", "term").join(strong.select("entity", "term", "left"), ["entity", "term"]).groupBy("key", "term").agg(F.min("left").alias("left"))
    hits = scratch.cut(hits)
    # Where the terms stand: what lies between them, added up in order.
    own = held.join(hits.select("key").distinct(), "key", "left_semi")
    pieces = F.arrays_zip(F.split("text", TERM, -1).alias("gap"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("value"))
    each = own.select("key", F.posexplode(pieces).alias("k", "x")).filter(F.col("x.value").isNotNull())
    each = each.select("key", "k", F.length("x.gap").alias("gap"), F.length("x.value").alias("size"), F.xxhash64(F.lower("x.value")).alias("term"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("key").orderBy("k")).cast("int")
    placed = each.withColumn("end", end).join(hits, ["key", "term"])
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "end", F.when(F.col("left") <= remove, "remove").otherwise("generalise").alias("action"))
    rows = placed.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("terms")).join(held.select("key", "base", "n"), "key")
    return rows.select("key", "n", _apart(F.col("terms"), F.col("base")).alias("terms"))


def _apart(terms: Column, base: Column) -> Column:
    """The terms that overlap no base span: none before them reaches past their start, none after them starts before their end."""
    tagged = lambda spans, base: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), F.lit(None).cast("string").alias("action") if base else s["action"].alias("action")))

    def of(spans: Column) -> Column:
        reach = _before(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        most = (1 << 31) - 1
        follows = F.reverse(_before(F.reverse(F.transform(spans, lambda s: F.when(s["base"], s["start"]).otherwise(most))), lambda a, b: F.least(a, b), most))
        each = F.arrays_zip(spans.alias("span"), reach.alias("reach"), follows.alias("follows"))
        held = F.filter(each, lambda x: ~x["span"]["base"] & (x["reach"] <= x["span"]["start"]) & (x["follows"] >= x["span"]["end"]))
        return F.transform(held, lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), x["span"]["action"].alias("action")))

    return _let(F.array_sort(F.concat(tagged(base, True), tagged(terms, False))), of)


def _edited(text: Column, edits: Column) -> Column:
    """The text with spans (start, end, to) replaced, the edits sorted by start.

    Where edits overlap, the first puts its text and the next ones only take theirs away.
    """

    def pieces(edits: Column) -> Column:
        done = _before(F.transform(edits, lambda e: e["end"]), lambda a, b: F.greatest(a, b), 0)
        one = lambda e, a: F.struct(a.alias("at"), F.greatest(e["start"], a).alias("upto"), F.greatest(e["end"], a).alias("end"), F.when(e["start"] >= a, e["to"]).otherwise("").alias("to"))
        return F.filter(F.zip_with(edits, done, one), lambda p: p["end"] > p["at"])

    def block(b: Column) -> Column:
        # Code points are counted from a string's start, so each block of pieces cuts its own stretch first.
        first = F.element_at(b, 1)["at"]
        cut = F.substring(text, first + 1, F.element_at(b, -1)["upto"] - first)
        return _let(cut, lambda c: F.array_join(F.transform(b, lambda p: F.concat(F.substring(c, p["at"] - first + 1, p["upto"] - p["at"]), p["to"])), ""))

    def joined(all_pieces: Column) -> Column:
        rest = F.substring(text, F.element_at(all_pieces, -1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(_blocks(all_pieces), block), ""), rest)

    return _let(_let(edits, pieces), joined)


def spans(docs: DataFrame, *, generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, id, `base` and `terms` spans of every row of docs (offsets in code points, ends exclusive).

    A null text is empty; rows count as documents each, also repeated ones, and
    rows of one text have the same spans. `terms` never overlap `base`.
    """
    with Scratch(docs.sparkSession) as scratch:
        found, held, known = _found(docs, scratch, generalise, remove, prior, id_col, text_col)
        near, far = by_bitmap(found.select("key", "id", "base"), known, "key")
        near = join_counted(near, known, "key", "left", MANY)
        none = F.expr("cast(array() as array<struct<start:int,end:int,action:string>>)")
        both = near.select("key", "id", "base", F.coalesce("terms", none).alias("terms")).unionByName(far.select("key", "id", "base", none.alias("terms")))
        return keep(both)


def _found(docs: DataFrame, scratch: Scratch, generalise: float, remove: float, prior: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: key, id and base of all rows; key, base, text and n of the texts with base spans; key, n and terms of those with terms."""
    own = _keyed(docs, id_col, text_col)
    based = own.select("key", "id", "text", base_spans(F.col("text")).alias("base"))
    found = scratch.cut(based.select("key", "id", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")))
    held = scratch.cut(found.filter("size(base) > 0").groupBy("key").agg(F.first("base").alias("base"), F.first("text").alias("text"), F.count("*").alias("n")))
    known = revealing(held, own, float(max(1, found.count())), scratch, generalise, remove, prior)
    return found, held, scratch.cut(known)


def listed(base: Column, terms: Column | None = None) -> Column:
    """kind:start:end of all spans, comma-joined, base kinds first."""
    text = F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    if terms is not None:
        text = F.concat(text, F.transform(terms, lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])))
    return F.array_join(text, ",")


def sanitise(docs: DataFrame, *, generalise: float = GENERALISE, remove: float = REMOVE, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the same columns; in the text, base spans become [EMAIL] and so on, terms [TERM] or nothing.

    Texts without spans stay as they are; a null text stays null.
    """
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("to")))
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("to")))
    with Scratch(docs.sparkSession) as scratch:
        _, held, known = _found(docs, scratch, generalise, remove, prior, id_col, text_col)
        both = held.select("key", "n", "base").join(known.select("key", "terms"), "key", "left")
        both = both.withColumn("terms", F.coalesce("terms", F.expr("cast(array() as array<struct<start:int,end:int,action:string>>)")))
        edits = keep(both.select("key", "n", F.array_sort(F.concat(base, terms)).alias("edits")))
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    near, far = by_bitmap(keyed, edits, "key")
    joined = join_counted(near, edits, "key", "left", MANY).unionByName(far, allowMissingColumns=True)
    out = joined.withColumn("new", F.when(F.col("edits").isNull(), F.col("text")).otherwise(_edited(F.col("text"), F.col("edits"))))
    return out.select(*[F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
