"""Queries that read, classify and grade document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxloom.operators import batch_run as br
from taxloom.operators import classification as cl
from taxloom.operators import compliance as co
from taxloom.operators import document_types as dt
from taxloom.operators import extraction as ex
from taxloom.operators import handlers as hd
from taxloom.operators import registry as reg
from taxloom.operators import texts as tx
from taxloom.plans.result_queries import rounded
from taxloom.sources.views import view, with_views

#: The year against which dates are checked.
THIS_YEAR = 2024


def rules_extract(spark, d):
    return rounded(ex.long_form(ex.extract(view(spark, d, "receipts"))), "confidence")


def field_coverage(spark, d):
    rows = ex.long_form(ex.extract(view(spark, d, "receipts")))
    return rows.groupBy("doc_type", "field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("different"))


def classify(spark, d):
    return cl.classify(view(spark, d, "receipts")).select("doc_id", "predicted", F.round("score", 6).alias("score"))


def confusion(spark, d):
    return cl.classify(view(spark, d, "receipts")).groupBy("doc_type", "predicted").agg(F.count("*").alias("n"))


def compliance(spark, d):
    out = co.assess(br.with_fields(view(spark, d, "receipts")), THIS_YEAR)
    names = [*co.WEIGHTS, "compliance_score"]
    return rounded(out.select("doc_id", *names, "n_issues", "passed", F.array_join("advice", ",").alias("advice")), *names)


def recognition(spark, d):
    rows = reg.with_best(view(spark, d, "receipts").select("doc_id", F.lower("text").alias("low")), "low", "m").filter("m is not null")
    return rows.select("doc_id", F.col("m.name").alias("name"), F.round("m.confidence", 6).alias("confidence"), reg.category(F.col("m.industry")).alias("category"))


def keyword_lookup(spark, d):
    """Suppliers as they were read whose whole name is a keyword."""
    rows = view(spark, d, "extractions").filter("field = 'supplier_name'").withColumn("b", reg.by_name(F.col("value"))).filter("b is not null")
    return rows.select("model", "doc_id", F.col("b.name").alias("name"), F.col("b.industry").alias("industry"), F.col("b.abn").alias("abn"))


def abn_lookup(spark, d):
    """Registered names of the suppliers' ABNs, and of ABNs that are registered, in several forms."""
    own, known = view(spark, d, "abn_inputs"), reg.as_frame(spark)
    shaped = own.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).join(F.broadcast(known.select("ord", F.col("abn").alias("plain"))), F.col("id") % len(reg.default()) == F.col("ord"))
    form = F.when(F.col("s") == 0, F.replace("plain", F.lit(" "), F.lit(""))).otherwise(F.concat(F.lit("ABN "), F.replace("plain", F.lit(" "), F.lit("-"))))
    rows = own.select("id", "abn").unionByName(shaped.select((1000000 + F.col("id") * 2 + F.col("s")).alias("id"), form.alias("abn")))
    return reg.by_abn(rows, known).select("id", "abn", "registered_name", "registered_industry")


def business_categories(spark, d):
    names = view(spark, d, "extractions").filter("field = 'supplier_name'").select(F.col("value").alias("name")).distinct()
    return names.withColumn("c", reg.by_contained(F.col("name"))).select("name", "c.*")


def industry_words(spark, d):
    """How many texts of each type hold a word of each industry, counted once for each word."""
    words = reg.literal([{"industry": i, "word": w} for i, ws in reg.industry_words().items() for w in ws])
    rows = view(spark, d, "receipts").select("doc_type", F.lower("text").alias("low"))
    hits = rows.select("doc_type", F.explode(F.filter(words, lambda t: F.col("low").contains(t["word"]))).alias("t"))
    return hits.groupBy("doc_type", F.col("t.industry").alias("industry")).agg(F.count("*").alias("n"))


def alias_table(spark, d):
    """Suppliers as models read them, by the aliases that their names hold."""
    table = reg.literal([{"key": k, "nth": j, "alias": a} for k, names in reg.aliases().items() for j, a in enumerate(names)])
    names = view(spark, d, "extractions").filter("field = 'supplier_name'").select(F.lower("value").alias("low"))
    hits = names.select(F.explode(F.filter(table, lambda t: F.col("low").contains(F.lower(t["alias"])))).alias("t"))
    return hits.groupBy("t.key", "t.nth", "t.alias").agg(F.count("*").alias("n"))


def registry_statistics(spark, d):
    """Supplier readings that name a registered business, by its industry, kind and states."""
    named = view(spark, d, "extractions").filter("field = 'supplier_name'").select(F.explode(F.array_compact(F.array(reg.by_name(F.col("value"))["ord"]))).alias("ord"))
    return reg.statistics(named.join(F.broadcast(reg.as_frame(spark)), "ord"))


def primary_bank(spark, d):
    rows = view(spark, d, "receipts").select("doc_id", F.explode(tx.primary_bank(F.col("text"))).alias("b"))
    return rows.select("doc_id", F.col("b.bank").alias("bank"), F.col("b.category").alias("category"), F.round("b.confidence", 6).alias("confidence"))


def cleaned_responses(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return rows.select("conv_id", "turn", F.sha2(tx.cleanup(F.coalesce("text", F.lit(""))), 256).alias("cleaned_sha256"))


def line_items(spark, d):
    """Lines of orders as invoice text, read back."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    money = lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    line = F.concat_ws(" ", F.concat(F.lit("Part no"), F.col("l_partkey").cast("string")), F.col("l_quantity").cast("int").cast("string"), money(F.floor(cents / F.col("l_quantity").cast("int"))), money(cents))
    texts = rows.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("INVOICE\n"), line, F.lit("\nthank you")).alias("text"))
    out = tx.line_items(texts)
    return out.groupBy("id").agg(F.count("*").alias("items"), F.sum(F.round(F.col("line_total") * 100).cast("long")).alias("cents"), F.sum("quantity").cast("long").alias("quantity"))


def enhanced(spark, d):
    """Transactions of a statement against the highlights of the same statement."""
    t = view(spark, d, "bank_txns")
    txns = t.select("statement_id", "ord", "description", F.col("cents").cast("string").alias("amount"), (F.col("event_id") % 90 / 100).alias("work_score"))
    marks = view(spark, d, "statement_marks")
    out = tx.enhanced(txns, marks, "statement_id")
    return rounded(out.select("statement_id", "ord", "work_score", "highlighted", "highlight_color"), "work_score")


def work_scores(spark, d):
    rows = view(spark, d, "bank_txns").withColumn("w", tx.work_score(F.col("description")))
    return rows.select("event_id", F.round("w.score", 6).alias("score"), F.col("w.category").alias("category"), F.array_join("w.indicators", ",").alias("indicators"))


def pipeline(spark, d):
    """Text to fields to compliance to grade, as one chain without a shuffle."""
    return _flat(br.graded(view(spark, d, "receipts"), THIS_YEAR))


def _flat(graded):
    flat = graded.withColumns({k: F.array_join(k, ",") for k in ("flags", "advice")})
    return rounded(flat, "extraction", "business", "overall", "compliance_score")


def batch_with_errors(spark, d):
    """Papers of which some are broken, each with its grade or its error."""
    return _flat(br.run(view(spark, d, "broken_receipts"), THIS_YEAR))


def batch_failures(spark, d):
    return br.failures(br.isolated(view(spark, d, "broken_receipts"), br.stages(THIS_YEAR)))


def described_papers(spark, d):
    """Receipts as models read them, with what is known of their type and which of its fields the readings lack."""
    read = view(spark, d, "extractions").filter("value <> ''").groupBy("model", "doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))
    docs = view(spark, d, "asked").select("doc_id", "doc_type")
    out = dt.described(docs.join(read, "doc_id"), F.col("fields"))
    return out.select("model", "doc_id", "doc_type", "ato_category", "requires_gst", "is_expense", F.array_join("lacking", ",").alias("lacking"))


def contained_names(spark, d):
    """Well-known names in receipts of meals and other papers, as they are written there."""
    rows = view(spark, d, "receipts").filter("doc_type = 'meal_receipt'").drop("doc_type")
    return hd.read(rows, "meal_receipt").select("doc_id", "restaurant_name", "total_amount")


def rule_stats(spark, d):
    """What the rules of each field found in receipts, beside how many rules there are and how strong."""
    rules = spark.createDataFrame([(r.field, r.priority) for r in ex.RULES], "field string, priority int")
    known = rules.groupBy("field").agg(F.count("*").alias("rules"), F.max("priority").alias("highest"), F.count_if(F.col("priority") >= 9).alias("strong"))
    found = ex.long_form(ex.extract(view(spark, d, "receipts"))).groupBy("field").agg(F.count("*").alias("found"))
    return found.join(F.broadcast(known), "field")


def _sql(text: str) -> str:
    return text.replace("'", "''")


def _found(r: ex.Rule) -> str:
    v = f"NULLIF(TRIM(REGEXP_EXTRACT(text, '(?im){_sql(r.pattern)}', 1)), '')"
    return f"CASE WHEN REGEXP_MATCHES({v}, '{_sql(r.valid)}') THEN {v} END" if r.valid else v


def _raw_fields() -> str:
    """Raw value and rule place of every field by type, as rows."""
    parts = []
    for field in ex.FIELDS:
        for kind in ("business_receipt", "fuel_receipt", "tax_invoice", "bank_statement", "meal_receipt"):
            tried = ex.rules_for(kind, field)
            if tried:
                pick = "CASE " + " ".join(f"WHEN {_found(r)} IS NOT NULL THEN {ex.RULES.index(r)}" for r in tried) + " END"
                value = "COALESCE(" + ", ".join(map(_found, tried)) + ")" if len(tried) > 1 else _found(tried[0])
                parts.append(f"SELECT doc_id, doc_type, text, '{field}' AS field, {value} AS raw, {pick} AS rule FROM receipts WHERE doc_type = '{kind}'")
    return " UNION ALL ".join(parts)


def _titled(v: str) -> str:
    parts = f"STRING_SPLIT(REGEXP_REPLACE({v}, '([^A-Za-z])([A-Za-z])', '\\1|\\2', 'g'), '|')"
    return f"ARRAY_TO_STRING(LIST_TRANSFORM({parts}, lambda w: UPPER(SUBSTR(w, 1, 1)) || LOWER(SUBSTR(w, 2))), '')"


_DIGITS = "REGEXP_REPLACE(raw, '[^0-9]', '', 'g')"
_PLAIN = "REGEXP_REPLACE(raw, '[$,\\s]', '', 'g')"
_CLEAN = f"""CASE
  WHEN field IN ('total', 'subtotal', 'amount') THEN CASE WHEN TRY_CAST({_PLAIN} AS DOUBLE) IS NOT NULL THEN {_PLAIN} ELSE raw END
  WHEN field = 'abn' THEN CASE WHEN LENGTH({_DIGITS}) = 11 THEN SUBSTR({_DIGITS}, 1, 2) || ' ' || SUBSTR({_DIGITS}, 3, 3) || ' ' || SUBSTR({_DIGITS}, 6, 3) || ' ' || SUBSTR({_DIGITS}, 9, 3) ELSE {_DIGITS} END
  WHEN field = 'bsb' THEN CASE WHEN LENGTH({_DIGITS}) = 6 THEN SUBSTR({_DIGITS}, 1, 3) || '-' || SUBSTR({_DIGITS}, 4, 3) ELSE raw END
  WHEN field IN ('supplier', 'customer') THEN {_titled("REGEXP_REPLACE(raw, '\\s+', ' ', 'g')")}
  WHEN field = 'fuel_type' THEN {_titled("raw")}
  WHEN field IN ('litres', 'price_per_litre') THEN PRINTF('%.2f', TRY_CAST(raw AS DOUBLE))
  ELSE raw END"""
_FIELDS = with_views("", "receipts").rstrip() + f", raw AS ({_raw_fields()}), kept AS (SELECT * FROM raw WHERE raw IS NOT NULL) "
_BASE = "CASE rule " + " ".join(f"WHEN {k} THEN {r.priority / 10 * 0.4 + (0.2 if r.valid else 0.0)!r}E0" for k, r in enumerate(ex.RULES)) + " END"
_WORDS = "CASE field " + " ".join(f"WHEN '{f}' THEN " + " + ".join(f"CASE WHEN LOWER(text) LIKE '%{w}%' THEN 0.05E0 ELSE 0 END" for w in ws) for f, ws in ex.CONTEXT.items()) + " ELSE 0 END"
_CONF = f"LEAST({_BASE} + CASE WHEN LENGTH(raw) > 1 THEN 0.2E0 ELSE 0 END + CASE WHEN LENGTH(raw) > 5 THEN 0.1E0 ELSE 0 END + {_WORDS}, 1.0E0)"


def _score(kind: str) -> str:
    words = cl.KEYWORDS[kind]
    biz = "LEAST(0.3E0 * (" + " + ".join(f"CASE WHEN CONTAINS(low, '{_sql(b)}') THEN 1 ELSE 0 END" for b in cl.BUSINESSES) + "), 1.0E0) * 0.2E0"
    total, most = biz, 0.2
    if words:
        hit = " + ".join(f"CASE WHEN CONTAINS(low, '{_sql(w)}') THEN {cl.keyword_weight(w)}E0 ELSE 0 END" for w in words)
        total, most = f"{total} + LEAST(({hit}) / {len(words)}, 1.0E0) * 0.5E0", most + 0.5
    if kind in cl.FORMATS:
        hit = " + ".join(f"CASE WHEN REGEXP_MATCHES(low, '{_sql(p)}') THEN 1 ELSE 0 END" for p in cl.FORMATS[kind])
        total, most = f"{total} + LEAST(0.2E0 * ({hit}), 1.0E0) * 0.3E0", most + 0.3
    return f"ROUND(({total}) / {most!r}E0, 9)"


_SCORED = " UNION ALL ".join(f"SELECT doc_id, doc_type, {k} AS ord, '{kind}' AS type, {_score(kind)} AS score FROM low" for k, kind in enumerate(cl.KEYWORDS))
_CLASS = with_views("", "receipts").rstrip() + f", low AS (SELECT doc_id, doc_type, LOWER(text) AS low FROM receipts), scored AS ({_SCORED}), best AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS place FROM scored), predicted AS (SELECT doc_id, doc_type, CASE WHEN score < 0.3 THEN 'other' ELSE type END AS predicted, score FROM best WHERE place = 1) "

QUERIES = {
    "x3_rules_extract": rules_extract,
    "x10_rule_statistics": rule_stats,
    "g10_field_coverage": field_coverage,
    "c2_classify_documents": classify,
    "c2_confusion": confusion,
    "j2_business_recognition": recognition,
    "j3_keyword_lookup": keyword_lookup,
    "j4_abn_lookup": abn_lookup,
    "j5_business_categories": business_categories,
    "s9_industry_words": industry_words,
    "s10_aliases": alias_table,
    "g22_registry_statistics": registry_statistics,
    "c12_primary_bank": primary_bank,
    "c17_prompt_routes": lambda s, d: view(s, d, "receipts").select("doc_id", "doc_type", tx.route(F.col("text"), F.col("doc_type")).alias("prompt")),
    "p21_cleaned_responses": cleaned_responses,
    "x7_line_items": line_items,
    "j12_enhanced_transactions": enhanced,
    "b5_work_scores": work_scores,
    "a1_compliance": compliance,
    "e1_document_pipeline": pipeline,
    "e2_batch": batch_with_errors,
    "c9_described_types": described_papers,
    "x54_meal_names": contained_names,
    "e2_failures": batch_failures,
}



#: The registry's keywords, and its businesses, as rows.
_KEYWORDS = ", ".join(f"({k}, {j}, '{_sql(w.lower())}', {reg.base_confidence(w)}E0)" for k, b in enumerate(reg.default()) for j, w in enumerate(b.keywords))
_KNOWN = ", ".join(f"({k}, '{_sql(reg.short_name(b))}', '{_sql(b.name)}', '{b.industry}', '{b.kind}', '{b.abn}', '{reg.SIMPLE.get(b.industry, b.industry)}')" for k, b in enumerate(reg.default()))
_REGISTRY = f"kw(biz, j, word, base) AS (VALUES {_KEYWORDS}), known(biz, name, official, industry, kind, abn, category) AS (VALUES {_KNOWN})"


def _recognised(texts: str) -> str:
    """Common table expressions up to `best`: (id, biz, confidence) of the surest business in each (id, low) of `texts`."""
    return f"""{_REGISTRY},
hits AS (SELECT t.id, t.low, kw.*, ROW_NUMBER() OVER (PARTITION BY t.id, kw.biz ORDER BY kw.j) AS nth FROM {texts} t JOIN kw ON CONTAINS(t.low, kw.word)),
sure AS (SELECT id, biz, ROUND(LEAST(base + CASE WHEN REGEXP_MATCHES(low, '\\b' || REGEXP_ESCAPE(word) || '\\b') THEN 0.15E0 ELSE 0 END + LEAST(0.1E0 * GREATEST((LENGTH(low) - LENGTH(REPLACE(low, word, ''))) / LENGTH(word) - 1, 0), 0.2E0), 1.0E0), 9) AS confidence FROM hits WHERE nth = 1),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY confidence DESC, biz) AS place FROM sure) u WHERE place = 1)"""


def _bank(k: int, name: str, category: str, pattern: str) -> str:
    hits = f"LIST_DISTINCT(REGEXP_EXTRACT_ALL(low, '{pattern}'))"
    return f"SELECT doc_id, {k} AS ord, '{name}' AS bank, '{category}' AS category, LEN({hits}) AS n, LEN(LIST_FILTER({hits}, lambda h: LENGTH(h) > 10)) AS long, ctx FROM low"


_CTX = " + ".join(f"CASE WHEN CONTAINS(LOWER(text), '{w}') THEN 1 ELSE 0 END" for w in tx.BANK_CONTEXT)
_BANKS = " UNION ALL ".join(_bank(k, *b) for k, b in enumerate(tx.BANKS))
_ROUTE = "CASE " + " ".join("WHEN " + " OR ".join(f"CONTAINS(LOWER(text), '{_sql(w)}')" for w in ws) + f" THEN '{k}_extraction_prompt'" for k, ws in tx.ROUTES) + " WHEN doc_type IN ('business_receipt', 'fuel_receipt', 'tax_invoice', 'bank_statement') THEN doc_type || '_extraction_prompt' ELSE 'business_receipt_extraction_prompt' END"
_KINDS = " UNION ALL ".join(f"SELECT event_id, {k} AS ord, '{c}' AS category, ROUND(0.3E0 * ({' + '.join(f'CASE WHEN CONTAINS(d, {chr(39)}{w}{chr(39)}) THEN 1 ELSE 0 END' for w in ws)}), 9) AS s FROM t" for k, (c, ws) in enumerate(tx.WORK_CATEGORIES.items()))

#: Registered ABNs in several forms beside the suppliers' own.
_ABN_ROWS = with_views("", "abn_inputs").strip().removeprefix("WITH ") + f", r AS (SELECT id, abn FROM abn_inputs UNION ALL SELECT 1000000 + id * 2 + s, CASE s WHEN 0 THEN REPLACE(k.abn, ' ', '') ELSE 'ABN ' || REPLACE(k.abn, ' ', '-') END FROM (SELECT id, 0 AS s FROM abn_inputs UNION ALL SELECT id, 1 FROM abn_inputs) a JOIN (SELECT biz, abn FROM known) k ON k.biz = a.id % {len(reg.default())})"

ORACLES = {
    "c12_primary_bank": with_views("", "receipts").rstrip() + f", low AS (SELECT doc_id, LOWER(text) AS low, {_CTX} AS ctx FROM receipts), m AS ({_BANKS}), s AS (SELECT *, ROUND(LEAST(0.6E0 + CASE WHEN long > 0 THEN 0.3E0 ELSE 0 END + CASE WHEN n > 1 THEN 0.1E0 ELSE 0 END + CASE WHEN ctx >= 3 THEN 0.2E0 WHEN ctx >= 1 THEN 0.1E0 ELSE 0 END, 1.0E0), 9) AS confidence FROM m WHERE n > 0), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY confidence DESC, ord) AS place FROM s) SELECT doc_id, bank, category, ROUND(confidence, 6) AS confidence FROM r WHERE place = 1 AND confidence >= 0.7",
    "c17_prompt_routes": with_views(f"SELECT doc_id, doc_type, {_ROUTE} AS prompt FROM receipts", "receipts"),
    "x7_line_items": "SELECT l_orderkey AS id, COUNT(*) AS items, CAST(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(SUM(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_orderkey",
    "j12_enhanced_transactions": with_views("", "bank_txns", "statement_marks").rstrip() + ", a AS (SELECT statement_id, ord, description, CAST(cents AS VARCHAR) AS amount, CAST(event_id % 90 AS DOUBLE) / 100 AS work_score FROM bank_txns), b AS (SELECT statement_id, ord AS mark, description AS marked, amount AS marked_amount, color FROM statement_marks), p AS (SELECT a.statement_id, a.ord, b.mark, b.color, ROW_NUMBER() OVER (PARTITION BY a.statement_id, a.ord ORDER BY b.mark) AS k FROM a JOIN b ON a.statement_id = b.statement_id WHERE LEN(LIST_INTERSECT(LIST_DISTINCT(STRING_SPLIT(LOWER(a.description), ' ')), LIST_DISTINCT(STRING_SPLIT(LOWER(b.marked), ' ')))) >= 2 OR CONTAINS(b.marked_amount, a.amount)) SELECT a.statement_id, a.ord, ROUND(CASE WHEN p.mark IS NOT NULL THEN LEAST(a.work_score + 0.3E0, 1.0E0) ELSE a.work_score END, 6) AS work_score, p.mark IS NOT NULL AS highlighted, p.color AS highlight_color FROM a LEFT JOIN p ON p.statement_id = a.statement_id AND p.ord = a.ord AND p.k = 1",
    "b5_work_scores": with_views("", "bank_txns").rstrip() + f", t AS (SELECT event_id, LOWER(description) AS d FROM bank_txns), k AS ({_KINDS}), best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY s DESC, ord) AS place FROM k) u WHERE place = 1) SELECT t.event_id, ROUND(LEAST(0.2E0 * ({' + '.join(f'CASE WHEN CONTAINS(d, {chr(39)}{w}{chr(39)}) THEN 1 ELSE 0 END' for w in tx.WORK_WORDS)}) + LEAST(s, 0.6E0), 1.0E0), 6) AS score, CASE WHEN s > 0 THEN category END AS category, CONCAT_WS(',', {', '.join(f'CASE WHEN CONTAINS(d, {chr(39)}{w}{chr(39)}) THEN {chr(39)}{w}{chr(39)} END' for w in tx.WORK_WORDS)}) AS indicators FROM t JOIN best ON best.event_id = t.event_id",
    "j2_business_recognition": with_views("", "receipts").rstrip() + f", low AS (SELECT doc_id AS id, LOWER(text) AS low FROM receipts), {_recognised('low')} SELECT best.id AS doc_id, known.name AS name, ROUND(confidence, 6) AS confidence, known.category AS category FROM best JOIN known ON known.biz = best.biz",
    "j3_keyword_lookup": with_views("", "extractions").rstrip() + f", {_REGISTRY}, f AS (SELECT word, MIN(biz) AS biz FROM kw GROUP BY word) SELECT e.model, e.doc_id, k.official AS name, k.industry AS industry, k.abn AS abn FROM extractions e JOIN f ON f.word = LOWER(e.value) JOIN known k ON k.biz = f.biz WHERE e.field = 'supplier_name'",
    "j4_abn_lookup": f"WITH {_REGISTRY}, {_ABN_ROWS}, k AS (SELECT REPLACE(abn, ' ', '') AS digits, MIN(biz) AS biz FROM known GROUP BY 1) SELECT r.id, r.abn, known.official AS registered_name, known.industry AS registered_industry FROM r LEFT JOIN k ON k.digits = REGEXP_REPLACE(r.abn, '[^0-9]', '', 'g') LEFT JOIN known ON known.biz = k.biz",
    "j5_business_categories": with_views("", "extractions").rstrip() + f", {_REGISTRY}, n AS (SELECT DISTINCT value FROM extractions WHERE field = 'supplier_name'), h AS (SELECT n.value, MIN(kw.biz) AS biz FROM n JOIN kw ON CONTAINS(LOWER(n.value), kw.word) GROUP BY n.value) SELECT n.value AS name, COALESCE(known.category, 'unknown') AS category, CASE WHEN known.biz IS NULL THEN 0.0E0 ELSE 0.9E0 END AS confidence, COALESCE(known.industry, '') AS industry FROM n LEFT JOIN h ON h.value = n.value LEFT JOIN known ON known.biz = h.biz",
    "s9_industry_words": with_views("", "receipts").rstrip() + ", w(industry, word) AS (VALUES " + ", ".join(f"('{i}', '{_sql(x)}')" for i, ws in reg.industry_words().items() for x in ws) + ") SELECT doc_type, industry, COUNT(*) AS n FROM receipts r JOIN w ON CONTAINS(LOWER(r.text), w.word) GROUP BY doc_type, industry",
    "s10_aliases": with_views("", "extractions").rstrip() + ", t(key, nth, alias) AS (VALUES " + ", ".join(f"('{_sql(k)}', {j}, '{_sql(x)}')" for k, xs in reg.aliases().items() for j, x in enumerate(xs)) + ") SELECT key, nth, alias, COUNT(*) AS n FROM extractions e JOIN t ON CONTAINS(LOWER(e.value), LOWER(alias)) WHERE e.field = 'supplier_name' GROUP BY key, nth, alias",
    "g22_registry_statistics": with_views("", "extractions").rstrip() + f", {_REGISTRY}, f AS (SELECT word, MIN(biz) AS biz FROM kw GROUP BY word), st(biz, states) AS (VALUES " + ", ".join(f"({k}, '{','.join(b.states)}')" for k, b in enumerate(reg.default())) + """), b AS (SELECT k.industry, k.kind, st.states FROM extractions e JOIN f ON f.word = LOWER(e.value) JOIN known k ON k.biz = f.biz JOIN st ON st.biz = f.biz WHERE e.field = 'supplier_name')
 SELECT 'industry' AS "by", industry AS value, COUNT(*) AS n FROM b GROUP BY 2 UNION ALL SELECT 'kind', kind, COUNT(*) FROM b GROUP BY 2 UNION ALL SELECT 'state', s, COUNT(*) FROM (SELECT UNNEST(STRING_SPLIT(states, ',')) AS s FROM b WHERE states <> '') t GROUP BY 2""",
    "x10_rule_statistics": _FIELDS + ", r AS (SELECT field, COUNT(*) AS rules, MAX(priority) AS highest, COUNT(CASE WHEN priority >= 9 THEN 1 END) AS strong FROM (VALUES " + ", ".join(f"('{r.field}', {r.priority})" for r in ex.RULES) + ") t(field, priority) GROUP BY field) SELECT k.field, rules, highest, strong, COUNT(*) AS found FROM kept k JOIN r ON r.field = k.field GROUP BY k.field, rules, highest, strong",
    "x3_rules_extract": _FIELDS + f"SELECT doc_id, doc_type, field, {_CLEAN} AS value, ROUND({_CONF}, 6) AS confidence FROM kept",
    "g10_field_coverage": _FIELDS + f"SELECT doc_type, field, COUNT(*) AS n, COUNT(DISTINCT {_CLEAN}) AS different FROM kept GROUP BY doc_type, field",
    "c2_classify_documents": _CLASS + "SELECT doc_id, predicted, ROUND(score, 6) AS score FROM predicted",
    "c2_confusion": _CLASS + "SELECT doc_type, predicted, COUNT(*) AS n FROM predicted GROUP BY doc_type, predicted",
}

_TYPES = ", ".join(f"('{k}', '{v[1]}', [{', '.join(f'{chr(39)}{f}{chr(39)}' for f in v[2])}]::VARCHAR[], {v[3]})" for k, v in dt.METADATA.items())
_NAME = "COALESCE(" + ", ".join(f"NULLIF(REGEXP_EXTRACT(text, '(?i){_sql(n)}', 0), '')" for n in hd.NAMES) + ")"
_TOTALED = "COALESCE(" + ", ".join(f"NULLIF(TRIM(REGEXP_EXTRACT(text, '(?i){_sql(p)}', 1)), '')" for p in hd.TOTALS) + ")"
ORACLES |= {
    "c9_described_types": with_views("", "extractions", "asked").rstrip() + f", t(doc_type, ato_category, fields, requires_gst) AS (VALUES {_TYPES}), r AS (SELECT model, doc_id, LIST(field) AS had FROM extractions WHERE value <> '' GROUP BY model, doc_id) SELECT r.model, a.doc_id, a.doc_type, ato_category, requires_gst, a.doc_type NOT IN ('unknown', 'bank_statement') AS is_expense, ARRAY_TO_STRING(LIST_FILTER(fields, lambda f: NOT LIST_CONTAINS(had, f)), ',') AS lacking FROM asked a JOIN r ON r.doc_id = a.doc_id LEFT JOIN t ON t.doc_type = a.doc_type",
    "x54_meal_names": with_views("", "receipts").rstrip() + f" SELECT doc_id, {_NAME} AS restaurant_name, TRY_CAST(REPLACE({_TOTALED}, ',', '') AS DOUBLE) AS total_amount FROM receipts WHERE doc_type = 'meal_receipt'",
}
