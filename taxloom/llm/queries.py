"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from taxloom.llm import bpe, decontaminate, licenses, lm, neardup, negatives, pii, quality, rules, secrets, spans, toxicity, trie
from taxloom.llm.shared import bucket_of, table


#: Texts count as positive from this score on.
POSITIVE = 0.3


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of(F.col("id"), 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs, model)
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), (bucket_of(doc_id, 4) == 2).alias("held_out"), "score", (F.col("score") >= POSITIVE).cast("int").alias("predicted"), "spans")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(k, F.col("base")).alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("base"), F.col("terms")).alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.verdicts(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = bucket_of(F.col("id"), 5) == 1
    scored = lm.score(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (bucket_of(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.verdicts(docs, found).drop("rule")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_path())


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = bucket_of(F.col("id"), 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    doc_id = F.col("row.doc_id")
    return quality.score(docs, model).select(doc_id.alias("doc_id"), (bucket_of(doc_id, 5) == 0).alias("held_out"), "score", (F.col("score") >= POSITIVE).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents"), longest=spans.LONGEST)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.dictionary(docs))
    base = secrets.base_of(F.col("spans"))
    counts = [secrets.count_of(k, F.col("spans")).alias(f"n_{k}") for k in secrets.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_decontaminate": op3_decontaminate,
    "op4_license_scan": op4_license_scan,
    "op5_language_model": op5_language_model,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_bpe": op8_bpe,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_secrets": op11_secrets,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

_NEGATIVES = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, LIST_TRANSFORM(embedding, lambda x: FLOOR(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0),
 s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(LIST_DOT_PRODUCT(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT a, b AS p, score AS ps FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) t WHERE k <= 5),
 n AS (SELECT p.a, p.p, ps, s.b, s.score, ROW_NUMBER() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * ps <= 100 * s.score AND 100 * s.score <= 95 * ps)
 SELECT a AS anchor_id, p AS positive_id, CAST(k AS INT) AS rank, b AS negative_id, ps AS positive_score, score AS negative_score FROM n WHERE k <= 3"""

#: crc32 bit by bit: each digit (raised by 1000) is added, then eight shifts (-1).
_CRC = """XOR(LIST_REDUCE(LIST_CONCAT([CAST(4294967295 AS BIGINT)], FLATTEN(LIST_TRANSFORM(STRING_SPLIT(CAST(c AS VARCHAR), ''), lambda ch: [CAST(1000 + ASCII(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN XOR(a, b - 1000) WHEN a & 1 = 1 THEN XOR(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
_TRIE = f"""WITH own AS (SELECT conv_id AS c, LIST({{'role': COALESCE(role, ''), 'text': COALESCE(text, '')}} ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS l FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
 k AS (SELECT c, l, {_CRC} % 9 AS h, c - c % 5 AS b FROM own),
 whole AS (SELECT k.c, LIST_CONCAT(LIST_SLICE(b.l, 1, h), LIST_SLICE(k.l, h + 1, LEN(k.l))) AS f FROM k LEFT JOIN own b ON b.c = k.b),
 mem AS (SELECT c, f, d, LIST_SLICE(f, 1, d) AS p FROM (SELECT c, f, UNNEST(GENERATE_SERIES(0, LEN(f))) AS d FROM whole) t),
 nodes AS (SELECT p, d, COUNT(*) AS n, MIN(c) AS c, SHA256(COALESCE(STRING_AGG(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (LEN(f) = d), '')) AS e FROM mem GROUP BY p, d),
 kids AS (SELECT LIST_SLICE(p, 1, d - 1) AS p, COUNT(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
 v AS (SELECT nodes.p, d, COALESCE(k, 0) AS k, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * STRLEN(nodes.p[d].text) END AS s FROM nodes LEFT JOIN kids ON kids.p = nodes.p),
 sub AS (SELECT LIST_SLICE(p, 1, a) AS p, SUM(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, SUM(s) AS saved FROM (SELECT *, UNNEST(GENERATE_SERIES(0, d)) AS a FROM v) t GROUP BY 1)
 SELECT n.c AS conv_id, CAST(n.d AS BIGINT) AS depth, up.c AS parent_conv_id, n.n AS n_convs, CAST(COALESCE(kids.k, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.e AS ends_sha256
 FROM nodes n JOIN sub ON sub.p = n.p LEFT JOIN kids ON kids.p = n.p LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = LIST_SLICE(n.p, 1, n.d - 1)"""

ORACLES: dict[str, str] = {"op12_hard_negatives": _NEGATIVES, "op13_prefix_trie": _TRIE}
