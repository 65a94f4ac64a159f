"""The corpus pipeline: stages that filter, clean and encode documents, one after another.

Every stage gets all documents that its predecessor kept, reread from Parquet.
Documents may have more columns, null ids, null, empty and very long texts and
repeated rows, and there may be none at all; what becomes of such rows stands
at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxloom.llm import bpe, decontaminate, neardup, pii, toxicity
from taxloom.llm.shared import remove, shared_folder, table, write

#: Documents with this score or more are rejected as toxic, as the operator's query calls them.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted random field does not reject; null and empty texts are scored as empty, repeated rows each."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), None)
    return toxicity.score(docs, model).filter(F.col("score") < TOXIC).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id.

    Null, empty and blank texts are nobody's copies. Texts that share an id are
    documents of their own; rows that repeat id and text stay or go together.
    """
    return neardup.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of the benchmark; null and empty texts, and all without a benchmark, stay."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.verdicts(found).filter(~F.col("contaminated")).select("row.*")


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and terms that reveal it replaced in the text; null texts stay null."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the text that they decode to, a row for each row; null texts are empty."""
    out = bpe.encode_decode(docs, bpe.default_path())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", remove_personal_data),
    ("encoding", encode),
]

#: SQL cannot express the classifier, the signatures and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written to the shared folder and reread.

    A stage's output goes when the next one's has been written. The last stage
    is not run here, so what it reads stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = write(stage(spark, docs, sf_dir), f"{folder}/{k}")
        if before:
            remove(spark, before)
        before = f"{folder}/{k}"
    return STAGES[-1][1](spark, docs, sf_dir)
