"""Every registered query of the library, with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxloom.plans import assessment_sql, bank_queries, comparison_queries, document_queries, handler_queries, page_queries, prompt_queries, reading_queries, result_queries, statement_queries, value_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "g12_batch_summary"

for _module in (result_queries, value_queries, bank_queries, page_queries, document_queries, handler_queries, reading_queries, statement_queries, prompt_queries, comparison_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
ORACLES |= assessment_sql.ORACLES
