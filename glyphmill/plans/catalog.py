"""All queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.plans import corpus, dialogue, files, memory, quality, search, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = corpus.QUERIES | dialogue.QUERIES | files.QUERIES | memory.QUERIES | quality.QUERIES | search.QUERIES | splits.QUERIES
ORACLE_SQL: dict[str, str] = corpus.ORACLE_SQL | dialogue.ORACLE_SQL | files.ORACLE_SQL | memory.ORACLE_SQL | quality.ORACLE_SQL | search.ORACLE_SQL | splits.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without flags by language, after cleaning and measuring."""
    return corpus.clean_rows(spark, sf_dir)
