"""Every query of the core by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cleanloom.functions.session import table
from cleanloom.operators import feeds
from cleanloom.operators.quality import quality_summary
from cleanloom.plans import record_queries
from cleanloom.plans.crm import contacts

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The whole record-quality run over the contacts, summed up before and after normalisation."""
    return quality_summary(contacts(spark, d))


def _files(spark: SparkSession, d: str, words: bool = True) -> DataFrame:
    return feeds.file_table(table(spark, d, "feed_lines"), table(spark, d, "feed_files"), table(spark, d, "header_labels"), words)


def p2_rejected(spark: SparkSession, d: str) -> DataFrame:
    return feeds.rejected_rows(feeds.parsed_lines(table(spark, d, "feed_lines"), _files(spark, d, False)))


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    return feeds.loaded_rows(feeds.parsed_lines(table(spark, d, "feed_lines"), _files(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_rejected(spark, d).select("line_id", "reason_code")


def p5_changes(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return feeds.schema_changes(feeds.file_schemas(files, feeds.parsed_lines(table(spark, d, "feed_lines"), files)))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    parsed = feeds.parsed_lines(table(spark, d, "feed_lines"), files)
    return feeds.unified_table(parsed, feeds.unified_types(feeds.file_schemas(files, parsed)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_changes(spark, d).select("file_id", "change_type", "header").distinct()


def queries() -> dict[str, Query]:
    return record_queries.queries() | {f.__name__: f for f in (p2_rejected, p2_loaded, p2_found, p5_changes, p5_table, p5_found)}


def oracle_sql() -> dict[str, str]:
    return record_queries.oracle_sql()
