"""The record rules over streams. Rules look at one record only, so a stream needs no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from cleanloom.operators.validation import issues
from cleanloom.plans.config import QualityConfig


def issue_stream(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """Issues of a stream of records, a row each, as they arrive."""
    if not records.isStreaming:
        raise ValueError("a stream is expected")
    return issues(records, config, key)


def write_issues(records: DataFrame, path: str, checkpoint: str, config: QualityConfig | None = None, key: str = "row_number") -> DataStreamWriter:
    """A writer of the issues to parquet, exactly once, to be started by the caller."""
    return issue_stream(records, config, key).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
