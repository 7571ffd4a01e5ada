"""The record-quality run: validate, decide what is safe, normalise, validate again, summarise; and row accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.operators.normalization import normalized_columns
from cleanloom.operators.validation import conditions, not_texts, wide_counts
from cleanloom.plans.config import CANONICAL_FIELDS, QualityConfig


STAGES = ("pre", "post")


def quality_columns(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """One row for each record: key, the normalised fields, changed_field_count, transformations and the issue counts of both stages.

    Every rule and step is a column of the record; rules across fields look at the city as normalised. Nothing is shuffled.
    """
    t, before = normalized_columns(records, config, key)
    after, columns = conditions({f: F.col(f"_n_{f}") for f in CANONICAL_FIELDS}, not_texts(records), (config or QualityConfig()).check(), "_p")
    t = t.select("*", *(v.alias(k) for k, v in columns.items()))
    counts = [v.alias(f"{stage}_{k}") for stage, found in zip(STAGES, (before, after)) for k, v in wide_counts(found).items()]
    return t.select(key, *(F.col(f"_n_{f}").alias(f) for f in CANONICAL_FIELDS), "changed_field_count", "transformations", *counts)


def quality_records(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """One row for each record: the normalised fields, changed_field_count, transformations, counts of both validations, is_valid (after)."""
    return quality_columns(records, config, key).withColumn("is_valid", F.col("post_error_count") == 0)


def quality_summary(records: DataFrame, config: QualityConfig | None = None, key: str = "row_number") -> DataFrame:
    """Two rows, stage 'pre' and 'post': record_count, valid_count, invalid_count, error_count, warning_count, info_count."""
    kinds = ("error", "warning", "info")
    each = F.array(*(F.struct(F.lit(stage).alias("stage"), *(F.col(f"{stage}_{s}_count").alias(f"{s}_count") for s in kinds)) for stage in STAGES))
    return quality_columns(records, config, key).select(F.inline(each)).groupBy("stage").agg(
        F.count("*").alias("record_count"), F.count_if(F.col("error_count") == 0).alias("valid_count"), F.count_if(F.col("error_count") > 0).alias("invalid_count"),
        *(F.sum(f"{s}_count").alias(f"{s}_count") for s in kinds),
    )


class AccountingError(ValueError):
    """Accepted and rejected rows don't add up to the rows of the source."""


def row_accounting(accepted: DataFrame, rejected: DataFrame, source_rows: int | None = None) -> DataFrame:
    """One row: source_rows, accepted_rows, rejected_rows; the sum must hold."""
    n = accepted.select(F.lit(1).alias("a"), F.lit(0).alias("r")).unionAll(rejected.select(F.lit(0).alias("a"), F.lit(1).alias("r"))).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("accepted_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("rejected_rows"))
    out = n.select((F.col("accepted_rows") + F.col("rejected_rows")).alias("source_rows"), "accepted_rows", "rejected_rows")
    if source_rows is not None:
        row = out.first()
        if row.source_rows != source_rows:
            raise AccountingError(f"{source_rows} rows in the source, {row.accepted_rows} accepted and {row.rejected_rows} rejected")
    return out
