"""Column profiles: counts, distinct values, samples, inferred types and pattern ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cleanloom.functions.text import strip
from cleanloom.operators.validation import EMAIL, PHONE
from cleanloom.plans.config import IngestionConfig

# What stands for a yes or a no when types are inferred.
BOOLEANS = ("true", "false", "yes", "no", "1", "0")
# Date notations that inference accepts.
DATE_FORMATS = ("yyyy-M-d", "d.M.yyyy", "d/M/yyyy", "M/d/yyyy")
# Patterns whose share is reported, over the whole stripped value.
PATTERNS = {
    "email_like": EMAIL,
    "phone_like": PHONE,
    "numeric_like": r"\A-?\p{Nd}+(\.\p{Nd}+)?\z",
    "date_like": r"\A(\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}|\p{Nd}{2}[./]\p{Nd}{2}[./]\p{Nd}{4})\z",
}
INFERRED = ("integer", "float", "boolean", "date")
#: Share of the values that settles a type although others stand beside them.
MOSTLY = 0.95
#: Slices into which each column is cut while its first rows are found.
SLICES = 32


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def is_date(s: Column) -> Column:
    return F.coalesce(*(F.when(F.year(F.try_to_date(s, f)) >= 1, True) for f in DATE_FORMATS), F.lit(False))


def type_tests(s: Column) -> dict[str, Column]:
    """Of a stripped, non-empty value."""
    return {"integer": s.rlike(r"\A-?\p{Nd}+\z"), "float": s.rlike(r"\A-?\p{Nd}+(\.\p{Nd}+)?\z"), "boolean": F.lower(s).isin(*BOOLEANS), "date": is_date(s)}


def long_values(table: DataFrame, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """(name, pos, o, v): each column's values as text, in the order of the columns ``order``, stripped in ``s``."""
    names = columns or table.columns
    cells = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("pos"), F.col(f"`{n}`").cast("string").alias("v")) for i, n in enumerate(names)))
    t = table.select(F.struct(*order).alias("o"), F.inline(cells))
    return t.withColumn("s", strip(F.col("v")))


def first_rows(values: DataFrame, n: int) -> DataFrame:
    """The first n non-empty values of each column. Slices are ranked by themselves first, so no task holds a whole column."""
    t = values.where("s <> ''").withColumn("slice", F.pmod(F.xxhash64("o"), F.lit(SLICES)))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("name", "slice").orderBy("o"))).where(F.col("rank") <= n)
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("o"))).where(F.col("rank") <= n)


def column_profiles(table: DataFrame, order: list[str], config: IngestionConfig | None = None, columns: list[str] | None = None) -> DataFrame:
    """One row for each column: name, position, counts, ratios, sample_values, type_inference and patterns.

    ``order`` names the columns that put rows in source order. Null, blank and other values are counted apart; distinct values are
    exact, over stripped values; samples are the first of the rows in order, types and patterns look at the first 1000 non-empty
    ones. Distinct values are counted in two steps, first by value, so that a frequent value is one row before it moves. A column
    without values is a string of low confidence. A table without rows gives its columns with zeros.
    """
    names = columns or table.columns
    return value_profiles(long_values(table, order, names), names, config)


def value_profiles(v: DataFrame, names: list[str], config: IngestionConfig | None = None) -> DataFrame:
    """column_profiles() of values that are long already (see long_values); several tables may stand in one, under names of their own."""
    c = (config or IngestionConfig()).check()
    by_value = v.groupBy("name", "s").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"))
    counts = by_value.groupBy("name").agg(
        F.sum("n").alias("row_count"),
        F.sum("nulls").alias("null_count"),
        F.coalesce(F.sum(F.when(F.col("s") == "", F.col("n"))), F.lit(0)).alias("blank_count"),
        F.count_if(F.col("s") != "").alias("unique_count"),
    )
    top = first_rows(v, c.pattern_sample)
    tests, size = type_tests(F.col("s")), F.count("*").alias("sample_size")
    sampled = top.groupBy("name").agg(
        size,
        F.array_sort(F.collect_list(F.when(F.col("rank") <= c.sample_values, F.struct("rank", "s")))).alias("samples"),
        *(F.count_if(t).alias(f"is_{k}") for k, t in tests.items()),
        *(F.count_if(F.col("s").rlike(p)).alias(k) for k, p in PATTERNS.items()),
    )
    spark = v.sparkSession
    base = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, position int")
    t = base.join(F.broadcast(counts), "name", "left").join(F.broadcast(sampled), "name", "left")  # one row a column each
    zero = {k: F.coalesce(F.col(k), F.lit(0)).alias(k) for k in ("row_count", "null_count", "blank_count", "unique_count", "sample_size", *(f"is_{k}" for k in INFERRED), *PATTERNS)}
    t = t.select("name", "position", F.coalesce("samples", F.array().cast("array<struct<rank:int,s:string>>")).alias("samples"), *zero.values())
    n = F.col("sample_size")
    share = {k: ratio(F.col(f"is_{k}"), n) for k in INFERRED}
    best = F.greatest(*share.values())
    inferred = F.when(n == 0, "string").when(best == 1.0, F.coalesce(*(F.when(share[k] == 1.0, k) for k in INFERRED))).when(best >= MOSTLY, F.coalesce(*(F.when(share[k] == best, k) for k in INFERRED))).otherwise("string")
    sure = F.when(n == 0, "low").when(best == 1.0, "high").when(best >= MOSTLY, "medium").otherwise("low")
    note = F.when(n == 0, "no_non_empty_values").when(best == 1.0, F.lit(None)).when(best >= MOSTLY, "mixed_values_below_threshold").otherwise("mixed_values")
    patterns = F.array(*(F.struct(F.lit(k).alias("pattern_name"), F.col(k).alias("match_count"), n.alias("sample_size"), ratio(F.col(k), n).alias("match_ratio")) for k in PATTERNS))
    filled = (F.col("row_count") - F.col("null_count") - F.col("blank_count")).alias("non_null_count")
    return t.select(
        "name", "position", "row_count", filled, "null_count", "blank_count", "unique_count",
        ratio(filled, F.col("row_count")).alias("completeness_ratio"), ratio(F.col("unique_count"), filled).alias("uniqueness_ratio"),
        F.transform("samples", lambda x: x["s"]).alias("sample_values"),
        F.struct(inferred.alias("inferred_type"), sure.alias("confidence"), note.alias("note")).alias("type_inference"), patterns.alias("patterns"),
    )


def dataset_profile(profiles: DataFrame, accepted: int, rejected: int, warnings: Sequence[str] = (), metadata: Mapping[str, str] | None = None) -> DataFrame:
    """One row: row_count (accepted and rejected), accepted_rows, rejected_rows, column_count, empty_columns, warnings, metadata."""
    empty = F.array_sort(F.collect_list(F.when(F.col("non_null_count") == 0, F.struct("position", "name"))))
    facts = [F.lit(x) for kv in sorted((metadata or {}).items()) for x in kv]
    return profiles.agg(F.count("*").alias("column_count"), F.transform(empty, lambda x: x["name"]).alias("empty_columns")).select(
        F.lit(accepted + rejected).cast("long").alias("row_count"), F.lit(accepted).cast("long").alias("accepted_rows"), F.lit(rejected).cast("long").alias("rejected_rows"), "column_count", "empty_columns",
        F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"), F.create_map(*facts).cast("map<string,string>").alias("metadata"),
    )
