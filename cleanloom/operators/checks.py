"""Contract checks of a dataset. Each gives rows (code, severity, subject, detail); a dataset passes if none is an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.plans.config import PERSON_ID_PATTERN


def _issue(df: DataFrame, code: str, subject: Column, detail: Column | str = "", severity: str = "error") -> DataFrame:
    d = detail if isinstance(detail, Column) else F.lit(detail)
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), d.cast("string").alias("detail"))


def all_issues(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def passed(issues: DataFrame) -> DataFrame:
    """One row: error_count, warning_count, passed."""
    e, w = F.count_if(F.col("severity") == "error"), F.count_if(F.col("severity") == "warning")
    return issues.agg(e.alias("error_count"), w.alias("warning_count"), (e == 0).alias("passed"))


def files_match(written: DataFrame, listed: DataFrame) -> DataFrame:
    """Both (path, sha256): files that are listed but missing, or whose content differs."""
    j = listed.select("path", F.col("sha256").alias("want")).join(written.select("path", "sha256"), "path", "left")
    return all_issues(_issue(j.where("sha256 IS NULL"), "missing_file", F.col("path")), _issue(j.where("sha256 <> want"), "hash_mismatch", F.col("path")))


def split_leakage(splits: DataFrame, key: str = "person_id") -> DataFrame:
    """People in several splits."""
    g = splits.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1")
    return _issue(g, "split_leakage", F.col(key), F.concat(F.col("n"), F.lit(" splits")))


def repeated(df: DataFrame, key: str, code: str) -> DataFrame:
    """Values that occur more than once, null and empty ones aside: one issue for each, detail telling how many rows are too many."""
    g = df.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return _issue(g, code, F.col(key), (F.col("n") - 1).cast("string"))


def header_is(df: DataFrame, expected: list[str], code: str = "canonical_header") -> DataFrame:
    empty = df.sparkSession.createDataFrame([(",".join(df.columns),)] if df.columns != expected else [], "have string")
    return _issue(empty, code, F.lit("header"), F.col("have"))


def canonical_people(df: DataFrame, fields: list[str]) -> DataFrame:
    """Ids by pattern, distinct ids, e-mails and phones, and no nulls."""
    nulls = F.filter(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return all_issues(
        _issue(df.where(F.col("person_id").isNull() | ~F.col("person_id").rlike(PERSON_ID_PATTERN)), "invalid_person_id", F.coalesce("person_id", F.lit(""))),
        repeated(df, "person_id", "duplicate_person_id"), repeated(df, "email", "duplicate_email"), repeated(df, "phone", "duplicate_phone"),
        _issue(df.select("person_id", F.explode(nulls).alias("f")), "unexpected_null", F.col("person_id"), F.col("f")),
    )


def source_checks(sources: list[DataFrame], mappings: DataFrame) -> DataFrame:
    """Over all sources together: missing and repeated record ids, records without a person, persons by pattern, and no person_id column.

    mappings: (source_record_id, person_id).
    """
    ids = reduce(DataFrame.unionAll, [s.select(F.col("source_record_id").cast("string")) for s in sources])
    m = mappings.select("source_record_id", "person_id").dropDuplicates(["source_record_id"])
    leak = [i for i, s in enumerate(sources) if "person_id" in s.columns]
    leaks = ids.sparkSession.createDataFrame([(str(i),) for i in leak], "s string")
    return all_issues(
        _issue(ids.where("source_record_id IS NULL OR source_record_id = ''"), "missing_source_record_id", F.lit("")),
        repeated(ids, "source_record_id", "duplicate_source_record_id"),
        _issue(ids.where("source_record_id <> ''").distinct().join(m, "source_record_id", "left_anti"), "unmapped_source_record", F.col("source_record_id")),
        _issue(m.where(~F.col("person_id").rlike(PERSON_ID_PATTERN)), "invalid_mapped_person_id", F.col("source_record_id"), F.col("person_id")),
        _issue(leaks, "ground_truth_leakage", F.col("s"), "the source names persons"),
    )


def duplicate_group_checks(groups: DataFrame, mappings: DataFrame) -> DataFrame:
    """Groups whose records belong to other than one person."""
    e = groups.select("person_id", F.explode(F.array_distinct("source_record_ids")).alias("source_record_id"))
    j = e.join(mappings.select("source_record_id", F.col("person_id").alias("owner")), "source_record_id", "left").groupBy("person_id").agg(F.count_distinct("owner").alias("owners"), F.count_if(F.col("owner").isNull()).alias("lost"))
    return _issue(j.where("owners <> 1 OR lost > 0"), "invalid_duplicate_group", F.col("person_id"), F.concat(F.col("owners"), F.lit(" persons")))


def pair_checks(pairs: DataFrame) -> DataFrame:
    """Hard negatives name two persons, all other pairs one."""
    same = F.col("person_id_a").eqNullSafe(F.col("person_id_b"))
    subject, negative = F.concat_ws("|", "person_id_a", "person_id_b"), F.coalesce(F.col("pair_type") == "hard_negative", F.lit(False))
    return all_issues(_issue(pairs.where(negative & same), "invalid_hard_negative", subject), _issue(pairs.where(~negative & ~same), "invalid_hard_positive", subject))


def hard_case_checks(records: DataFrame | None, mappings: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """A table of hard cases (kind hard_positive or hard_negative; None if it is missing) against the mappings and the pairs of that kind.

    Missing and repeated record ids, records without a person, a column that names persons, pairs whose records aren't in the
    table and pairs of the wrong persons.
    """
    if records is None:
        return _issue(mappings.sparkSession.createDataFrame([(kind,)], "k string"), "missing_hard_cases_csv", F.col("k"))
    mine, ids = pairs.where(F.col("pair_type") == kind), records.select(F.col("source_record_id").cast("string"))
    named = mine.select(F.explode(F.array("source_record_id_a", "source_record_id_b")).alias("source_record_id")).distinct()
    owned = mappings.select("source_record_id").distinct()
    told = records.where(F.length("person_id") > 0).select(F.lit(kind).alias("k")).limit(1) if "person_id" in records.columns else None
    found = [
        _issue(ids.where("source_record_id IS NULL OR source_record_id = ''"), "missing_source_record_id", F.lit(kind)),
        repeated(ids, "source_record_id", "duplicate_source_record_id"),
        _issue(ids.where("source_record_id <> ''").distinct().join(owned, "source_record_id", "left_anti"), "unmapped_hard_case_record", F.col("source_record_id")),
        _issue(named.join(ids.distinct(), "source_record_id", "left_anti"), f"missing_{kind}_record", F.col("source_record_id")),
        pair_checks(mine),
    ]
    return all_issues(*found, *([_issue(told, "ground_truth_leakage", F.col("k"), "the table names persons")] if told is not None else []))


def record_shape(df: DataFrame, fields: list[str]) -> DataFrame:
    """invalid_schema: columns that a canonical table lacks, and person ids that aren't texts beginning with P-."""
    lost = df.sparkSession.createDataFrame([(f,) for f in ["person_id", *fields] if f not in df.columns], "f string")
    out = [_issue(lost, "invalid_schema", F.col("f"), "column is missing")]
    if "person_id" in df.columns:
        out.append(_issue(df.where(~F.coalesce(F.col("person_id").cast("string").startswith("P-"), F.lit(False))), "invalid_schema", F.coalesce(F.col("person_id").cast("string"), F.lit("")), "no person id"))
    return all_issues(*out)


def expected_counts(listed: DataFrame, summed: DataFrame) -> DataFrame:
    """Both (name, n): counts of the manifest and of the ground truth that both have and that differ; counts of records are left out."""
    j = listed.where("NOT endswith(name, '_records') OR name = 'corruption_events'").join(summed.select("name", F.col("n").alias("m")), "name")
    return _issue(j.where("n <> m"), "count_mismatch", F.col("name"), F.concat_ws(" ", "n", F.lit("not"), "m"))


def missing_parts(spark, present: dict[str, bool]) -> DataFrame:
    """Codes such as missing_manifest or missing_ground_truth of what isn't there."""
    return _issue(spark.createDataFrame([(k,) for k, there in present.items() if not there], "k string"), "missing", F.col("k")).withColumn("code", F.concat(F.lit("missing_"), F.col("subject")))


def referenced(rows: DataFrame, key: str, to: DataFrame, to_key: str, code: str) -> DataFrame:
    """Values that have no partner."""
    return _issue(rows.select(key).where(F.col(key).isNotNull()).distinct().join(to.select(F.col(to_key).alias(key)), key, "left_anti"), code, F.col(key))


def counts_reconcile(have: DataFrame, want: DataFrame, key: str, count: str, code: str = "corruption_count_mismatch") -> DataFrame:
    """Counts by key that differ, whichever side lacks one."""
    j = have.select(key, F.col(count).alias("h")).join(want.select(key, F.col(count).alias("w")), key, "full")
    return _issue(j.where("NOT h <=> w"), code, F.col(key), F.concat_ws(" ", F.coalesce(F.col("h"), F.lit(0)), F.lit("not"), F.coalesce(F.col("w"), F.lit(0))))


def expected_files(spark, present: list[str], documented: list[str]) -> DataFrame:
    """Malformed fixtures that are missing (error) or undocumented (warning)."""
    lost, extra = sorted(set(documented) - set(present)), sorted(set(present) - set(documented))
    mk = lambda xs: spark.createDataFrame([(x,) for x in xs], "n string")
    return all_issues(_issue(mk(lost), "missing_malformed_fixture", F.col("n")), _issue(mk(extra), "undocumented_malformed_fixture", F.col("n"), severity="warning"))
