"""Metrics, gates and labelled benchmarks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.functions.text import strip
from cleanloom.operators.mapping import AUTO_MAP, REVIEW, UNMAPPED, ColumnFacts, MappingPlan, build_mapping_plan, failure_kind, label_outcome, plan_columns
from cleanloom.operators.normalization import normalize_fields
from cleanloom.operators.profiling import value_profiles
from cleanloom.operators.validation import issues, rules
from cleanloom.plans.benchmarks import MALFORMED_EXPECTED, MAPPING_CASES, VALIDATION_CASES
from cleanloom.plans.config import CANONICAL_FIELDS, MappingConfig, QualityConfig


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1 as columns; 0 where nothing is to divide by."""
    p, r = safe_divide(tp, tp + fp), safe_divide(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), safe_divide(2 * p * r, p + r).alias("f1")]


# The gates, metric to comparison and threshold.
GATES = {"auto_merge_precision": ("gte", 0.99), "false_merge_rate": ("lte", 0.005), "candidate_recall": ("gte", 0.94), "schema_mapping_accuracy": ("gte", 0.98), "normalization_accuracy": ("gte", 0.995), "review_routing_recall": ("gte", 0.95)}


def hard_gates(metrics: DataFrame, gates: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """metrics (metric, value) against the gates: (metric, value, operator, threshold, passed). A gate without its metric is an error."""
    g = GATES if gates is None else gates
    if bad := {op for op, _ in g.values()} - {"gte", "lte"}:
        raise ValueError(f"unknown operators {sorted(bad)}")
    spark = metrics.sparkSession
    rows = spark.createDataFrame([(k, op, float(t)) for k, (op, t) in g.items()], "metric string, operator string, threshold double")
    out = rows.join(metrics.select("metric", "value"), "metric", "left")
    if lost := [r.metric for r in out.where("value IS NULL").select("metric").collect()]:
        raise KeyError(f"metrics missing: {sorted(lost)}")
    ok = F.when(F.col("operator") == "gte", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return out.select("metric", "value", "operator", "threshold", ok.alias("passed"))


def validation_cases(spark: SparkSession, cases: Sequence[tuple[str, bool, dict[str, str | None]]] = VALIDATION_CASES) -> DataFrame:
    """(case_id, target_rule, should_fire and the canonical fields)."""
    schema = "case_id int, target_rule string, should_fire boolean, " + ", ".join(f"{f} string" for f in CANONICAL_FIELDS)
    return spark.createDataFrame([(i, rule, fire, *(r.get(f) for f in CANONICAL_FIELDS)) for i, (rule, fire, r) in enumerate(cases, 1)], schema)


def validation_benchmark(cases: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """cases: see validation_cases(). One row for each case: outcome TP, FP, FN, TN or ERROR and failure_kind.

    A case whose rule doesn't exist or is disabled can't be decided: RULE_ERROR.
    """
    c = (config or QualityConfig()).check()
    found = issues(cases.withColumn("row_number", F.col("case_id")), c).select(F.col("row_number").alias("case_id"), F.col("rule_id").alias("target_rule")).distinct().withColumn("fired", F.lit(True))
    j = cases.select("case_id", "target_rule", "should_fire").join(found, ["case_id", "target_rule"], "left").withColumn("fired", F.coalesce("fired", F.lit(False)))
    known = F.col("target_rule").isin(*(r.id for r in rules() if r.id not in c.disabled))
    outcome = F.when(~F.coalesce(known, F.lit(False)), "ERROR").when(F.col("should_fire") & F.col("fired"), "TP").when(F.col("should_fire"), "FN").when(F.col("fired"), "FP").otherwise("TN")
    failure = F.when(F.col("outcome") == "FN", "FALSE_NEGATIVE").when(F.col("outcome") == "FP", "FALSE_POSITIVE").when(F.col("outcome") == "ERROR", "RULE_ERROR")
    return j.withColumn("outcome", outcome).withColumn("failure_kind", failure)


def benchmark_metrics(outcomes: DataFrame) -> DataFrame:
    n = {k: F.count_if(F.col("outcome") == k) for k in ("TP", "FP", "FN", "TN")}
    t = outcomes.agg(*(v.alias(k.lower()) for k, v in n.items()))
    return t.select("tp", "fp", "fn", "tn", *classification(F.col("tp"), F.col("fp"), F.col("fn")))


#: Kinds of corruption that normalisation undoes.
IN_SCOPE = ("whitespace", "phone_format")


def normalization_benchmark(events: DataFrame, config: QualityConfig | None = None) -> DataFrame:
    """Each event of a corruption log normalised from after_value: (event columns, normalized, outcome).

    outcome: correct or missed or incorrect for kinds in scope (missed: unchanged), skipped for others; unnecessary where a value
    that was right is changed.
    """
    t = events.withColumn("value", F.col("after_value")).withColumn("eligibility", F.lit("SAFE")).withColumn("pos", F.lit(0)).withColumn("city_value", F.lit(None).cast("string")).withColumn("not_text", F.lit(False))
    t = normalize_fields(t, config)
    want, got = F.col("before_value"), F.col("normalized")
    outcome = (
        F.when(~F.col("corruption_type").isin(*IN_SCOPE) | want.isNull() | F.col("after_value").isNull(), "skipped")
        .when(got.eqNullSafe(want), F.when(F.col("after_value").eqNullSafe(want), "unnecessary").otherwise("correct"))
        .when(got.eqNullSafe(F.col("after_value")), "missed")
        .otherwise("incorrect")
    )
    return t.select(*events.columns, "normalized", outcome.alias("outcome"))


def normalization_accuracy(results: DataFrame) -> DataFrame:
    c = F.count_if(F.col("outcome") == "correct")
    n = F.count_if(F.col("outcome") != "skipped")
    return results.agg(n.alias("expected"), c.alias("correct"), F.count_if(F.col("outcome") == "skipped").alias("skipped"), safe_divide(c, n).alias("accuracy"))


_LABELLED = "case_id string, source_column string, expected_decision string, expected_field string, decision string, canonical_field string, score double, outcome string, failure_kind string"


def _labelled(case_id: str, plan: MappingPlan, expected: Mapping[str, tuple[str, str | None]]) -> list[tuple]:
    got = {m.source_column: m for m in plan.columns}
    out = []
    for column, (decision, field) in expected.items():
        m = got.get(column)
        if m is None:
            out.append((case_id, column, decision, field, None, None, None, "missed", "MISSED_MAPPING"))
        else:
            out.append((case_id, column, decision, field, m.decision, m.canonical_field, float(m.score), label_outcome(decision, field, m.decision, m.canonical_field), failure_kind(decision, field, m.decision, m.canonical_field)))
    return out


def mapping_benchmark(spark: SparkSession, cases: Sequence[dict] = MAPPING_CASES, config: MappingConfig | None = None) -> DataFrame:
    """cases: {case_id, headers, rows, expected: {header: (decision, field)}}: one row for each labelled column.

    The columns of all cases are profiled in one pass, each under a name of its own.
    """
    name = lambda case, k: f"{case}#{k}"
    values = [(name(i, k), k, n, r[k] if k < len(r) else None) for i, c in enumerate(cases) for n, r in enumerate(c["rows"], 2) for k in range(len(c["headers"]))]
    names = [name(i, k) for i, c in enumerate(cases) for k in range(len(c["headers"]))]
    v = spark.createDataFrame(values, "name string, pos int, n int, v string").withColumn("o", F.struct("n")).withColumn("s", strip(F.col("v")))
    facts = {r.name: ColumnFacts.of(r) for r in value_profiles(v.select("name", "pos", "o", "v", "s"), names).collect()}
    out = []
    for i, c in enumerate(cases):
        have = {h: facts[name(i, k)] for k, h in enumerate(c["headers"])} if c["rows"] else {}
        out += _labelled(c["case_id"], plan_columns(c["headers"], have, config), c["expected"])
    return spark.createDataFrame(out, _LABELLED)


def layout_benchmark(spark: SparkSession, profiles: Sequence[DataFrame], labels: Sequence[Sequence[tuple[str, str | None, str]]], config: MappingConfig | None = None) -> DataFrame:
    """Profiles of delivered layouts and for each the (column, field, decision) of its columns: one row for each column, as mapping_benchmark()."""
    out = []
    for n, (p, want) in enumerate(zip(profiles, labels)):
        out += _labelled(f"layout_{n}", build_mapping_plan(p, config), {column: (decision, field) for column, field, decision in want})
    return spark.createDataFrame(out, _LABELLED)


def mapping_metrics(results: DataFrame) -> DataFrame:
    """One row of counts and shares over labelled columns; a share of nothing is 1."""
    of = lambda column, value: F.col(column) == value
    right = of("outcome", "correct")
    auto, labelled_auto = of("decision", AUTO_MAP), of("expected_decision", AUTO_MAP)
    counts = {
        "cases": F.count_distinct("case_id"), "columns": F.count("*"), "correct": F.count_if(right), "incorrect": F.count_if(of("outcome", "incorrect")), "missed": F.count_if(of("outcome", "missed")),
        "auto_map_total": F.count_if(auto & labelled_auto), "auto_map_correct": F.count_if(auto & labelled_auto & right),
        "expected_review": F.count_if(of("expected_decision", REVIEW)), "correct_review": F.count_if(of("expected_decision", REVIEW) & right),
        "expected_unmapped": F.count_if(of("expected_decision", UNMAPPED)), "correct_unmapped": F.count_if(of("expected_decision", UNMAPPED) & right),
    }
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b if isinstance(b, Column) else F.col(b)), F.lit(1.0))
    t = results.agg(*(v.alias(k) for k, v in counts.items()))
    t = t.withColumns({
        "precision": share("correct", F.col("correct") + F.col("incorrect")), "recall": share("correct", F.col("correct") + F.col("missed")), "accuracy": share("correct", "columns"),
        "auto_map_precision": share("auto_map_correct", "auto_map_total"), "review_recall": share("correct_review", "expected_review"),
    })
    f1 = safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return t.withColumn("f1", f1).withColumn("passed", (F.col("incorrect") == 0) & (F.col("missed") == 0))


def ingestion_checks(spark: SparkSession, directory: str) -> DataFrame:
    """(file, expected, got, passed) for the malformed fixtures in a folder."""
    from pathlib import Path

    from cleanloom.sources.files import IngestionError, parse_file

    out = []
    for name, want in MALFORMED_EXPECTED.items():
        try:
            d = parse_file(spark, str(Path(directory) / name))
            reason = d.rejected.select("reason_code").first()
            got = (d.accepted.count(), d.rejected.count(), reason[0] if reason else None)
        except IngestionError as e:
            got = e.code
        out.append((name, str(want), str(got), got == want))
    return spark.createDataFrame(out, "file string, expected string, got string, passed boolean")
