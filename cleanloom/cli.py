"""Command line: profile, map, validate, normalize, golden, corrupt, check and evaluate.

Exit codes: 0 fine; profile 1 and the others 2 for a file that can't be read; validate 1 if a record has errors; check 1 if the
dataset fails; evaluate 1 if a gate, the dataset or a fixture fails, 2 if it can't run; 3 for anything else.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import functions as F

from cleanloom.functions.session import local_session
from cleanloom.operators import checks, golden, mapping, normalization, profiling, quality, validation
from cleanloom.plans import dataset as datasets
from cleanloom.plans import harness
from cleanloom.plans.config import CANONICAL_FIELDS, IngestionConfig, MappingConfig, QualityConfig, load
from cleanloom.sources import sinks
from cleanloom.sources.files import IngestionError, ParsedDataset, parse_file


def _profiled(d: ParsedDataset, c: IngestionConfig):
    return profiling.column_profiles(d.accepted, ["row_number"], c, list(d.headers))


def _mapped(d: ParsedDataset, a: argparse.Namespace):
    plan = mapping.build_mapping_plan(_profiled(d, IngestionConfig()), load(MappingConfig, a.mapping_config))
    return plan, mapping.apply_plan(d.accepted, plan)


def main(argv: Sequence[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cleanloom")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("profile", "map", "validate", "normalize"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("--worksheet")
        s.add_argument("--report-dir", default="reports")
        s.add_argument("--mapping-config")
        s.add_argument("--quality-config")
        s.add_argument("--apply", metavar="CSV_FOLDER", help="map: write the canonical records there")
    s = sub.add_parser("golden")
    s.add_argument("output")
    s.add_argument("--people", type=int, default=10_000)
    s.add_argument("--hard", type=int, default=200)
    s.add_argument("--layout", type=int, default=0, choices=range(len(golden.LAYOUTS)))
    s.add_argument("--seed", type=int, default=42)
    s = sub.add_parser("corrupt")
    s.add_argument("input", help="CSV with source_record_id, source_name and the canonical fields")
    s.add_argument("output")
    s.add_argument("--profile", default="formatting_noise", choices=sorted(golden.PROFILES))
    s.add_argument("--seed", type=int, default=42)
    s = sub.add_parser("check")
    s.add_argument("dataset")
    s = sub.add_parser("evaluate")
    s.add_argument("--dataset")
    s.add_argument("--fixtures")
    s.add_argument("--report-dir", default="reports")
    a = p.parse_args(argv)
    spark = local_session("cleanloom")
    try:
        if a.what == "golden":
            datasets.build_dataset(spark, a.output, a.people, a.hard, a.seed, a.layout)
            return 0
        if a.what == "corrupt":
            records = spark.read.option("header", True).csv(a.input).withColumn("_n", F.pmod(F.xxhash64("source_record_id"), F.lit(2**31)))
            if "person_id" not in records.columns:
                records = records.withColumn("person_id", F.lit(None).cast("string"))
            bad, log = golden.corrupt(records, a.seed, a.profile, "_n")
            sinks.write_csv(bad.drop("_n", "person_id"), f"{a.output}/records")
            sinks.write_jsonl(log, f"{a.output}/corruptions")
            return 0
        if a.what == "check":
            found = datasets.dataset_issues(spark, a.dataset)
            row = checks.passed(found).first()
            print(json.dumps(row.asDict() | {"issues": sinks.report_rows(found)}, ensure_ascii=False))
            return 0 if row.passed else 1
        if a.what == "evaluate":
            code, report = harness.run_evaluation(spark, a.report_dir, a.dataset, a.fixtures)
            print(json.dumps(report, ensure_ascii=False, default=str))
            return code
        d = parse_file(spark, a.input, worksheet=a.worksheet)
        if a.what == "profile":
            sinks.write_report({"columns": sinks.report_rows(_profiled(d, IngestionConfig())), "accounting": sinks.report_rows(d.accounting())}, a.report_dir, "profile_report", True)
            return 0
        plan, records = _mapped(d, a)
        c = load(QualityConfig, a.quality_config)
        if a.what == "map":
            sinks.write_report({"plan": sinks.report_rows(plan.to_df(spark)), "summary": plan.counts(), "missing": list(plan.missing)}, a.report_dir, "schema_mapping_report", True)
            if a.apply:
                sinks.write_csv(records, a.apply, ["row_number", *CANONICAL_FIELDS])
            return 0
        if a.what == "validate":
            sinks.write_report({"summary": sinks.report_rows(validation.validation_summary(records, c))}, a.report_dir, "validation_report")
            return 1 if validation.issues(records, c).where(F.col("severity") == "error").limit(1).count() else 0
        sinks.write_jsonl(normalization.transformations(records, c), f"{a.report_dir}/transformations")
        sinks.write_report({"quality": sinks.report_rows(quality.quality_summary(records, c)), "normalization": sinks.report_rows(normalization.normalization_summary(records, c))}, a.report_dir, "normalization_report")
        return 0
    except IngestionError as e:
        print(e, file=sys.stderr)
        return 1 if a.what == "profile" else 2
    except Exception as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
