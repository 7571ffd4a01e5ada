"""The evaluation harness: benchmarks and gates in one run, with a report and an exit code."""

from __future__ import annotations

import csv
import json
import tempfile
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.operators import checks, evaluation, golden
from cleanloom.operators.profiling import column_profiles
from cleanloom.plans import dataset as datasets
from cleanloom.plans.config import CANONICAL_FIELDS
from cleanloom.sources import sinks
from cleanloom.sources.files import parse_file

FIXTURE_SMOKE, MIXED = "FIXTURE_SMOKE", "MIXED"
#: The gates that this engine measures itself; those of entity resolution need labelled matches and are fed from outside.
MEASURED = ("schema_mapping_accuracy", "normalization_accuracy", "review_routing_recall")


def layout_results(spark: SparkSession, people: DataFrame, by_file: bool = False) -> DataFrame:
    """The mapping benchmark over the three layouts of source B; with by_file each layout is written to a file and parsed first."""
    tables = [golden.source_b(people, n).drop("person_id") for n in range(len(golden.LAYOUTS))]
    labels = [golden.layout_mapping(n) for n in range(len(golden.LAYOUTS))]
    if not by_file:
        return evaluation.layout_benchmark(spark, [column_profiles(t, ["source_record_id"]) for t in tables], labels)
    with tempfile.TemporaryDirectory() as home:  # on the driver, which parses them
        profiles = []
        for n, t in enumerate(tables):
            path = Path(home) / f"layout_{n}.csv"
            with path.open("w", encoding="utf-8", newline="") as f:
                w = csv.writer(f)
                w.writerow(t.columns)
                w.writerows(t.orderBy("source_record_id").limit(200).collect())
            d = parse_file(spark, str(path))
            profiles.append(column_profiles(d.accepted, ["row_number"], columns=list(d.headers)))
        return evaluation.layout_benchmark(spark, profiles, labels)


def read_cases(path: str) -> list[dict]:
    """Labelled cases from a JSON file, which must hold a list of objects with a case_id."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, list) or not all(isinstance(c, dict) and "case_id" in c for c in data):
        raise ValueError(f"{path}: a list of cases is expected")
    return data


def mapping_cases(path: str) -> list[dict]:
    """Cases for mapping_benchmark() from a file: expected is {header: {decision, canonical_field}}."""
    out = []
    for c in read_cases(path):
        expected = {str(h): (str(e.get("decision", "UNMAPPED")), e.get("canonical_field")) for h, e in c.get("expected", {}).items()}
        out.append({"case_id": c["case_id"], "headers": [str(h) for h in c["headers"]], "rows": list(c.get("rows", [])), "expected": expected})
    return out


def validation_case_rows(path: str) -> list[tuple[str, bool, dict]]:
    """Cases for validation_cases() from a file: {case_id, target_rule, should_fire, record}."""
    return [(str(c["target_rule"]), bool(c["should_fire"]), {f: c["record"].get(f) for f in CANONICAL_FIELDS}) for c in read_cases(path)]


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict()


def report_data(name: str, version: str, metrics: Mapping[str, float], gates: list[dict], parts: Mapping[str, dict], notes: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The report: mode, states, gates and the measured parts. MIXED once any part was measured, else FIXTURE_SMOKE."""
    status = "PASS" if all(g["passed"] for g in gates) else "FAIL"
    return {
        "evaluation_mode": MIXED if parts else FIXTURE_SMOKE,
        "product_quality_evaluation": "PARTIALLY_AVAILABLE" if parts else "NOT_YET_AVAILABLE",
        "entity_resolution_quality": "AVAILABLE" if "candidate_recall" in metrics else "NOT_YET_AVAILABLE",
        "schema_mapping_quality": "AVAILABLE" if "schema_mapping_benchmark" in parts else "NOT_YET_AVAILABLE",
        "hard_gate_status": status,
        "overall_status": status,
        "dataset": {"name": name, "version": version},
        "metrics": dict(metrics),
        "hard_gates": gates,
        **parts,
        **(notes or {}),
    }


def run_evaluation(
    spark: SparkSession,
    output: str | None = None,
    dataset: str | None = None,
    fixtures: str | None = None,
    extra_metrics: Mapping[str, float] | None = None,
    gates: Mapping[str, tuple[str, float]] | None = None,
    cases: Mapping[str, str] | None = None,
) -> tuple[int, dict[str, Any]]:
    """(exit code, report): 0 all gates pass, 1 a gate, the dataset or a fixture fails, 2 the evaluation itself can't run.

    dataset: a folder of build_dataset(), checked and used for the normalisation benchmark. fixtures: a folder of malformed files.
    extra_metrics: what others measured, such as of entity resolution; a gate is judged only where its metric is there, unless
    ``gates`` names it. cases: files of labelled cases, 'validation' or 'mapping', instead of the built-in ones.
    """
    try:
        notes: dict[str, Any] = {}
        if dataset is not None:
            found = sinks.report_rows(checks.passed(datasets.dataset_issues(spark, dataset)))[0]
            notes["dataset_checks"] = found
            if not found["passed"]:
                return 1, notes
        if fixtures is not None:
            t = sinks.report_rows(evaluation.ingestion_checks(spark, fixtures))
            notes["ingestion_checks"] = t
            if not all(r["passed"] for r in t):
                return 1, notes
        files = dict(cases or {})
        rows = validation_case_rows(files["validation"]) if "validation" in files else evaluation.VALIDATION_CASES
        outcomes = evaluation.validation_benchmark(evaluation.validation_cases(spark, rows))
        failures = sinks.report_rows(outcomes.where("failure_kind IS NOT NULL"))
        parts: dict[str, dict] = {"validation_benchmark": _one(evaluation.benchmark_metrics(outcomes)) | {"labelled_cases": len(rows), "failures": failures, "passed": not failures}}
        mapped = evaluation.mapping_benchmark(spark, mapping_cases(files["mapping"]) if "mapping" in files else evaluation.MAPPING_CASES)
        kinds = {r.failure_kind: r["count"] for r in mapped.where("failure_kind IS NOT NULL").groupBy("failure_kind").count().collect()}
        parts["schema_mapping_benchmark"] = _one(evaluation.mapping_metrics(mapped)) | {"failures_by_category": kinds}
        parts["source_b_mapping_benchmark"] = _one(evaluation.mapping_metrics(layout_results(spark, golden.clean_people(spark, 200), by_file=True)))
        metrics = {"schema_mapping_accuracy": parts["schema_mapping_benchmark"]["accuracy"], "review_routing_recall": parts["schema_mapping_benchmark"]["review_recall"]} | dict(extra_metrics or {})
        if dataset is not None:
            log = datasets._read(spark, Path(dataset), "corruptions")
            parts["normalization_benchmark"] = _one(evaluation.normalization_accuracy(evaluation.normalization_benchmark(log)))
            metrics["normalization_accuracy"] = parts["normalization_benchmark"]["accuracy"]
        judged = dict(gates) if gates is not None else {k: v for k, v in evaluation.GATES.items() if k in metrics}
        m = spark.createDataFrame([(k, float(v)) for k, v in metrics.items()], "metric string, value double")
        results = sinks.report_rows(evaluation.hard_gates(m, judged).orderBy("metric"))
        version = json.loads((Path(dataset) / "manifest.json").read_text())["version"] if dataset else datasets.VERSION
        report = report_data(Path(dataset).name if dataset else "fixtures", version, metrics, results, parts, notes)
        if output is not None:
            sinks.write_report(report, output, "report", True)
        return (0 if report["overall_status"] == "PASS" else 1), report
    except (OSError, KeyError, TypeError, ValueError) as e:
        return 2, {"error": f"{type(e).__name__}: {e}"}
