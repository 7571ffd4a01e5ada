"""A synthetic dataset as a whole: built into a folder with ground truth and manifest, and checked there."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanloom.functions.session import cut
from cleanloom.operators import checks, golden
from cleanloom.plans.config import CANONICAL_FIELDS
from cleanloom.sources import sinks

VERSION = "0.1.0"
_RECORD = ["source_record_id", "source_name", *CANONICAL_FIELDS]
EVENT = "corruption_type string, field_name string, before_value string, after_value string, severity string, person_id string, source_record_id string, source_name string"
PAIR = "person_id_a string, person_id_b string, source_record_id_a string, source_record_id_b string, source_name string, pair_type string"


def dataset_tables(spark: SparkSession, people: int, hard: int = 200, seed: int = 42, layout: int = 0) -> dict[str, DataFrame]:
    """All tables of a dataset by name. Parts draw from seeds of their own: source A seed + 1, C seed + 3, hard cases seed + 4, splits 99."""
    base = cut(golden.clean_people(spark, people, seed))
    a, log_a = golden.corrupt(golden.source_records(base, "source_a", "A"), seed + 1)
    b, plain_c = golden.source_b(base, layout, seed), golden.source_c_copies(base, seed)
    c, log_c = golden.source_c(base, seed)
    positives, log_p, positive = golden.hard_positives(base, min(hard, people), seed)
    negatives, negative = golden.hard_negative_records(golden.hard_negatives(base, hard), base)
    records = {"source_a": a, "source_b": b, "source_c": c, "hard_positives": positives, "hard_negatives": negatives}
    owners = reduce(DataFrame.unionByName, (t.select("source_record_id", "person_id") for t in records.values()))
    return {
        "canonical": base.select("person_id", *CANONICAL_FIELDS),
        **records,
        "mappings": owners,
        "duplicate_groups": golden.duplicate_groups(plain_c),
        "pairs": golden.positive_pairs(plain_c).unionByName(positive).unionByName(negative.select(*golden.positive_pairs(plain_c).columns)),
        "corruptions": log_a.unionByName(log_c).unionByName(log_p),
        "splits": golden.person_splits(base),
    }


_FOLDERS = {"canonical": "clean", "source_a": "sources", "source_b": "sources", "source_c": "sources", "hard_positives": "hard_cases", "hard_negatives": "hard_cases", "splits": "splits"}


def build_dataset(spark: SparkSession, output: str, people: int = 10_000, hard: int = 200, seed: int = 42, layout: int = 0) -> Path:
    """Writes the tables, the malformed fixtures, the ground truth, a manifest with hashes and counts, and a data card; all or nothing."""

    def build(out: Path) -> None:
        t = dataset_tables(spark, people, hard, seed, layout)
        for name, folder in _FOLDERS.items():
            columns = [c for c in t[name].columns if c != "person_id"] if name == "source_b" else _RECORD if name in ("source_a", "source_c", "hard_positives", "hard_negatives") else t[name].columns
            sinks.write_csv(t[name], str(out / folder / name), columns)
        for name in ("mappings", "duplicate_groups", "pairs", "corruptions"):
            sinks.write_jsonl(t[name], str(out / "ground_truth" / name))
        (out / "malformed").mkdir()
        for n, b in golden.MALFORMED.items():
            (out / "malformed" / n).write_bytes(b)
        read = lambda n: _read(spark, out, n)
        counts = {f"{n}_records": read(n).count() for n in _FOLDERS if n != "splits"} | {f"{n}": read(n).count() for n in ("duplicate_groups",)}
        counts |= {r.pair_type + "_pairs": r["count"] for r in read("pairs").groupBy("pair_type").count().collect()} | {"corruption_events": read("corruptions").count()}
        by_type = {r.corruption_type: r.event_count for r in golden.corruption_counts(read("corruptions")).collect()}
        (out / "ground_truth" / "summary.json").write_text(json.dumps({"expected_counts": counts}, indent=2) + "\n")
        settings = {"people": people, "hard": hard, "seed": seed, "layout": layout, "profiles": golden.PROFILES}
        card = [f"# Synthetic contacts {VERSION}", "", f"{people} invented persons, seed {seed}. No row describes a real person.", "", "| count | rows |", "|---|---|", *(f"| {k} | {v} |" for k, v in sorted(counts.items()))]
        (out / "DATA_CARD.md").write_text("\n".join(card) + "\n")
        files = [r.asDict() for r in sinks.manifest(spark, str(out)).where("NOT contains(path, '/.') AND NOT startswith(path, '.') AND NOT endswith(path, '_SUCCESS')").orderBy("path").collect()]
        whole = {"version": VERSION, "generated_at": datetime.now(UTC).isoformat(), "seed": seed, "record_count": people, "expected_counts": counts, "corruption_counts": by_type, "files": files, "generation_config": settings}
        (out / "manifest.json").write_text(json.dumps(whole, indent=2, ensure_ascii=False) + "\n")

    return sinks.publish(build, output)


def _read(spark: SparkSession, base: Path, name: str) -> DataFrame:
    if name in _FOLDERS:
        return spark.read.option("header", True).csv(str(base / _FOLDERS[name] / name))
    kinds = {"mappings": "source_record_id string, person_id string", "duplicate_groups": "person_id string, source_record_ids array<string>, source_name string", "pairs": PAIR, "corruptions": EVENT}
    return sinks.read_jsonl(spark, str(base / "ground_truth" / name), kinds[name])


def dataset_issues(spark: SparkSession, dataset: str) -> DataFrame:
    """Every check over a written dataset: (code, severity, subject, detail). Without manifest or ground truth nothing else can be said."""
    base = Path(dataset)
    there = {"manifest": (base / "manifest.json").exists(), "ground_truth": (base / "ground_truth" / "summary.json").exists()}
    if not all(there.values()):
        return checks.missing_parts(spark, there)
    listed = json.loads((base / "manifest.json").read_text(encoding="utf-8"))
    summed = json.loads((base / "ground_truth" / "summary.json").read_text(encoding="utf-8"))
    read = lambda n: _read(spark, base, n)
    counts = lambda d: spark.createDataFrame([(k, int(v)) for k, v in d.items()], "name string, n long")
    files = spark.createDataFrame([(f["path"], f["sha256"]) for f in listed["files"]], "path string, sha256 string")
    mappings, pairs, canonical = read("mappings"), read("pairs"), read("canonical")
    types = spark.createDataFrame([(k, int(v)) for k, v in listed["corruption_counts"].items()], "corruption_type string, event_count long")
    cases = {"hard_positive": "hard_positives", "hard_negative": "hard_negatives"}
    return checks.all_issues(
        checks.files_match(sinks.manifest(spark, dataset), files),
        checks.split_leakage(read("splits")),
        checks.header_is(canonical, ["person_id", *CANONICAL_FIELDS]),
        checks.record_shape(canonical, list(CANONICAL_FIELDS)),
        checks.canonical_people(canonical, list(CANONICAL_FIELDS)),
        checks.source_checks([read(n) for n in ("source_a", "source_b", "source_c")], mappings),
        checks.duplicate_group_checks(read("duplicate_groups"), mappings),
        checks.pair_checks(pairs.where("pair_type NOT IN ('hard_positive', 'hard_negative')")),
        *(checks.hard_case_checks(read(t) if (base / _FOLDERS[t] / t).exists() else None, mappings, pairs, k) for k, t in cases.items()),
        checks.counts_reconcile(golden.corruption_counts(read("corruptions")), types, "corruption_type", "event_count"),
        checks.expected_files(spark, sorted(p.name for p in (base / "malformed").glob("*")), list(golden.MALFORMED)),
        checks.expected_counts(counts(listed["expected_counts"]), counts(summed["expected_counts"])),
    )
