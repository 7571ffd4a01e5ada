import itertools
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from cleanloom.operators import checks, evaluation, golden, mapping, normalization, profiling, quality, validation
from cleanloom.plans import benchmarks, dataset, harness
from cleanloom.plans.config import CANONICAL_FIELDS, ConfigError, MappingConfig, QualityConfig, load
from cleanloom.sources import files, sinks

V = benchmarks.valid_record
SCHEMA = "row_number int, " + ", ".join(f"{f} string" for f in CANONICAL_FIELDS)


def records(spark, *rows):
    return spark.createDataFrame([(i, *(r[f] for f in CANONICAL_FIELDS)) for i, r in enumerate(rows, 1)], SCHEMA)


def test_validation_cases(spark):
    m = evaluation.benchmark_metrics(evaluation.validation_benchmark(evaluation.validation_cases(spark))).first()
    assert (m.tp, m.fp, m.fn, m.tn) == (11, 0, 0, 5) and m.f1 == 1.0
    odd = evaluation.validation_cases(spark, [("no.such_rule", True, V()), ("email.syntax", True, V()), ("required.missing", False, V(city=None))])
    got = [(r.outcome, r.failure_kind) for r in evaluation.validation_benchmark(odd).orderBy("case_id").collect()]
    assert got == [("ERROR", "RULE_ERROR"), ("FN", "FALSE_NEGATIVE"), ("FP", "FALSE_POSITIVE")]


def test_wide_and_long_forms_agree(spark):
    df = records(spark, V(), V(first_name="  x  ", city="Ankara", phone="5"), V(email=None, address="12", company="A"), V(first_name="a" * 200), V())
    df = df.withColumn("row_number", F.least("row_number", F.lit(4)))  # two records with one key stay two
    wide = [sorted((i.rule_id, i.field_name, i.severity, i.value) for i in r.issues) for r in validation.rows_with_issues(df).collect()]
    long = validation.issues(df).select("rule_id", "field_name", "severity", "value").collect()
    assert sorted(x for w in wide for x in w) == sorted((r.rule_id, r.field_name, r.severity, r.value) for r in long) and len(wide) == 5
    s = validation.validation_summary(df).first()
    assert s.record_count == 5 and sum(s.issues_by_rule.values()) == len(long) == sum(s.issues_by_field.values())
    n = {(r.row_number, r.first_name, r.phone) for r in normalization.normalize_records(df).collect()}
    assert (2, "x", "5") in n and len(n) == 5
    assert "Exchange" not in validation.record_results(df)._jdf.queryExecution().executedPlan().toString()


def test_three_rows(spark):
    df = records(
        spark,
        V(first_name="  Ali  ", email=" ALI@EXAMPLE.COM ", phone="05321234567", company="Acme A.S.", city="istanbul", district="kadikoy", address="Bağdat  Caddesi"),
        V(first_name="Ayşe", last_name="Demir", city="Ankara", district="Çankaya"),
        V(first_name="", last_name="Kaya", email="broken@@example.com", phone="abc-phone"),
    )
    out = {r.row_number: r for r in quality.quality_records(df).collect()}
    a = out[1]
    assert (a.first_name, a.city, a.district, a.phone, a.company, a.email, a.address) == ("Ali", "İstanbul", "Kadıköy", "+905321234567", "Acme A.Ş.", "ALI@example.com", "Bağdat Caddesi")
    assert a.is_valid and out[2].is_valid and out[2].changed_field_count == 0 and out[3].first_name == "" and not out[3].is_valid
    again = normalization.normalize_records(normalization.normalize_records(df).drop("changed_field_count", "transformations")).agg(F.sum("changed_field_count")).first()[0]
    assert again == 0
    t = {(r.field_name, r.rule_id) for r in normalization.transformations(df).where("row_number = 1").collect()}
    assert {("first_name", "text.trim_whitespace"), ("email", "email.trim"), ("email", "email.lower_domain"), ("phone", "phone.tr_e164"), ("address", "text.collapse_whitespace")} <= t


@pytest.mark.parametrize("phone", ["05321234567", "5321234567", "+905321234567", "90 532 123 45 67", "(0532) 123-45-67"])
def test_phones(spark, phone):
    assert normalization.normalize_records(records(spark, V(phone=phone))).first().phone == "+905321234567"


def test_suffix_takes_the_letters_at_the_end(spark):
    assert normalization.normalize_records(records(spark, V(company="ATLAS"))).first().company == "ATLA.Ş."


def test_empty_and_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert validation.issues(empty).count() == 0 and quality.quality_records(empty).count() == 0
    odd = spark.range(2).withColumn("row_number", F.col("id")).withColumn("phone", F.lit(5)).withColumn("value", F.lit("clash"))
    assert validation.issues(odd).where("rule_id = 'type.string'").count() == 2


def test_disabled_rule_leaves_the_plan(spark):
    df = validation.issues(records(spark, V(email="x")), QualityConfig(disabled=frozenset({"email.syntax"})))
    assert df.where("rule_id = 'email.syntax'").count() == 0


def test_rules_stay_in_the_jvm(spark):
    assert "ArrowEvalPython" not in validation.issues(records(spark, V()))._jdf.queryExecution().toString()


def test_profile(spark):
    df = spark.createDataFrame([(1, "1", "a@b.test"), (2, "2", " "), (3, None, "x")], "n int, a string, b string")
    p = {r.name: r for r in profiling.column_profiles(df, ["n"], columns=["a", "b"]).collect()}
    assert (p["a"].row_count, p["a"].null_count, p["a"].unique_count, p["a"].type_inference.inferred_type) == (3, 1, 2, "integer")
    assert (p["b"].blank_count, p["b"].non_null_count, p["b"].sample_values) == (1, 2, ["a@b.test", "x"])
    e = profiling.column_profiles(df.limit(0), ["n"], columns=["a"]).first()
    assert e.row_count == 0 and e.completeness_ratio == 0.0 and e.type_inference.note == "no_non_empty_values"


def test_mapping_cases(spark):
    r = evaluation.mapping_benchmark(spark)
    assert [x for x in r.where("outcome <> 'correct'").collect()] == []
    m = evaluation.mapping_metrics(r).first()
    assert (m.cases, m.columns, m.accuracy, m.auto_map_precision, m.review_recall, m.f1, m.passed) == (13, 50, 1.0, 1.0, 1.0, 1.0, True)


def test_layouts_of_source_b(spark):
    m = evaluation.mapping_metrics(harness.layout_results(spark, golden.clean_people(spark, 30), by_file=True)).first()
    assert (m.cases, m.columns, m.correct, m.auto_map_precision) == (3, 34, 34, 1.0)


def test_mapping_failures():
    k = mapping.failure_kind
    assert k("UNMAPPED", None, "AUTO_MAP", "email") == "FALSE_AUTO_MAP" and k("UNMAPPED", None, "REVIEW", "email") is None and k("UNMAPPED", None, "CONFLICT", "email") == "FALSE_UNMAPPED"
    assert k("REVIEW", "email", "AUTO_MAP", "email") == "FALSE_AUTO_MAP" and k("REVIEW", "email", "UNMAPPED", None) == "FALSE_UNMAPPED" and k("REVIEW", "email", "CONFLICT", "email") is None
    assert k("AUTO_MAP", "email", "AUTO_MAP", "phone") == "FALSE_AUTO_MAP" and k("AUTO_MAP", "email", "REVIEW", "email") == "FALSE_REVIEW"
    assert k("AUTO_MAP", "email", "UNMAPPED", None) == "MISSED_MAPPING" and k("AUTO_MAP", "email", "CONFLICT", "email") == "COLLISION" and k("AUTO_MAP", "email", "AUTO_MAP", "email") is None
    assert mapping.label_outcome("CONFLICT", "email", "AUTO_MAP", "email") == "incorrect" and mapping.label_outcome("REVIEW", "email", "UNMAPPED", None) == "missed"


def test_header_form_and_config():
    assert [mapping.normalize_header(h) for h in ("şirket", "ilçe", "İL", " E-Posta ")] == ["irket", "il_e", "i_l", "e_posta"]
    with pytest.raises(ConfigError):
        MappingConfig(thresholds={**MappingConfig().thresholds, "review": 1}).check()
    assert load(QualityConfig).required == CANONICAL_FIELDS


def test_malformed_files(spark, tmp_path):
    for n, b in golden.MALFORMED.items():
        (tmp_path / n).write_bytes(b)
    bad = evaluation.ingestion_checks(spark, str(tmp_path)).where("NOT passed").collect()
    assert bad == []
    (tmp_path / "tr.csv").write_bytes("ad,sehir\nŞule,İzmir\n\n \n".encode("cp1254"))
    d = files.parse_file(spark, str(tmp_path / "tr.csv"))
    assert d.facts.encoding == "cp1254" and d.accepted.first().sehir == "İzmir"
    assert sorted(r.reason_code for r in d.rejected.collect()) == ["entirely_blank_row"] * 2
    assert d.accounting().first().source_rows == 3
    with pytest.raises(files.IngestionError, match="file_not_found"):
        files.parse_file(spark, str(tmp_path / "none.csv"))


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cells = lambda r, xs: f'<row r="{r}">' + "".join(f'<c r="{chr(65 + i)}{r}" t="inlineStr"><is><t>{x}</t></is></c>' for i, x in enumerate(xs) if x) + "</row>"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells(1, ['ad', 'soyad'])}{cells(2, [' Ali '])}{cells(4, ['a', 'b', 'c'])}</sheetData></worksheet>")
    d = files.parse_file(spark, str(tmp_path / "b.xlsx"))
    assert [tuple(r) for r in d.accepted.collect()] == [(2, "Ali", None)]
    assert sorted((r.row_number, r.reason_code) for r in d.rejected.collect()) == [(3, "entirely_blank_row"), (4, "inconsistent_column_count")]


def test_golden(spark):
    p = golden.clean_people(spark, 300)
    assert p.select("email").distinct().count() == 300 == p.select("phone").distinct().count()
    assert checks.passed(checks.canonical_people(p, list(CANONICAL_FIELDS))).first().passed
    rec, log = golden.corrupt(golden.source_records(p, "source_a", "A"), 5)
    assert rec.count() == 300 and log.where("before_value <=> after_value").count() == 0
    assert log.groupBy("source_record_id").count().agg(F.max("count")).first()[0] <= 3
    a, b = rec.repartition(7).orderBy("source_record_id").collect(), rec.coalesce(1).orderBy("source_record_id").collect()
    assert a == b
    assert {r.split: r["count"] for r in golden.person_splits(p).groupBy("split").count().collect()} == {"train": 210, "validation": 45, "test": 45}
    c = golden.source_c_copies(p)
    assert checks.duplicate_group_checks(golden.duplicate_groups(c), c).count() == 0 and checks.pair_checks(golden.positive_pairs(c)).count() == 0
    assert [r.serial for r in c.orderBy("serial").collect()] == list(range(1, c.count() + 1))
    assert checks.pair_checks(golden.hard_negatives(p, 20)).count() == 0


def test_noise_of_source_c_and_hard_positives(spark):
    p = golden.clean_people(spark, 300)
    rec, log = golden.source_c(p)
    kinds = {r.corruption_type for r in log.select("corruption_type").distinct().collect()}
    assert {"typo", "email_corruption", "field_conflict", "missing_value", "duplicate"} <= kinds <= set(golden.SEVERITY)
    plain = {r.source_record_id: r for r in golden.source_c_copies(p).collect()}
    noisy = {r.source_record_id: r for r in rec.collect()}
    e = {(r.source_record_id, r.field_name): r for r in log.where("corruption_type <> 'duplicate'").collect()}
    assert {(i, f) for i, r in noisy.items() for f in CANONICAL_FIELDS if r[f] != plain[i][f]} == set(e)
    assert all((x.before_value, x.after_value) == (plain[i][f], noisy[i][f]) for (i, f), x in e.items()) and max(sum(k[0] == i for k in e) for i in noisy) <= 4
    hard, hard_log, pairs = golden.hard_positives(p, 40)
    assert hard.count() == 80 and pairs.count() == 40 and checks.pair_checks(pairs).count() == 0
    assert hard.where("copy = 0 AND email IS NULL").count() == 0 and hard.where("copy = 1 AND email IS NULL").count() > 5 and hard_log.count() > 100
    assert golden.hard_positives(p.limit(0), 5)[0].count() == 0


def test_typos_hit_the_next_key(spark):
    d = spark.range(40).select(golden.corrupted(F.lit("typo"), F.lit("city"), F.lit("ankara"), F.col("id") * 7919).alias("v"))
    got = {r.v for r in d.collect()}
    assert len(got) > 3 and all(sum(a != b for a, b in zip(g, "ankara")) == 1 for g in got) and len(golden.TYPO_FROM) == len(golden.TYPO_TO)


@pytest.mark.parametrize("count", [5, 60, 400])
def test_hard_negatives_are_the_most_alike(spark, count):
    p = golden.clean_people(spark, 150)
    like = lambda a, b: round(sum(w for f, w in golden.LIKENESS.items() if a[f] == b[f]) + golden.FIRST_LETTERS * (a.first_name[:2] == b.first_name[:2]), 2)
    best = {frozenset((a.person_id, b.person_id)): like(a, b) for a, b in itertools.combinations(p.collect(), 2)}
    got = {frozenset((r.person_id_a, r.person_id_b)): r.likeness for r in golden.hard_negatives(p, count).collect()}
    assert len(got) == count and all(best[k] == v for k, v in got.items())
    assert sorted(got.values()) == sorted(best.values())[-count:]


def test_too_few_hard_negatives_are_an_error(spark):
    with pytest.raises(ValueError):
        golden.hard_negatives(golden.clean_people(spark, 3), 200)


def test_checks_and_gates(spark):
    s = spark.createDataFrame([("A-1",), ("A-1",), (None,), ("A-2",)], "source_record_id string")
    m = spark.createDataFrame([("A-1", "P-000001")], "source_record_id string, person_id string")
    codes = {r.code for r in checks.source_checks([s], m).collect()}
    pair = spark.createDataFrame([("P-1", "P-1", "A-1", "B-9", "hard_negative"), ("P-1", "P-2", "A-2", "A-1", "hard_positive")], "person_id_a string, person_id_b string, source_record_id_a string, source_record_id_b string, pair_type string")
    found = {r.code for r in checks.hard_case_checks(s.withColumn("person_id", F.lit("P-1")), m, pair, "hard_negative").collect()}
    assert found == {"missing_source_record_id", "duplicate_source_record_id", "unmapped_hard_case_record", "missing_hard_negative_record", "invalid_hard_negative", "ground_truth_leakage"}
    assert [r.code for r in checks.hard_case_checks(None, m, pair, "hard_positive").collect()] == ["missing_hard_cases_csv"]
    assert {r.code for r in checks.hard_case_checks(s.where("source_record_id = 'A-2'"), m, pair, "hard_positive").collect()} == {"unmapped_hard_case_record", "missing_hard_positive_record", "invalid_hard_positive"}
    assert {r.subject for r in checks.record_shape(spark.createDataFrame([("x",)], "person_id string"), ["email"]).collect()} == {"email", "x"}
    n = lambda **k: spark.createDataFrame(list(k.items()), "name string, n long")
    assert [r.subject for r in checks.expected_counts(n(a=1, b=2, c_records=3), n(a=1, b=3, c_records=9)).collect()] == ["b"]
    assert codes == {"missing_source_record_id", "duplicate_source_record_id", "unmapped_source_record"}
    with pytest.raises(KeyError):
        evaluation.hard_gates(spark.createDataFrame([("x", 1.0)], "metric string, value double"))
    with pytest.raises(ValueError):
        evaluation.hard_gates(spark.createDataFrame([("x", 1.0)], "metric string, value double"), {"x": ("eq", 1.0)})


def test_normalization_benchmark(spark):
    e = spark.createDataFrame([("whitespace", "first_name", "Ali", "  Ali  "), ("phone_format", "phone", "+905321234567", "05321234567"), ("typo", "first_name", "Ali", "Al1")], "corruption_type string, field_name string, before_value string, after_value string")
    r = evaluation.normalization_accuracy(evaluation.normalization_benchmark(e)).first()
    assert (r.expected, r.correct, r.skipped, r.accuracy) == (2, 2, 1, 1.0)


def test_sinks(spark, tmp_path):
    sinks.publish(lambda p: (p / "a.txt").write_text("x"), str(tmp_path / "out"))
    with pytest.raises(RuntimeError):
        sinks.publish(lambda p: (_ for _ in ()).throw(RuntimeError()), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a.txt").exists() and not (tmp_path / "out.tmp").exists()
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "j").glob("part*.json")))["b"] is None
    assert sinks.manifest(spark, str(tmp_path / "out")).first().size_bytes == 1
    assert sinks.write_report({"rows": [{"a": 1}]}, str(tmp_path / "r"), "quality_report", True).exists()


def test_dataset_and_harness(spark, tmp_path):
    home = dataset.build_dataset(spark, str(tmp_path / "set"), people=120, hard=10)
    assert [tuple(r) for r in dataset.dataset_issues(spark, str(home)).collect()] == []
    code, report = harness.run_evaluation(spark, str(tmp_path / "report"), str(home), str(home / "malformed"))
    assert code in (0, 1) and report["evaluation_mode"] == "MIXED" and report["schema_mapping_benchmark"]["accuracy"] == 1.0 and report["normalization_benchmark"]["expected"] > 0
    assert {g["metric"] for g in report["hard_gates"]} == set(harness.MEASURED) and (tmp_path / "report" / "report.md").exists()
    assert (code == 0) == all(g["passed"] for g in report["hard_gates"]) == (report["overall_status"] == "PASS")
    (home / "malformed" / "header_only.csv").write_bytes(b"x\n1\n")
    assert harness.run_evaluation(spark, fixtures=str(home / "malformed"))[0] == 1
    found = {r.code for r in dataset.dataset_issues(spark, str(home)).collect()}
    assert found == {"hash_mismatch"} and harness.run_evaluation(spark, dataset=str(home))[0] == 1
    (home / "manifest.json").unlink()
    assert [r.code for r in dataset.dataset_issues(spark, str(home)).collect()] == ["missing_manifest"]
    assert harness.run_evaluation(spark, gates={"candidate_recall": ("gte", 0.94)})[0] == 2


def test_cases_from_files(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"case_id": "x", "headers": ["ad"], "rows": [["Ali"]], "expected": {"ad": {"canonical_field": "first_name", "decision": "AUTO_MAP"}}}]))
    assert harness.mapping_cases(str(tmp_path / "m.json"))[0]["expected"] == {"ad": ("AUTO_MAP", "first_name")}
    (tmp_path / "v.json").write_text(json.dumps([{"case_id": "x", "target_rule": "email.syntax", "should_fire": True, "record": {"email": "x"}}]))
    assert harness.validation_case_rows(str(tmp_path / "v.json"))[0][:2] == ("email.syntax", True)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        harness.read_cases(str(tmp_path / "bad.json"))
