import csv
import datetime
import io

from pyspark.sql import functions as F

from cleanloom.operators import feeds

D = datetime.date
FILES = "file_id long, feed_name string, delimiter string, covers_date date, headers array<string>, line_count int"
LINES = "line_id long, file_id long, row_number int, raw_text string"


def run(spark, files, lines):
    return feeds.parsed_lines(spark.createDataFrame(lines, LINES), spark.createDataFrame(files, FILES))


def test_reasons_and_values(spark):
    files = [(1, "f", None, D(2024, 1, 1), ["ad", "email", "gsm", "kayit_tarihi"], 9)]
    texts = [
        'Ali;a@b.test;0 599 111 22 33;29.02.2024', '"A;li ""x""\nB";a@b.test;;2024-01-31', ";;;", "", '"Ali;a@b.test;0 599 111 22 33;', "Ali;a@b.test", "Ali;a@@b.test;;", "Ali;;12;", "Ali;;;29.02.2023",
        "Ali;;;2024-13-05", '"Ali";"a@b.test";"+90 599 111 2233";"1.1.2024"', None,
    ]
    p = run(spark, files, [(i, 1, i + 2, t) for i, t in enumerate(texts)] + [(0, 1, 2, texts[0])])
    got = {r.line_id: (r.reason_code, r.broken_field) for r in p.collect()}
    reasons = [None, None, "entirely_blank_row", "entirely_blank_row", "unclosed_quote", "inconsistent_column_count", "invalid_value", "invalid_value", "invalid_value", "invalid_value", None, "entirely_blank_row"]
    assert [got[i][0] for i in range(len(texts))] == reasons
    assert got[6][1] == 2 and got[7][1] == 3 and got[8][1] == 4
    loaded = {r.line_id: r.cells for r in feeds.loaded_rows(p).collect()}
    for i, c in loaded.items():
        want = next(csv.reader(io.StringIO(texts[i], newline=""), delimiter=";"))
        assert c == [x or None for x in want]


def test_long_and_odd_texts(spark):
    files = [(1, "f", "|", D(2024, 1, 1), ["ad", "notes"], 2)]
    long = '"' + 'a""b|' * 50_000 + '"'
    p = run(spark, files, [(1, 1, 2, f"x|{long}"), (2, 1, 3, "y|" + "z" * 300_000), (3, 9, 2, "unknown file")])
    assert {r.line_id: r.reason_code for r in p.collect()} == {1: None, 2: None}


def test_drift(spark):
    h = [["ad", "skor", "izin"], ["AD ", "skor", "izin"], ["isim", "skor", "izin"], ["isim", "skor", "gsm"], ["isim", "skor", "gsm"]]
    rows = [["Ali;1;true"], ["Ali;2;false"], ["Ali;3;true"], ["Ali;4.5;0 599 111 22 33"], ["Ali;7;"]]
    files = [(i, "f", ";", D(2024, 1, i + 1), hs, 1) for i, hs in enumerate(h)] + [(9, "g", ";", None, ["ad"], 0)]
    lines = [(i, i, 2, t[0]) for i, t in enumerate(rows)]
    p = run(spark, files, lines)
    s = feeds.file_schemas(spark.createDataFrame(files, FILES), p)
    got = {(r.file_id, r.change_type, r.header) for r in feeds.schema_changes(s).collect()}
    assert got == {(2, "renamed", "isim"), (3, "added", "gsm"), (3, "removed", "izin"), (3, "type_changed", "skor"), (4, "type_changed", "skor")}
    types = feeds.unified_types(s)
    assert types["score"] == "decimal" and types["consent"] == "true/false"
    t = feeds.unified_table(p, types)
    assert t.count() == 5 and dict(t.dtypes)["score"] == "decimal(38,6)" and t.where("first_name = 'Ali'").count() == 5


def test_unknown_headers_by_content(spark):
    files = [(1, "f", ";", D(2024, 1, 1), ["contact", "alan_1", "ad"], 3)]
    p = run(spark, files, [(i, 1, i + 2, f"u{i}@x.test;{n};{n}") for i, n in enumerate(["Ali", "Veli", "Can"])])
    assert p.select("fields").first()[0] == ["email", "first_name", "first_name"]


def test_empty(spark):
    p = run(spark, [], [])
    assert p.count() == 0 and feeds.rejected_rows(p).count() == 0
    assert feeds.schema_changes(feeds.file_schemas(spark.createDataFrame([], FILES), p)).count() == 0


def test_promote():
    assert feeds.promote(["whole number", "decimal"]) == "decimal" and feeds.promote(["date", "decimal"]) == "text" and feeds.promote(["date"]) == "date"
