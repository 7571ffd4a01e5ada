import unicodedata

from pyspark.sql import functions as F

from cleanloom.functions.text import WHITE, collapse, digits, fold, fold_py, is_blank, nfc, strip, title

SAMPLES = [None, "", "   ", "  Ali \t", f"{WHITE}x{WHITE}", "a  b", "İSTANBUL Şişli ığüöç", "şehir", "٣12", "Kadıköy/istanbul"]


def test_matches_python(spark):
    df = spark.createDataFrame([(x,) for x in SAMPLES], "x string")
    x = F.col("x")
    for r in df.select("x", strip(x).alias("s"), collapse(x).alias("c"), is_blank(x).alias("b"), fold(x).alias("f"), nfc(x).alias("n"), digits(x).alias("d")).collect():
        v = r.x
        assert r.b == (v is None or v.strip() == "")
        if v is None:
            assert (r.s, r.c, r.f, r.n, r.d) == (None,) * 5
        else:
            assert r.s == v.strip() and r.c == " ".join(v.split()) and r.f == fold_py(v) and r.n == unicodedata.normalize("NFC", v)
            assert r.d == "".join(c for c in v if c.isdecimal())


def test_title(spark):
    assert spark.createDataFrame([("kadıköy/istanbul ALİ",)], "x string").select(title(F.col("x"))).first()[0].startswith("Kadıköy/Istanbul A")
