from cleanloom.plans.benchmarks import valid_record
from cleanloom.plans.config import CANONICAL_FIELDS
from cleanloom.streaming.quality_stream import write_issues


def test_stream(spark, tmp_path):
    schema = "row_number int, " + ", ".join(f"{f} string" for f in CANONICAL_FIELDS)
    r = valid_record(email="x")
    spark.createDataFrame([(1, *(r[f] for f in CANONICAL_FIELDS))], schema).write.parquet(str(tmp_path / "in"))
    q = write_issues(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert [x.rule_id for x in spark.read.parquet(str(tmp_path / "out")).collect()] == ["email.syntax"]
