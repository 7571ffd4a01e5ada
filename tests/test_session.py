import time

from pyspark.sql import functions as F

from cleanloom.functions import session


def shuffle_files(spark):
    names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    return {x.rpartition("/")[2] for x in names.split() if "/shuffle_" in x}


def test_a_cut_leaves_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(session, "tidy", lambda s: None)  # no collection of garbage helps
    before = shuffle_files(spark)
    t = session.cut(spark.range(5000).groupBy((F.col("id") % 50).alias("k")).count())
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert t.count() == 50 and spark.conf.get(session.CLEANUP, None) is None


def test_a_grown_heap_is_tidied_sooner(spark, monkeypatch):
    monkeypatch.setattr(session, "_tidied", at := time.monotonic() - session.TIDY_FULL - 1)
    monkeypatch.setattr(session, "HEAP_SHARE", 1.0)
    session.tidy(spark)
    assert session._tidied == at
    monkeypatch.setattr(session, "HEAP_SHARE", 0.0)
    session.tidy(spark)
    assert session._tidied > at
