"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "cleanloom", cores: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests, bench and command line; on a cluster the submitting side makes the session."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where the session names none and runs on this machine alone, as in tests."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if have is None:
        have = spark.sparkContext.getCheckpointDir()
    if have is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        have = tempfile.mkdtemp(prefix="cleanloom-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(have)
    return have


#: Seconds that lie between two collections of garbage at least, and while the driver's heap takes more than HEAP_SHARE of what it may.
TIDY_EVERY, TIDY_FULL, HEAP_SHARE = 30.0, 5.0, 0.4
_tidied = 0.0


def tidy(spark: SparkSession) -> None:
    """Lets the driver give back what plans that nothing refers to any more have left: broadcast tables, states of stages, and heap."""
    global _tidied
    heap = spark.sparkContext._jvm.Runtime.getRuntime()
    full = heap.totalMemory() > HEAP_SHARE * heap.maxMemory()
    if time.monotonic() - _tidied < (TIDY_FULL if full else TIDY_EVERY):
        return
    _tidied = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Spark's switch for deleting the shuffle files of a plan as soon as it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of plans that run in here go when the plan ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


_WRITTEN: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in a table in the shared folder, so that a lost executor costs a read and not the whole history.

    The files are columnar and compressed, and later reads take only the columns they need. They go when the process ends.
    """
    spark = df.sparkSession
    home = checkpoint_dir(spark).rstrip("/")
    path = f"{home}/cleanloom-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_drop_written)
    _WRITTEN.append((spark, path))
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a lookup table up to which it is sent to every executor; beyond that the join shuffles.
LOOKUP_BYTES = 16 * 2**20
#: Bytes that a row of it takes besides its values.
ROW_BYTES = 64


def row_bytes(df: DataFrame) -> Column:
    """What a row takes: its texts, alone or in arrays, eight bytes for every other value."""
    out = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "array", "struct", "map"):
            text = c if f.dataType.typeName() == "string" else F.array_join(c, "12345678") if f.dataType.simpleString() == "array<string>" else F.to_json(c)
            out = out + F.coalesce(F.octet_length(text), F.lit(0))
        else:
            out = out + 8
    return out


def lookup(df: DataFrame, most: int = LOOKUP_BYTES, written: bool = False) -> DataFrame:
    """Written (unless it is already) and measured: marked for broadcast only if its bytes are few, else left to a shuffling join."""
    c = df if written else cut(df)
    return F.broadcast(c) if c.select(F.coalesce(F.sum(row_bytes(c)), F.lit(0))).first()[0] <= most else c


def is_broadcast(df: DataFrame) -> bool:
    """Whether lookup() found the table small enough."""
    return df._jdf.queryExecution().logical().nodeName() == "ResolvedHint"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Deletes the table behind what cut() gave, once nothing will read it again."""
    for f in df.inputFiles():
        parent = f.rsplit("/", 1)[0]
        if "/cleanloom-" in parent:
            _delete(df.sparkSession, parent)
            return


def _drop_written() -> None:
    """Deletes all cut tables, on whatever file system they lie; of a session that has ended only local ones can still be reached."""
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a context; needed where it isn't on their path."""
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_cleanloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    home = tempfile.mkdtemp(prefix="cleanloom-")  # on the driver only, whose file server hands it out
    path = Path(home) / "cleanloom_package.zip"
    path.write_bytes(body.getvalue())
    sc.addPyFile(str(path))
    sc._cleanloom_shipped = True
