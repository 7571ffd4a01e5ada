"""Writers of tables and reports."""

from __future__ import annotations

import json
import shutil
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Only the named columns, with a header; nulls are empty."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_jsonl(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def report_rows(df: DataFrame, most: int = 10_000) -> list[dict]:
    """The rows of a small table as plain values; a table that isn't small is an error."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    return [json.loads(r) for r in rows]


def write_report(content: dict, directory: str, name: str, markdown: bool = False) -> Path:
    """<name>.json, and <name>.md with a section for each key."""
    out = Path(directory)
    out.mkdir(parents=True, exist_ok=True)
    (out / f"{name}.json").write_text(json.dumps(content, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")
    if markdown:
        lines = [f"# {name.replace('_', ' ')}", ""]
        for k, v in content.items():
            lines += [f"## {k}", ""]
            if isinstance(v, list) and v and isinstance(v[0], dict):
                cols = list(v[0])
                lines += ["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols)]
                lines += ["| " + " | ".join(str(r.get(c, "")).replace("|", "\\|") for c in cols) + " |" for r in v]
            else:
                lines.append(json.dumps(v, ensure_ascii=False, default=str))
            lines.append("")
        (out / f"{name}.md").write_text("\n".join(lines), encoding="utf-8")
    return out / f"{name}.json"


def publish(build: Callable[[Path], None], target: str) -> Path:
    """Builds in a folder beside the target and swaps it in when all is written; on an error nothing is left."""
    out = Path(target)
    staging = out.with_name(out.name + ".tmp")
    shutil.rmtree(staging, ignore_errors=True)
    staging.mkdir(parents=True)
    try:
        build(staging)
        if out.exists():
            shutil.rmtree(out)
        staging.rename(out)
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    return out


def manifest(spark, directory: str) -> DataFrame:
    """(path, size_bytes, sha256) of every file under a folder."""
    base = Path(directory).resolve().as_uri() + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    return files.select(F.replace(F.regexp_replace("path", "^file:/+", "file:///"), F.lit(base), F.lit("")).alias("path"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
