"""JSONL and CSV sources."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_corrupt_record"


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One JSON object a line, by an explicit schema; strict fails on a bad line, else it comes out in ``_corrupt_record``."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def good_and_bad(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad lines as ``line``."""
    return df.filter(F.col(BAD).isNull()).drop(BAD), df.filter(F.col(BAD).isNotNull()).select(F.col(BAD).alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, place``: place grows with file name and position, so the last record of a key can be told."""
    lines = spark.read.text(path)
    return lines.select(F.col("value").alias("line"), F.struct(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).alias("place"))


def last_records(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records keyed by ``key``, the last one of each; unreadable lines and lines without key are left out."""
    x = numbered_lines(spark, path).select(F.from_json("line", schema).alias("r"), "place").filter(F.col(f"r.{key}").isNotNull())
    return x.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", "place").alias("r")).select("r.*")


def done_keys(spark: SparkSession, path: str, key: str, kind: str = "bigint") -> DataFrame:
    """The keys that have a record; broken lines don't count."""
    return spark.read.schema(f"{key} {kind}").json(path).select(key).filter(F.col(key).isNotNull()).distinct()


def label_sheet(spark: SparkSession, path: str, allowed: tuple[str, ...], column: str = "verdict") -> DataFrame:
    """A CSV sheet of manual labels, trimmed and lower case, rows with other labels left out."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return df.withColumn(column, F.lower(F.trim(column))).filter(F.col(column).isin(*allowed))


def state(path: str) -> dict:
    """A small JSON state file; {} if there is none."""
    p = Path(path)
    return json.loads(p.read_text()) if p.exists() else {}


def batch_results(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """``idx, content`` of a batch API's output; failed calls and indexes out of range are left out."""
    schema = "custom_id string, error string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>"
    r = spark.read.schema(schema).json(path)
    idx = F.expr("try_cast(element_at(split(custom_id, '::'), -1) as bigint)")
    out = r.filter("error is null and response.status_code = 200").select(idx.alias("idx"), F.col("response.body.choices")[0]["message"]["content"].alias("content"))
    return out.filter(F.col("idx").between(0, rows - 1) & F.col("content").isNotNull())
