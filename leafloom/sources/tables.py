"""Scans of parquet tables: projected, tolerant of missing columns, guarded by row counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table of ``folder``, only the given columns; Catalyst prunes the scan to them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*[F.col(f"`{c}`") for c in columns]) if columns else df


def tolerant_table(spark: SparkSession, folder: str, name: str, columns: dict[str, str]) -> DataFrame:
    """Like ``table``; columns (name to type) that the file lacks come out null."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    there = set(df.columns)
    return df.select(*[F.col(c) if c in there else F.lit(None).cast(t).alias(c) for c, t in columns.items()])


def not_empty(df: DataFrame, what: str = "table") -> DataFrame:
    """Fail when the table holds no row; reads at most one row of it."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def guarded(df: DataFrame, rows: int, what: str = "table") -> DataFrame:
    """Fail when the row count is not the expected one."""
    n = df.count()
    if n != rows:
        raise ValueError(f"{what} has {n} rows, not {rows}")
    return df


def split_table(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of the splits with their name in ``split``; columns that a split lacks come out null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no split")
    return out


def one_split(df: DataFrame, split: str) -> DataFrame:
    """The rows of one split; on a table partitioned by ``split`` only its folder is read."""
    return df.filter(F.col("split") == split)


def once_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """Each id once. Deliveries of one id carry the same payload, so any of its rows may stand for it; rows with null id go."""
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key])


#: Columns of ``placed_table`` that tell its rows apart.
PLACE = ["_file", "_row"]


def placed_table(spark: SparkSession, folder: str, name: str, columns: list[str]) -> DataFrame:
    """Columns of a parquet table with the file and the number of each row in it."""
    whole = spark.read.parquet(f"{folder}/{name}.parquet")
    return whole.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
