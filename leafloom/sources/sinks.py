"""Sinks (K1 to K7, K9, K10): parquet, CSV, Markdown, JSONL, request files, labelling sheets, per-row files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """K1: zstd parquet, a folder per value of ``by``."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def small_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: a small result as one CSV file with header."""
    df.coalesce(1).write.mode(mode).option("header", "true").option("escape", '"').csv(path)


def markdown(df: DataFrame, order: str | None = None, first: tuple[str, ...] = (), most: int = 1000) -> str:
    """A small result as a Markdown table; rows whose ``order`` value is in ``first`` come first, in that order.

    More than ``most`` rows are refused: a table to read is small, and the driver takes no more.
    """
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    if order:
        place = {v: i for i, v in enumerate(first)}
        rows.sort(key=lambda r: (place.get(r[order], len(place)), str(r[order])))
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """K5: JSON lines, appended."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def requests(df: DataFrame, path: str, rows_per_file: int = 10_000, most_bytes: int = 200_000_000) -> None:
    """K6: request files of at most so many rows; fails if any of a local folder is larger than ``most_bytes``."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)
    p = Path(path)
    large = [f.name for f in p.glob("part-*")] if p.exists() else []
    large = [n for n in large if (p / n).stat().st_size > most_bytes]
    if large:
        raise ValueError(f"files above {most_bytes} bytes: {large}")


def row_files(df: DataFrame, folder: str, name: str, text: str, most: int = 10_000) -> int:
    """K7: one small file per row of an annotation sample and ``manifest.json``; the sample's size is checked."""
    rows = df.select(name, text).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for r in rows:
        (out / f"{r[0]}.json").write_text(r[1] or "")
    (out / "manifest.json").write_text(json.dumps(sorted(str(r[0]) for r in rows)))
    return len(rows)


def label_sheet(df: DataFrame, path: str, column: str = "verdict") -> None:
    """A CSV sheet with an empty column for labels."""
    small_csv(df.withColumn(column, F.lit("")), path)
