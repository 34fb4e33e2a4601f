"""Audit of text fields for secrets: patterns, spans, suppression, matrix.

Every distinct text is scanned once: texts are reduced to digests, one row per digest is scanned, and its spans are
joined back to all cells that hold the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Formats of credentials, then of planted tokens and long card-like numbers.
SECRETS = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "openai_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "stripe_key": r"\b[sr]k_live_[0-9a-zA-Z]{20,}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "slack_token": r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
    "private_key_block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
PLAIN = {"email": r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "url": r"https?://[^ \n\t\"<>)\]}\\]+", "long_number": r"[0-9]{4}(?: ?[0-9]{4}){2,4}"}
SNIPPET = 80
_SPANS = "array<struct<label:string,start:int,stop:int,snippet:string,detector:string>>"
Detector = Callable[[str], list[tuple[str, int, int, str]]]


def pattern_detector(patterns: dict[str, str], label: str | None = None) -> Detector:
    """A detector of all matches of named patterns: (label, start, end, name)."""
    compiled = {n: re.compile(p) for n, p in patterns.items()}

    def find(text: str) -> list[tuple[str, int, int, str]]:
        return [(label or n, *m.span(), n) for n, p in compiled.items() for m in p.finditer(text)]

    return find


def cells(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per text cell: ``key, field, text``; nulls left out."""
    return df.select(F.col(key).alias("key"), *fields).unpivot("key", fields, "field", "text").filter("text is not null")


def spans(found: DataFrame, first: Detector, second: Detector, chunk: int = 100_000, overlap: int = 1_000) -> DataFrame:
    """``key, field, label, start, stop, snippet, detector`` of each cell, sorted by place in each text.

    ``first`` sees texts in chunks with overlap, as a model would, and a span found twice counts once; spans of ``second``
    that lie inside a span of ``first`` are dropped. Texts stay where they are: a task scans a text that it meets again
    only once, and nothing but the findings leaves it.
    """

    def scan(text: str) -> list[dict]:
        step = chunk - overlap
        starts = [0] if len(text) <= chunk else range(0, len(text), step)
        a = {(lab, o + s, o + e, n) for o in starts for lab, s, e, n in first(text[o : o + chunk])}
        b = {x for x in second(text) if not any(s <= x[1] and x[2] <= e for _, s, e, _ in a)}
        return [{"label": lab, "start": s, "stop": e, "snippet": text[s:e][:SNIPPET], "detector": n} for lab, s, e, n in sorted(a | b, key=lambda x: (x[1], x[2], x[0], x[3]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("snippet", pa.string()), ("detector", pa.string())]))
        met: dict[bytes, list[dict]] = {}
        for b in batches:
            at, got = [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if digest not in met:
                    if len(met) > 100_000:  # a cache: texts are scanned again
                        met.clear()
                    met[digest] = scan(text)
                if met[digest]:
                    at.append(i)
                    got.append(met[digest])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(got, kind)], names=["key", "field", "spans"])

    keyed = found.select("key", "field", "text")
    hit = keyed.mapInArrow(run, f"key {dict(keyed.dtypes)['key']}, field string, spans {_SPANS}")
    return hit.select("key", "field", F.explode("spans").alias("s")).select("key", "field", "s.*")


def once(findings: DataFrame) -> DataFrame:
    """U4: findings that differ in the detector only count once; the first by name stays."""
    return findings.groupBy("key", "field", "label", "start", "stop").agg(F.min_by("snippet", "detector").alias("snippet"), F.min("detector").alias("detector"))


def matrix(findings: DataFrame, labels: list[str], fields: list[str]) -> DataFrame:
    """Spans and affected rows of every label and field, zeros included, and ``sum_over_fields`` of the rows."""
    spark = findings.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in fields], "label string, field string")
    counts = findings.groupBy("label", "field").agg(F.count("*").alias("spans"), F.count_distinct("key").alias("rows"))
    out = grid.join(counts, ["label", "field"], "left")
    out = out.select("label", "field", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("rows", F.lit(0)).alias("rows"))
    sums = out.groupBy("label").agg(F.sum("rows").alias("sum_over_fields"))
    return out.join(sums, "label")
