"""Descriptive statistics (A1 to A11, F7, F8): each one aggregate over a pruned scan, the small result reshaped."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions.text import equal_width_bin
from leafloom.operators.quantiles import quantile_rows

QUARTILES = (0.25, 0.5, 0.75)


def _long(df: DataFrame, columns: list[str], parts: dict[str, callable]) -> DataFrame:
    """One global aggregate of ``parts`` over every column, one result row per column."""
    row = df.agg(*[F.struct(*[f(F.col(c)).alias(n) for n, f in parts.items()]).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("s")) for c in columns])).alias("r")).select(
        "r.measure", "r.s.*"
    )


def _stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """``g, v``: the values of all columns below one another, named by their column."""
    cells = F.array(*[F.struct(F.lit(c).alias("g"), F.col(c).cast("double").alias("v")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.g", "x.v")


def _with_percentiles(df: DataFrame, columns: list[str], parts: dict[str, callable], points: dict[str, float], order: list[str]) -> DataFrame:
    q = quantile_rows(_stacked(df, columns), points, "measure")
    rounded = [F.round(F.col(c), 6).alias(c) if c in points else F.col(c) for c in order]
    return _long(df, columns, parts).join(F.broadcast(q), "measure", "left").select("measure", *rounded)  # a row for each column


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A1: count, mean, sample deviation, extremes and quartiles of each column; nulls don't count."""
    d = lambda c: c.cast("double")
    parts = {"n": F.count, "mean": lambda c: F.round(F.avg(d(c)), 6), "std": lambda c: F.round(F.stddev_samp(d(c)), 6), "min": lambda c: F.min(d(c)), "max": lambda c: F.max(d(c))}
    return _with_percentiles(df, columns, parts, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["n", "mean", "std", "min", "p25", "p50", "p75", "max"])


def percentile_table(df: DataFrame, columns: list[str], points: tuple[int, ...] = (25, 50, 75, 90, 95)) -> DataFrame:
    """A2: mean, deviation and the given percentiles."""
    d = lambda c: c.cast("double")
    parts = {"mean": lambda c: F.round(F.avg(d(c)), 6), "std": lambda c: F.round(F.stddev_samp(d(c)), 6)}
    return _with_percentiles(df, columns, parts, {f"p{p}": p / 100 for p in points}, ["mean", "std", *[f"p{p}" for p in points]])


def length_percentiles(df: DataFrame, columns: list[str], points: tuple[int, ...] = (25, 50, 75, 90, 95)) -> DataFrame:
    """Of columns that hold lengths in code points: mean to one place, percentiles cut to whole numbers."""
    parts = {"mean": lambda c: F.round(F.avg(c), 1)}
    for p in points:
        parts[f"p{p}"] = lambda c, p=p: F.percentile(c, p / 100).cast("int")
    return _long(df, columns, parts)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    """A4: rows per value, nulls left out."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, value: str, bins: int = 50, scale: float = 1.0) -> DataFrame:
    """A5: ``bin, n`` of equal-width bins over the range of the column; empty bins are left out."""
    v = df.select((F.col(value) / scale).alias("v")).filter("v is not null")
    lo, hi = v.agg(F.min("v")).scalar(), v.agg(F.max("v")).scalar()
    return v.select(equal_width_bin(F.col("v"), lo, hi, bins).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def top_and_other(df: DataFrame, key: str, n: int, other: str = "Other") -> DataFrame:
    """The ``n`` most frequent values and the rest as one, with shares; ties by value, nulls left out."""
    counts = value_counts(df, key)
    best = counts.orderBy(F.desc("n"), key).limit(n).select(key, F.lit(True).alias("top"))
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.join(F.broadcast(best), key, "left")
        .groupBy(F.when(F.col("top"), F.col(key)).otherwise(other).alias(key)).agg(F.sum("n").alias("n"))
        .withColumn("share", F.round(F.col("n") / total, 6))
    )


def shares(df: DataFrame, key: str, without: tuple[str, ...] = ("unknown",)) -> DataFrame:
    """Rows and percent (two places) per value, some values and nulls left out."""
    counts = value_counts(df.filter(~F.col(key).isin(*without)), key)
    return counts.withColumn("pct", F.round(100 * F.col("n") / counts.agg(F.sum("n")).scalar(), 2))


def group_performance(df: DataFrame, key: str, valid: str, seconds: str, least: int = 100) -> DataFrame:
    """Validity and latency per group of at least ``least`` rows."""
    ok, up = F.col(valid).cast("int"), F.lit(1e-10)  # halves go up whatever the order of the rows
    per = (
        df.filter(F.col(key).isNotNull()).groupBy(key)
        .agg(
            F.count(valid).alias("total_count"), F.sum(ok).alias("valid_count"), F.round(F.avg(ok), 3).alias("valid_rate"),
            F.round(F.avg(seconds) + up, 3).alias("mean_seconds"), F.round(F.stddev_samp(seconds), 3).alias("std_seconds"),
        )
        .filter(F.col("total_count") >= least)
    )
    named = F.col(key).cast("string")
    median = quantile_rows(df.select(named.alias("g"), F.col(seconds).cast("double").alias("v")), {"median": 0.5}, "_key")
    per = per.join(median, named == F.col("_key"), "left")
    return per.select(key, "total_count", "valid_count", "valid_rate", "mean_seconds", F.round(F.col("median") + up, 3).alias("median_seconds"), "std_seconds")


def rate_by_level(df: DataFrame, level: str, flag: str) -> DataFrame:
    """Mean of the flag per level and, with null level, over all; one grouping-sets pass."""
    x = df.filter(F.col(level).isNotNull())
    return x.rollup(level).agg(F.count(flag).alias("n"), F.round(F.avg(F.col(flag).cast("int")), 6).alias("rate"))


def binned_rate(df: DataFrame, label: Column, flag: str) -> DataFrame:
    """Mean of the flag per bin; rows without bin are left out."""
    return df.groupBy(label.alias("bin")).agg(F.count(flag).alias("n"), F.round(F.avg(F.col(flag).cast("int")), 6).alias("rate")).filter("bin is not null")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """A10: Pearson's coefficient of every pair, over the rows where both are there; one aggregate."""
    cells = []
    for a, b in combinations(columns, 2):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.corr(x, y), 6).alias("r")))
    row = df.agg(F.array(*cells).alias("cells"))
    return row.select(F.explode("cells").alias("c")).select("c.*")


def nearest_to_median(df: DataFrame, key: str, chars: str = "chars") -> DataFrame:
    """F8, T4: of the rows whose length lies between the quartiles the one nearest to the median, ties by key."""
    n = df.filter(F.col(chars).isNotNull()).select(key, F.col(chars).alias("chars"))
    q = n.agg(F.percentile("chars", F.array(*map(F.lit, QUARTILES))).alias("q")).scalar()
    x = n.select(key, "chars", q.alias("q"))
    return x.filter((F.col("chars") >= F.col("q")[0]) & (F.col("chars") <= F.col("q")[2])).orderBy(F.abs(F.col("chars") - F.col("q")[1]), key).limit(1).select(key, "chars")


#: Distribution function of the Poisson distribution with mean 1.
_POISSON = np.array([0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518])


def _draws(h: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each row is taken in each replicate, from its hash: the same wherever the row stands."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64)[:, None] + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(np.float64)


def bootstrap_interval(df: DataFrame, value: str, groups: list[str], replicates: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean, number and percentile interval of bootstrap means per group: ``mean, n, lo, hi``.

    Instead of drawing rows for every replicate, each row draws how often it is taken in each (Poisson with mean 1, from
    a hash of row and replicate). A task adds up weights and weighted values in arrays, one pair for each group, and sends
    only these: one pass, whatever the number of rows. Nulls don't count; rows that are equal in all columns draw alike, so keep a key.
    """
    name = F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}) if groups else F.lit("")
    rows = df.filter(F.col(value).isNotNull()).select(name.alias("_set"), F.col(value).cast("double").alias("v"), F.xxhash64(*df.columns).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                g, v = np.array(b.column(0).to_pylist()), b.column(1).to_numpy()
                w = _draws(b.column(2).to_numpy(), replicates, seed)
                for k in np.unique(g):
                    mine = g == k
                    add = np.stack([w[mine].sum(axis=0), v[mine] @ w[mine]])
                    sums[str(k)] = sums[str(k)] + add if str(k) in sums else add
        for k, (w, wv) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * replicates), pa.array(range(replicates), pa.int32()), pa.array(w), pa.array(wv)], names=["_set", "rep", "w", "wv"])

    sums = rows.mapInArrow(run, "_set string, rep int, w double, wv double")
    means = sums.groupBy("_set", "rep").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    ci = means.groupBy("_set").agg(F.percentile("m", tail).alias("lo"), F.percentile("m", 1 - tail).alias("hi"))  # of as many means as replicates
    plain = df.select(*groups, value, name.alias("_set")).groupBy("_set", *groups).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return plain.join(ci, "_set", "left").drop("_set")
