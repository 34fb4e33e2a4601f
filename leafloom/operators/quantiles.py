"""Exact percentiles of any number of distinct values without a task that holds them all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.session import cut_lineage


def quantiles(values: DataFrame, points: list[float]) -> dict[str, list[float]]:
    """Linearly interpolated percentiles of ``v`` (double) for each ``g`` (string): one number for each of ``points``.

    Equal values are counted together first, combined map-side. A range sort of these counts and their sums per partition
    give the rank at which each partition starts; every partition then hands out only the values at the ranks asked for.
    The number of groups must be bounded: partitions + groups rows go to the driver. Nulls don't count; NaN is greater
    than all.
    """
    counts = values.filter("g is not null and v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    ordered = cut_lineage(counts.repartitionByRange("g", "v").sortWithinPartitions("g", "v").select("g", "v", "n", F.spark_partition_id().alias("p")))
    start: dict[tuple[int, str], int] = {}
    total: dict[str, int] = {}
    for r in sorted(ordered.groupBy("p", "g").agg(F.sum("n").alias("n")).collect(), key=lambda r: r.p):
        start[(r.p, r.g)] = total.get(r.g, 0)
        total[r.g] = total.get(r.g, 0) + r.n
    ranks = {g: np.array(sorted({f((n - 1) * x) for x in points for f in (math.floor, math.ceil)})) for g, n in total.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto: dict[tuple[int, str], int] = {}
        for b in batches:
            groups, v, n, p = np.array(b.column(0).to_pylist()), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            out: list[tuple[str, int, float]] = []
            for key in {(int(q), str(g)) for q, g in zip(p, groups)}:
                mine = np.flatnonzero((groups == key[1]) & (p == key[0]))
                ends = upto.get(key, start[key]) + np.cumsum(n[mine])
                wanted = ranks[key[1]]
                wanted = wanted[(wanted >= ends[0] - n[mine[0]]) & (wanted < ends[-1])]
                out += [(key[1], int(r), float(v[mine[i]])) for r, i in zip(wanted, np.searchsorted(ends, wanted, side="right"))]
                upto[key] = int(ends[-1])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.float64()))], names=["g", "rank", "v"])

    at = {(r.g, r.rank): r.v for r in ordered.mapInArrow(run, "g string, rank bigint, v double").collect()}
    found: dict[str, list[float]] = {}
    for g, n in total.items():
        found[g] = []
        for x in points:
            place = (n - 1) * x
            low, high = math.floor(place), math.ceil(place)
            found[g].append(at[(g, low)] if low == high else (high - place) * at[(g, low)] + (place - low) * at[(g, high)])
    return found


def quantile_rows(values: DataFrame, points: dict[str, float], key: str) -> DataFrame:
    """The same as a small table: ``key`` and a column for each of ``points``."""
    found = quantiles(values, list(points.values()))
    return values.sparkSession.createDataFrame([(g, *q) for g, q in sorted(found.items())], f"`{key}` string, " + ", ".join(f"`{c}` double" for c in points))
