"""Exact ranks inside groups of any size without collecting a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.session import cut_lineage

_INDEX = "monotonically_increasing_id() & ((1L << 33) - 1)"


def rank_in_groups(df: DataFrame, group: str, order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with the 0-based rank of each row in its group, in the given order; ties need a unique last column.

    One global range sort by group and order; the counts of the sorted partitions, summed up, turn the index inside a
    partition into a global position, and less the start of the group it is the rank. The number of groups must be
    bounded: one number per partition and group on it goes to the driver (partitions + groups at most).
    """
    by = [F.col(group), *order]
    sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
    sorted_ = cut_lineage(sorted_.select("*", F.spark_partition_id().alias("_p"), F.expr(_INDEX).alias("_i")))
    per = sorted_.groupBy("_p", group).agg(F.count("*").alias("n"), F.min("_i").alias("i0")).collect()
    size: dict[int, int] = {}
    for r in per:
        size[r._p] = size.get(r._p, 0) + r.n
    before, total = {}, 0
    for p in sorted(size):
        before[p], total = total, total + size[p]
    start: dict = {}
    for r in per:
        start[r[group]] = min(start.get(r[group], total), before[r._p] + r.i0)
    kind = dict(df.dtypes)[group]
    shifts = df.sparkSession.createDataFrame([(r[group], r._p, before[r._p] - start[r[group]]) for r in per], f"`{group}` {kind}, _p int, _shift bigint")
    return sorted_.join(F.broadcast(shifts), [group, "_p"]).withColumn(rank, F.col("_i") + F.col("_shift")).drop("_p", "_i", "_shift")
