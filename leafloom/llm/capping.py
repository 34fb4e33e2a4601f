"""Problem 5: at most a given share of records per contributor, the best by score stay.

Only contributors above the cap can lose rows, and fewer than N / cap contributors can exceed it; so these few are
found by a count with map-side combine, and only their rows are sorted: one global range sort by contributor, falling
score and id. The counts of the sorted partitions, summed up, turn the index inside a partition into an exact global
position; less the start of the contributor this is the rank. A contributor may spread over any number of partitions,
so no task holds a whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions.urls import last_two_labels
from leafloom.operators.joining import join_counted
from leafloom.operators.ranking import rank_in_groups
from leafloom.session import cut_lineage


def beyond_cap(rows: DataFrame, contributor: str, cap: int, score: str, key: str) -> DataFrame:
    """The keys that must go so that no ``contributor`` keeps more than ``cap`` rows: one column, ``key``.

    Higher ``score`` stays first, null and NaN below every score, ties by ascending ``key``. Rows with null contributor
    are never capped. ``key`` must be unique and not null. An empty table gives an empty result.
    """
    if cap < 1:
        raise ValueError("cap must be 1 or more")
    rows = rows.select(F.col(key).alias("k"), F.col(contributor).alias("c"), F.when(~F.isnan(score), F.col(score)).alias("s")).filter("c is not null")
    over = rows.groupBy("c").count().filter(F.col("count") > cap).select("c")
    # fewer than N / cap rows: at a cap of 2 % at most 50
    hot = join_counted(rows, over, ["c"], "left_semi")
    ranked = rank_in_groups(hot, "c", [F.col("s").desc_nulls_last(), F.col("k")])
    return ranked.filter(F.col("rank") >= cap).select(F.col("k").alias(key))


def cap_contributors(raw: DataFrame, quality: DataFrame, percent: float = 2.0) -> DataFrame:
    """``id, capped_by``: what must go by the domain of ``source`` and then, among the rest, by ``schema_hash``.

    The cap is ``percent`` of the number of distinct ids, rounded down, at least 1. The score of an id is its latest
    one. Null ids are no rows; blank sources have no domain; other columns of both tables are ignored.
    """
    ids = raw.select("id", last_two_labels(F.col("source")).alias("domain"), "schema_hash").filter("id is not null").dropDuplicates(["id"])
    best = quality.groupBy("id").agg(F.max_by("quality", F.struct("scored_at", "quality")).alias("quality"))
    scored = cut_lineage(ids.join(best, "id", "left"))
    cap = max(1, int(scored.count() * percent // 100))
    first = cut_lineage(beyond_cap(scored, "domain", cap, "quality", "id"))
    rest = scored.join(first, "id", "left_anti")
    second = beyond_cap(rest, "schema_hash", cap, "quality", "id")
    return first.withColumn("capped_by", F.lit("source")).unionByName(second.withColumn("capped_by", F.lit("schema_hash")))
