"""Joins that broadcast a side only after its rows have been counted, and repeated keys dropped without moving the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.session import cut_lineage


def join_counted(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", most_rows: int = 300_000) -> DataFrame:
    """``big`` joined with a side of narrow rows that may or may not be small.

    The side is written once and counted: up to ``most_rows`` it is broadcast and ``big`` isn't shuffled; beyond, both are
    shuffled. The result is the same.
    """
    small = cut_lineage(small)
    return big.join(F.broadcast(small) if small.count() <= most_rows else small, on, how)


def first_of_each(rows: DataFrame, key: str, place: list[str]) -> DataFrame:
    """One row for each ``key``, the first by ``place`` (columns that tell every row from all others, as file and number).

    Only keys and places are shuffled. The places of the other rows, few where repeats are few, are taken out by a counted
    join, so wide rows stay where they are unless the repeats are many. Null keys are no rows.
    """
    rows = rows.filter(F.col(key).isNotNull())
    narrow = rows.select(key, F.struct(*place).alias("_at"))
    again = narrow.groupBy(key).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(key, "_first")
    others = narrow.join(again, key).filter("_at <> _first").select("_at.*")
    return join_counted(rows, others, place, "left_anti")
