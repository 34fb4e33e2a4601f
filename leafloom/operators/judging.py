"""Analytics of judgments: tiers, leaf verdicts, agreement, reweighting."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions.jsontext import NOTHING, find_value
from leafloom.functions.leaves import canon, is_missing, leaves, plain, rooted, strict
from leafloom.functions.text import clipped

TIERS = ("good", "so-so", "reject")


def tier_shares(df: DataFrame, by: list[str], tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """Share of each tier per group; the denominator counts the rows with a tier."""
    t = F.col("tier")
    n = F.greatest(F.count("tier"), F.lit(1))
    return df.groupBy(*by).agg(F.count("tier").alias("n"), *[F.round(F.count_if(t == x) / n, 6).alias(f"{x.replace('-', '_')}_rate") for x in tiers])


def reweighted_shares(df: DataFrame, strata: DataFrame, key: str, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """``tier, weighted_share, covered_weight``: shares per stratum weighted by population; empty strata drop out as they are."""
    w = strata.select(key, (F.col("population") / strata.agg(F.sum("population")).scalar()).alias("w"))
    per = df.filter("tier is not null").groupBy(key).agg(F.array(*[F.struct(F.lit(t).alias("tier"), (F.count_if(F.col("tier") == t) / F.count("*")).alias("share")) for t in tiers]).alias("s"))
    x = per.join(w, key).select("w", F.explode("s").alias("s"))
    return x.groupBy("s.tier").agg(F.round(F.sum(F.col("w") * F.col("s.share")), 6).alias("weighted_share"), F.round(F.sum("w"), 6).alias("covered_weight"))


def agreement(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """``n, agreement, kappa`` of two labellings of the same keys; kappa is null if chance agreement is 1 or n is 0."""
    both = a.select(key, F.col(label).alias("x")).join(b.select(key, F.col(label).alias("y")), key).filter("x is not null and y is not null")
    cells = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    ma = cells.groupBy(F.col("x").alias("t")).agg(F.sum("n").alias("na"))
    mb = cells.groupBy(F.col("y").alias("t")).agg(F.sum("n").alias("nb"))
    pe = ma.join(mb, "t", "full_outer").agg(F.coalesce(F.sum(F.coalesce("na", F.lit(0)) * F.coalesce("nb", F.lit(0))), F.lit(0)).alias("pe"))
    po = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("n"))), F.lit(0)).alias("same"))
    x = po.select("*", pe.scalar().alias("pe"))
    share, chance = F.try_divide("same", "n"), F.try_divide(F.col("pe"), F.col("n") * F.col("n"))
    return x.select(F.col("n"), F.round(share, 6).alias("agreement"), F.round(F.try_divide(share - chance, 1 - chance), 6).alias("kappa"))


def pair_deltas(df: DataFrame, key: str, side: str, before: str, after: str, tiers: tuple[str, ...] = TIERS) -> DataFrame:
    """Rates of pairs whose later side is in a better, worse or the same tier; one conditional aggregate, no self join."""
    rank = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    x = df.groupBy(key).agg(F.max(F.when(F.col(side) == before, rank)).alias("a"), F.max(F.when(F.col(side) == after, rank)).alias("b")).filter("a > 0 and b > 0")
    d = F.col("a") - F.col("b")  # tiers stand from best to worst
    return x.agg(
        F.count("*").alias("n"), F.round(F.try_divide(F.count_if(d > 0), F.count("*")), 6).alias("better_rate"),
        F.round(F.try_divide(F.count_if(d < 0), F.count("*")), 6).alias("worse_rate"), F.round(F.try_divide(F.count_if(d == 0), F.count("*")), 6).alias("same_rate"),
    )


def first_verdicts(df: DataFrame, keys: list[str]) -> DataFrame:
    """The leaf verdicts of each judgment, a repeated leaf key only at its first place."""
    first = F.filter("leaves", lambda x, i: F.array_position(F.transform("leaves", lambda y: y["key"]), x["key"]) == i + 1)
    return df.filter("leaves is not null").select(*keys, F.explode(first).alias("l")).select(*keys, F.col("l.key").alias("leaf"), F.col("l.verdict").alias("verdict"))


def response_leaves(responses: DataFrame, key: str, text: str) -> DataFrame:
    """``key, place, leaf, missing, value, shown``: one row per leaf of the JSON that each text holds, in its order.

    ``value`` is canonical, ``shown`` is the JSON as it stands, empty objects as ``{}``. Texts without JSON have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, t in zip(*(c.to_pylist() for c in b.columns)):
                v = find_value(t)
                if v is NOTHING:
                    continue
                out += [(k, i, p, is_missing(x), canon(x), json.dumps(plain(x), ensure_ascii=False)) for i, (p, x) in enumerate(leaves(rooted(v)).items())]
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "place", "leaf", "missing", "value", "shown"])

    return responses.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").mapInArrow(run, "key string, place int, leaf string, missing boolean, value string, shown string")


def leaf_lines(found: DataFrame, most: int = 60, chars: int = 300) -> DataFrame:
    """``key, lines``: the first ``most`` leaves in the order of the text, one a line, each value cut to ``chars`` and marked."""
    line = F.concat("leaf", F.lit(" = "), clipped(F.col("shown"), chars, "…"))
    per = found.filter(F.col("place") < most).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))).alias("x"))
    return per.select("key", F.array_join(F.transform("x", lambda y: y["line"]), "\n").alias("lines"))


def judge_prompt(template: str, schema: Column, content: Column, lines: Column) -> Column:
    """The judge's prompt: ``{schema}``, ``{content}`` and ``{leaves}`` of the template replaced; null if any value is."""
    values = {"{schema}": schema, "{content}": content, "{leaves}": lines}
    return F.concat(*[values.get(part, F.lit(part)) for part in re.split(r"(\{(?:schema|content|leaves)\})", template)])


#: Verdicts on filled leaves and on leaves that say nothing.
FILLED_VERDICTS = ("supported", "partially_supported", "hallucinated", "wrong_field")
MISSING_VERDICTS = ("correctly_missing", "missed_in_content")


def _placed(judgments: DataFrame, found: DataFrame) -> DataFrame:
    x = judgments.join(found.select(F.col("key").alias("unit_id"), "leaf", "missing"), ["unit_id", "leaf"], "left")
    return x.withColumn("kind", F.when(F.col("missing").isNull(), "unmatched").when(F.col("missing"), "missing").otherwise("filled"))


def leaf_counts(judgments: DataFrame, found: DataFrame) -> DataFrame:
    """Verdicts per judge, apart for filled and missing leaves; verdicts on keys that the response lacks are unmatched.

    ``judgments`` has ``unit_id, judge_model, leaf, verdict``, ``found`` has ``key (= unit_id), leaf, missing``.
    """
    return _placed(judgments, found).groupBy("judge_model", "kind", "verdict").agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("units"))


def leaf_rates(
    judgments: DataFrame, found: DataFrame, units: DataFrame, filled: tuple[str, ...] = FILLED_VERDICTS, missing: tuple[str, ...] = MISSING_VERDICTS, invented: str = "hallucinated",
) -> DataFrame:
    """One row per judge: leaves of each kind, the share of each verdict among the leaves of its kind, the crossover
    rates (a verdict of one kind on a leaf of the other) and the share of ``units`` (``judge_model, unit_id``) with an
    invented leaf. Rates have four places and are 0 where there are no leaves."""
    x = _placed(judgments, found)
    n = {k: F.count_if(F.col("kind") == k) for k in ("filled", "missing", "unmatched")}
    rate = lambda kind, verdicts: F.round(F.count_if((F.col("kind") == kind) & F.col("verdict").isin(*verdicts)) / F.greatest(n[kind], F.lit(1)), 4)
    rates = x.groupBy("judge_model").agg(
        n["filled"].alias("n_filled_leaves"), n["missing"].alias("n_missing_leaves"), n["unmatched"].alias("n_unmatched_leaf_keys"),
        *[rate(k, [v]).alias(f"{k}_{v}_rate") for k, vs in (("filled", filled), ("missing", missing)) for v in vs],
        rate("filled", missing).alias("filled_crossover_rate"), rate("missing", filled).alias("missing_crossover_rate"),
    )
    bad = x.filter((F.col("kind") != "unmatched") & (F.col("verdict") == invented)).select("judge_model", "unit_id").distinct().withColumn("bad", F.lit(1))
    share = units.select("judge_model", "unit_id").distinct().join(bad, ["judge_model", "unit_id"], "left").groupBy("judge_model").agg(
        F.round(F.count("bad") / F.count("*"), 4).alias("units_with_any_hallucination_rate")
    )
    return share.join(rates, "judge_model", "left")


def strict_json(text: str) -> bool:
    """Whether a text is one strict JSON value."""
    try:
        strict(text)
        return True
    except (ValueError, RecursionError):
        return False
