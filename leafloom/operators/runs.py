"""Accounts of model runs over overlapping groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions.text import is_rate_limit, normalized_error

METRICS = ("is_valid_json", "is_schema_compliant", "key_precision", "key_recall", "key_f1", "missing_keys", "extra_keys", "value_score", "overall_bleu")
DEEP, WIDE = 7, 200


def _six(value: Column) -> Column:
    """Six places; halves go up whatever the order in which the rows were summed."""
    return F.round(value + F.lit(1e-10), 6)



def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in ``order`` (nulls first); an aggregate, so no group is sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def in_groups(df: DataFrame, bucket: str = "complexity_bucket", depth: str = "schema_depth", keys: str = "schema_keys") -> DataFrame:
    """Each row once for each of its groups: overall, its bucket, and the deep and wide tails."""
    groups = F.array_compact(F.array(
        F.lit("overall"), F.col(bucket), F.when(F.col(depth) >= DEEP, F.lit(f"depth>={DEEP}")), F.when(F.col(keys) >= WIDE, F.lit(f"keys>={WIDE}")),
    ))
    return df.withColumn("grp", F.explode(groups))


def group_means(df: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Rows, cost, metric means, rejection and fallback rates per group."""
    return in_groups(df).groupBy("model", "grp").agg(
        F.count("*").alias("n"), _six(F.coalesce(F.sum("cost"), F.lit(0.0))).alias("total_cost"), *[_six(F.avg(m)).alias(m) for m in metrics],
        _six(F.avg(F.coalesce(F.col("schema_rejected"), F.lit(False)).cast("int"))).alias("schema_rejected_rate"),
        _six(F.avg(F.when(F.col("structured_mode_used") == "json_schema", 0).otherwise(1))).alias("fallback_rate"),
    )


def rejection_table(df: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """Per group the calls done, rejected by rate limit or schema, accepted; means over all and over accepted; strict rate.

    With the ``planned`` calls also their number per group and the strict rate over it; a group without plan counts what is done.
    """
    rejected = F.coalesce(F.col("schema_rejected"), F.lit(False))
    limit = rejected & is_rate_limit(F.col("api_error"))
    kept = lambda c: F.avg(F.when(~rejected, F.col(c)))
    strict = F.coalesce(F.sum(F.when(~rejected, F.col("is_schema_compliant"))), F.lit(0.0))
    table = in_groups(df).groupBy("model", "grp").agg(
        F.count("*").alias("n_done"), F.count_if(limit).alias("n_rej_ratelimit"), F.count_if(rejected & ~limit).alias("n_rej_schema"), F.count_if(~rejected).alias("n_accepted"),
        _six(F.avg("is_schema_compliant")).alias("compliant_all"), _six(F.avg("key_f1")).alias("key_f1_all"),
        _six(kept("is_schema_compliant")).alias("compliant_accepted"), _six(kept("key_f1")).alias("key_f1_accepted"),
        _six(strict / F.count("*")).alias("e2e_strict_done"), strict.alias("_strict"),
    )
    if planned is None:
        return table.drop("_strict")
    per = in_groups(planned).groupBy("grp").agg(F.count("*").alias("_planned"))
    n = F.coalesce("_planned", "n_done")
    return table.join(per, "grp", "left").select(*[c for c in table.columns if c != "_strict"], n.alias("n_planned"), _six(F.col("_strict") / n).alias("e2e_strict_planned"))


def rejection_causes(df: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent normalised causes of rejected calls, ties by cause."""
    return df.filter("schema_rejected").groupBy(normalized_error(F.col("api_error")).alias("cause")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cause").limit(top)


def rejected_against_accepted(df: DataFrame) -> DataFrame:
    """Mean keys and depth of rejected and accepted calls, nulls left out."""
    return df.groupBy(F.coalesce("schema_rejected", F.lit(False)).alias("rejected")).agg(
        F.count("*").alias("n"), _six(F.avg("schema_keys")).alias("mean_keys"), _six(F.avg("schema_depth")).alias("mean_depth")
    )


def coverage_sensitivity(reference: DataFrame, run: DataFrame) -> DataFrame:
    """The reference's means per group over all its calls and over those that the run completed, with differences."""
    x = in_groups(reference.join(run.select("idx").distinct().withColumn("_c", F.lit(True)), "idx", "left"))
    over = lambda c: F.avg(F.when(F.col("_c"), F.col(c)))
    return x.groupBy("grp").agg(
        F.count("*").alias("n_full"), F.count("_c").alias("n_covered"), _six(F.avg("is_schema_compliant")).alias("compliant_full"),
        _six(over("is_schema_compliant")).alias("compliant_covered"), _six(over("is_schema_compliant") - F.avg("is_schema_compliant")).alias("compliant_delta"),
        _six(F.avg("key_f1")).alias("key_f1_full"), _six(over("key_f1")).alias("key_f1_covered"), _six(over("key_f1") - F.avg("key_f1")).alias("key_f1_delta"),
    ).filter("n_covered > 0")


def validity_and_means(df: DataFrame) -> DataFrame:
    """Validity rates over all rows, metric means over valid and compliant ones only."""
    good = (F.col("is_valid_json") == 1) & (F.col("is_schema_compliant") == 1)
    return df.agg(
        F.count("*").alias("n"), _six(F.avg("is_valid_json")).alias("valid_rate"), _six(F.avg("is_schema_compliant")).alias("compliant_rate"),
        *[_six(F.avg(F.when(good, F.col(m)))).alias(f"mean_{m}") for m in METRICS[2:]],
    )


def outcome_counts(df: DataFrame) -> DataFrame:
    """Calls, failed calls, calls without valid JSON, compliant calls."""
    return df.groupBy("model").agg(
        F.count("*").alias("total"), F.count_if(F.col("is_valid_json").isNull()).alias("failed"), F.count_if(F.col("is_valid_json") == 0).alias("invalid"),
        F.count_if(F.col("is_schema_compliant") == 1).alias("compliant"), F.bool_and(F.col("is_valid_json").isNotNull()).alias("all_completed"),
    )


def still_to_do(planned: DataFrame, done: DataFrame, key: str, retry_errors: bool, error: str = "error") -> DataFrame:
    """Planned rows whose key has no record yet; with ``retry_errors`` failed records don't count."""
    finished = done.filter(F.col(error).isNull()) if retry_errors else done
    return planned.join(finished.select(key).distinct(), key, "left_anti")


def against_gold(predictions: DataFrame, gold: DataFrame, key: str, measure: str) -> DataFrame:
    """``n_gold, n_missing, mean_covered, mean_strict`` of a run against the gold keys; what is missing counts 0 in the last."""
    x = gold.select(key).distinct().join(predictions.select(key, F.col(measure).alias("_m")).dropDuplicates([key]), key, "left")
    return x.agg(
        F.count("*").alias("n_gold"), F.count_if(F.col("_m").isNull()).alias("n_missing"), _six(F.avg("_m")).alias("mean_covered"), _six(F.avg(F.coalesce("_m", F.lit(0.0)))).alias("mean_strict")
    )
