"""Corpus preparation and sampling: caps, chunks, splits, samples."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.functions.text import CAPS, chunk_geometry, chunks, first_reason


def funnel(df: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Rows per first cap that they miss; ``kept`` for the rest."""
    return df.groupBy(first_reason(caps).alias("reason")).agg(F.count("*").alias("n"))


def capped(df: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """the rows within all caps."""
    return df.filter(first_reason(caps) == "kept")


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random order that is the same whatever the partitions."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))


def hash_split(df: DataFrame, key: Column, percent: int, seed: int, small: str = "test", large: str = "train") -> DataFrame:
    """``split`` by a hash of the key; rows with one key stay together."""
    bucket = F.pmod(F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return df.withColumn("split", F.when(bucket < percent, small).otherwise(large))


def prepared(df: DataFrame, seed: int = 42, percent: int = 10, page_level: bool = False) -> DataFrame:
    """The preparation pipeline: caps, then chunks of content with schema and response, then the split.

    ``page_level`` keeps all chunks of a page in one split; the default splits by chunk. No shuffle.
    """
    size, overlap = chunk_geometry()
    out = chunks(capped(df).select("id", "schema", "content", "response"), "content", size, overlap)
    key = F.col("id") if page_level else F.concat_ws("#", "id", "chunk_no")
    return hash_split(out, key, percent, seed).select("id", "chunk_no", "schema", F.col("chunk").alias("content"), "response", "split")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, by hash order; the same rows on every run."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def _turns(amounts: list[int], n: int) -> list[int]:
    """How often each amount is lowered if the greatest one, the first among equals, is lowered ``n`` times by one."""
    heap = [(-a, i) for i, a in enumerate(amounts) if a > 0]
    heapq.heapify(heap)
    out = [0] * len(amounts)
    for _ in range(n if heap else 0):
        a, i = heap[0]
        out[i] += 1
        if a + 1 < 0:
            heapq.heapreplace(heap, (a + 1, i))
        else:
            heapq.heappop(heap)
            if not heap:
                break
    return out


def quotas(sizes: dict[str, int], n: int) -> dict[str, int]:
    """Quotas in proportion to the sizes, one or more each, that sum up to ``n``; all rows if ``n`` isn't below their number.

    Shares are rounded, halves to even. What is too much goes from the greatest quotas, what lacks to the strata with most
    rows left, one by one; ties go to the stratum that comes first by name.
    """
    names, total = sorted(sizes), sum(sizes.values())
    if not 0 < n < total:
        return {k: sizes[k] for k in names}
    share = [max(1, round(n * sizes[k] / total)) for k in names]
    drift = sum(share) - n
    if drift > 0:
        change = [-t for t in _turns(share, drift)]
    else:
        change = _turns([sizes[k] - s for k, s in zip(names, share)], -drift)
    return {k: s + c for k, s, c in zip(names, share, change)}


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int) -> DataFrame:
    """A sample of ``n`` in proportion to the strata (few; their sizes go to the driver)."""
    sizes = {str(r[0]): r[1] for r in df.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("null"))).count().collect()}
    return by_quota(df, key, stratum, quotas(sizes, n), seed)


def by_quota(df: DataFrame, key: str, stratum: str, quota: dict[str, int], seed: int) -> DataFrame:
    """The first rows of each stratum in hash order, as many as its quota; Spark cuts each partition to the quota first."""
    name = F.coalesce(F.col(stratum).cast("string"), F.lit("null"))
    most = max(quota.values(), default=0)
    rank = F.row_number().over(Window.partitionBy(name).orderBy(hash_order(F.col(key), seed), F.col(key)))
    limit = F.lit(0)
    for k, q in quota.items():
        limit = F.when(name == k, q).otherwise(limit)
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= most).filter(F.col("_rank") <= limit).drop("_rank")


def half_short_half_long(quota: int, short: int, long: int) -> tuple[int, int]:
    """How many short and long pages of a stratum; what one side lacks the other fills up."""
    a = min(quota // 2, short)
    b = min(quota - a, long)
    return min(quota - b, short), b


def strata(population: DataFrame, sampled: DataFrame, keys: list[str]) -> DataFrame:
    """Population and sample size of each stratum, 0 where one side has none."""
    p = population.groupBy(*keys).agg(F.count("*").alias("population"))
    s = sampled.groupBy(*keys).agg(F.count("*").alias("sampled"))
    return p.join(s, keys, "full_outer").select(*keys, F.coalesce("population", F.lit(0)).alias("population"), F.coalesce("sampled", F.lit(0)).alias("sampled"))


def with_language(df: DataFrame, key: str, text: str, detect: Callable[[str], str | None]) -> DataFrame:
    """``key, lang``: what ``detect`` says of each text, line ends as spaces; ``unknown`` for null and blank texts and for None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = [(detect(t.replace("\n", " ")) if t and t.strip() else None) or "unknown" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string())], names=[key, "lang"])

    x = df.select(key, text)
    return x.mapInArrow(run, f"`{key}` {dict(x.dtypes)[key]}, lang string")


def calibration(df: DataFrame, key: str, tokens: Column, pool: int = 2048, most_tokens: int = 2048, n: int = 256, seed: int = 42) -> DataFrame:
    """of a sample of ``pool`` rows those with at most ``most_tokens`` tokens, the first ``n`` of them in the sample's order."""
    order = hash_order(F.col(key), seed)
    return sample(df, key, pool, seed).filter(tokens <= most_tokens).orderBy(order, key).limit(n)


def page_quotas(tiers: DataFrame, tier: str, long: str, quota: dict[str, int]) -> dict[str, int]:
    """Quotas of the strata ``tier/short`` and ``tier/long``: half of each tier's quota, filled up from the other side."""
    n = {(r[0], bool(r[1])): r[2] for r in tiers.groupBy(tier, long).count().collect()}  # two rows for each tier
    out: dict[str, int] = {}
    for t, q in quota.items():
        out[f"{t}/short"], out[f"{t}/long"] = half_short_half_long(q, n.get((t, False), 0), n.get((t, True), 0))
    return out


def restricted(df: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """the rows whose key the gold table has."""
    return df.join(gold.select(key).distinct(), key, "left_semi")
