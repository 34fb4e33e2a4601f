"""How rows spread over contributors: distinct counts, shares, HHI, Gini, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KS = (1, 5, 10, 25, 50, 100)


def counts_of(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def distinct_summary(df: DataFrame, url: str, host: str, root: str, schema: str) -> DataFrame:
    """Rows and distinct URLs, hosts and roots of the web rows, distinct schemas of all rows."""
    web = F.col(root).isNotNull()
    return df.agg(
        F.count("*").alias("rows"), F.count_if(web).alias("web_rows"), F.count_distinct(F.when(web, F.col(url))).alias("urls"),
        F.count_distinct(F.when(web, F.col(host))).alias("hosts"), F.count_distinct(root).alias("roots"), F.count_distinct(schema).alias("schemas"),
    )


def concentration(df: DataFrame, key: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """``metric, value``: shares of the k largest, singletons, median, HHI and Gini.

    The ranking only reaches as far as the largest k and is a top-k; Gini needs the order of equal counts only, so it
    is summed over the histogram of counts (few distinct values) instead of over all contributors.
    """
    counts = counts_of(df, key)
    largest = counts.orderBy(F.desc("n"), key).limit(max(ks)).select("n", F.row_number().over(Window.orderBy(F.desc("n"), key)).alias("k"))
    sums = counts.agg(F.sum("n").alias("total"), F.count("*").alias("contributors"), F.count_if(F.col("n") == 1).alias("singletons"), F.percentile("n", 0.5).alias("median"))
    top = largest.agg(*[F.sum(F.when(F.col("k") <= k, F.col("n"))).alias(f"top{k}") for k in ks])
    by_n = counts.groupBy("n").agg(F.count("*").alias("m"))
    run = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    by_n = by_n.withColumn("before", F.coalesce(F.sum("m").over(run), F.lit(0)))
    # sum of rank times count: m equal counts take the ranks before + 1 ... before + m
    weighted = by_n.agg(
        F.sum(F.col("n") * (F.col("m") * F.col("before") + F.col("m") * (F.col("m") + 1) / 2)).alias("weighted"), F.sum(F.col("m") * F.col("n") * F.col("n")).alias("squares")
    )
    row = sums.select("*", top.select(F.struct("*")).scalar().alias("t"), weighted.select(F.struct("*")).scalar().alias("w")).select("*", "t.*", "w.*")
    c, t = F.col("contributors"), F.col("total")
    per = F.try_divide  # an empty table has no shares: null
    values = {f"top_{k}_share": per(F.col(f"top{k}"), t) for k in ks} | {
        "contributors": c.cast("double"), "singletons": F.col("singletons").cast("double"), "singleton_share": per(F.col("singletons"), c), "median_rows": F.col("median").cast("double"),
        "hhi": per(per(F.col("squares"), t), t), "gini": per(2 * F.col("weighted"), c * t) - per(c + 1, c),
    }
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.round(v, 6).alias("value")) for k, v in values.items()])).alias("x")).select("x.*")


def links(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct ``b`` per ``a`` and the other way round: mean, median, maximum, singletons; distinct pairs."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b).distinct()

    def side(x: str) -> DataFrame:
        per = pairs.groupBy(x).agg(F.count("*").alias("n"))
        return per.agg(
            F.lit(x).alias("per"), F.sum("n").alias("pairs"), F.round(F.avg("n"), 6).alias("mean"), F.percentile("n", 0.5).cast("double").alias("median"),
            F.max("n").alias("max"), F.count_if(F.col("n") == 1).alias("singletons"),
        )

    return side(a).unionByName(side(b))


def top_contributors(df: DataFrame, key: str, other: str, n: int = 50) -> DataFrame:
    """The ``n`` largest contributors with share and distinct ``other``; ties by key."""
    x = df.filter(F.col(key).isNotNull())
    per = x.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(other).alias("others"))
    total = x.agg(F.count("*")).scalar()
    return per.orderBy(F.desc("n"), key).limit(n).select(key, "n", F.round(F.col("n") / total, 5).alias("share"), "others")


def tiers(df: DataFrame, key: str, head: int = 10, torso: int = 100) -> DataFrame:
    """``df`` with ``tier``: head, torso or tail by rank of the contributor (ties by key); no contributor is tail."""
    best = counts_of(df, key).orderBy(F.desc("n"), key).limit(torso)
    ranked = best.select(F.col(key), F.row_number().over(Window.orderBy(F.desc("n"), key)).alias("rank"))
    out = df.join(F.broadcast(ranked), key, "left")
    return out.withColumn("tier", F.when(F.col("rank") <= head, "head").when(F.col("rank") <= torso, "torso").otherwise("tail")).drop("rank")
