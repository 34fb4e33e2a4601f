"""Queries over the raw table: descriptive statistics and concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.functions.text import right_closed_bin, score_bucket
from leafloom.functions.urls import REGISTRY_LABELS, host_of, root_domain
from leafloom.operators import concentration, stats
from leafloom.plans.registry import query
from leafloom.sources.tables import once_per_id, table

NUMBERS = ["execution_time", "response_size", "schema_size", "schema_depth", "schema_keys", "schema_elements", "schema_cyclomatic_complexity", "schema_complexity_score"]


def raw(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return once_per_id(table(spark, d, "raw_rows", ["id", *columns]))


def _raw(*columns: str) -> str:
    return f"WITH r AS (SELECT DISTINCT id, {', '.join(columns)} FROM raw_rows WHERE id IS NOT NULL) "


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


_DESCRIBE = _raw(*NUMBERS) + _union([
    f"SELECT '{c}' AS measure, count({c}) AS n, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, min({c})::DOUBLE AS min, "
    f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS p50, round(quantile_cont({c}::DOUBLE, 0.75), 6) AS p75, max({c})::DOUBLE AS max FROM r"
    for c in NUMBERS
])


@query("describe_raw", _DESCRIBE)
def describe_raw(spark, d):
    return stats.describe(raw(spark, d, *NUMBERS), NUMBERS)


FIVE = ["schema_depth", "schema_keys", "schema_elements", "schema_cyclomatic_complexity", "schema_complexity_score"]


@query("percentile_table", _raw(*FIVE) + _union([
    f"SELECT '{c}' AS measure, round(avg({c}::DOUBLE), 6) AS mean, round(stddev_samp({c}::DOUBLE), 6) AS std, " + ", ".join(f"round(quantile_cont({c}::DOUBLE, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 95)) + " FROM r"
    for c in FIVE
]))
def percentile_table(spark, d):
    return stats.percentile_table(raw(spark, d, *FIVE), FIVE)


TEXTS = ["prompt", "content", "schema", "response"]


@query("length_percentiles", _raw(*TEXTS) + _union([
    f"SELECT '{c}' AS measure, round(avg(length({c})), 1) AS mean, " + ", ".join(f"trunc(quantile_cont(length({c}), {p / 100}))::INT AS p{p}" for p in (25, 50, 75, 90, 95)) + " FROM r" for c in TEXTS
]))
def length_percentiles(spark, d):
    # only the lengths are shuffled to count each id once, not the texts
    lengths = table(spark, d, "raw_rows", ["id", *TEXTS]).select("id", *[F.char_length(c).alias(c) for c in TEXTS])
    return stats.length_percentiles(once_per_id(lengths), TEXTS)


@query("depth_counts", _raw("schema_depth") + "SELECT schema_depth, count(*) AS n FROM r WHERE schema_depth IS NOT NULL GROUP BY 1")
def depth_counts(spark, d):
    return stats.value_counts(raw(spark, d, "schema_depth"), "schema_depth")


def _hist(c: str, scale: str = "") -> str:
    return _raw(c) + (
        f", v AS (SELECT {c}{scale} v FROM r WHERE {c} IS NOT NULL), e AS (SELECT min(v) lo, max(v) hi FROM v) "
        "SELECT CASE WHEN hi <= lo THEN 1 ELSE least(floor((v - lo) / ((hi - lo) / 50))::INT + 1, 50) END AS bin, count(*) AS n FROM v, e GROUP BY 1"
    )


for _c, _s, _sql in (("schema_keys", 1.0, " / 1.0"), ("schema_complexity_score", 1.0, " / 1.0"), ("response_size", 1024.0, " / 1024.0"), ("schema_size", 1024.0, " / 1024.0")):
    query(f"histogram_{_c}", _hist(_c, _sql))(lambda spark, d, c=_c, s=_s: stats.histogram(raw(spark, d, c), c, 50, s))


def _top(key: str, n: int) -> str:
    return (
        f"c AS (SELECT {key}, count(*) n FROM r WHERE {key} IS NOT NULL GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, {key}) rn FROM c) "
        f"SELECT CASE WHEN rn <= {n} THEN {key} ELSE 'Other' END AS {key}, sum(n)::BIGINT AS n, round(sum(n) / (SELECT sum(n) FROM c), 6) AS share FROM k GROUP BY 1"
    )


@query("top_models_and_other", _raw("llm_model") + ", " + _top("llm_model", 3))
def top_models(spark, d):
    return stats.top_and_other(raw(spark, d, "llm_model"), "llm_model", 3)


@query("language_mix", "WITH r AS (SELECT regexp_replace(lower(trim(lang)), '[-_].*$', '') lang FROM documents), f AS (SELECT lang, count(*) n FROM r WHERE lang NOT IN ('', 'und', 'unknown') GROUP BY 1) SELECT lang, n, round(100 * n / sum(n) OVER (), 2) AS pct FROM f")
def language_mix(spark, d):
    docs = table(spark, d, "documents", ["lang"]).select(F.regexp_replace(F.lower(F.trim("lang")), "[-_].*$", "").alias("lang"))
    return stats.shares(docs, "lang", ("", "und", "unknown"))


@query("top_languages_and_other", "WITH r AS (SELECT regexp_replace(lower(trim(lang)), '[-_].*$', '') lang FROM documents), " + _top("lang", 5))
def top_languages(spark, d):
    return stats.top_and_other(table(spark, d, "documents", ["lang"]).select(F.regexp_replace(F.lower(F.trim("lang")), "[-_].*$", "").alias("lang")), "lang", 5)


@query("model_performance", _raw("llm_model", "response_is_valid", "execution_time") + (
    "SELECT llm_model, count(response_is_valid) AS total_count, sum(response_is_valid::INT)::BIGINT AS valid_count, round(avg(response_is_valid::INT), 3) AS valid_rate, round(avg(execution_time) + 1e-10, 3) AS mean_seconds, "
    "round(quantile_cont(execution_time, 0.5) + 1e-10, 3) AS median_seconds, round(stddev_samp(execution_time), 3) AS std_seconds FROM r WHERE llm_model IS NOT NULL GROUP BY 1 HAVING count(response_is_valid) >= 100"))
def model_performance(spark, d):
    return stats.group_performance(raw(spark, d, "llm_model", "response_is_valid", "execution_time"), "llm_model", "response_is_valid", "execution_time")


@query("validity_by_depth", _raw("schema_depth", "response_is_valid") + (
    "SELECT schema_depth, count(response_is_valid) AS n, round(avg(response_is_valid::INT), 6) AS rate FROM r WHERE schema_depth IS NOT NULL GROUP BY GROUPING SETS ((schema_depth), ())"))
def validity_by_depth(spark, d):
    return stats.rate_by_level(raw(spark, d, "schema_depth", "response_is_valid"), "schema_depth", "response_is_valid")


EDGES, LABELS = (0, 50, 100, 200, 500, 1000, float("inf")), ("<50", "50-100", "100-200", "200-500", "500-1k", ">1k")


def _bins(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} > {lo} AND {c} <= {'1e308' if hi == float('inf') else hi} THEN '{x}'" for lo, hi, x in zip(EDGES, EDGES[1:], LABELS)) + " END"


for _c in ("schema_complexity_score", "schema_keys"):
    query(f"validity_by_{_c}", _raw(_c, "response_is_valid") + f"SELECT * FROM (SELECT {_bins(_c)} AS bin, count(response_is_valid) AS n, round(avg(response_is_valid::INT), 6) AS rate FROM r GROUP BY 1) WHERE bin IS NOT NULL")(
        lambda spark, d, c=_c: stats.binned_rate(raw(spark, d, c, "response_is_valid"), right_closed_bin(F.col(c), EDGES, LABELS), "response_is_valid")
    )


_BUCKET = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} >= 0 AND {0} < 50 THEN '0-50' WHEN {0} >= 50 AND {0} < 100 THEN '50-100' WHEN {0} >= 100 AND {0} < 200 THEN '100-200' WHEN {0} >= 200 AND {0} < 500 THEN '200-500' WHEN {0} >= 500 AND {0} < 1000 THEN '500-1000' ELSE '1000+' END"


@query("score_buckets", _raw("schema_complexity_score") + f"SELECT {_BUCKET.format('schema_complexity_score')} AS bucket, count(*) AS n FROM r GROUP BY 1")
def score_buckets(spark, d):
    return raw(spark, d, "schema_complexity_score").groupBy(score_bucket(F.col("schema_complexity_score")).alias("bucket")).agg(F.count("*").alias("n"))


_CORR = [*NUMBERS, "response_is_valid"]


@query("correlation_matrix", _raw(*_CORR) + _union([
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}::DOUBLE{'' if a != 'response_is_valid' else ''}, {b}{'::INT' if b == 'response_is_valid' else ''}::DOUBLE), 6) AS r FROM r"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]
]))
def correlation_matrix(spark, d):
    df = raw(spark, d, *_CORR).withColumn("response_is_valid", F.col("response_is_valid").cast("int"))
    return stats.correlations(df, _CORR)


@query("nearest_to_median_page", _raw("content") + (
    ", n AS (SELECT id, length(content) chars FROM r WHERE content IS NOT NULL), q AS (SELECT quantile_cont(chars, 0.25) a, quantile_cont(chars, 0.5) b, quantile_cont(chars, 0.75) c FROM n) "
    "SELECT id, chars FROM n, q WHERE chars BETWEEN a AND c ORDER BY abs(chars - b), id LIMIT 1"))
def nearest_page(spark, d):
    lengths = table(spark, d, "raw_rows", ["id", "content"]).select("id", F.char_length("content").alias("chars"))
    return stats.nearest_to_median(once_per_id(lengths), "id")


def _sources(spark, d, *more: str) -> DataFrame:
    r = raw(spark, d, "source", "schema_hash", *more)
    root = root_domain(F.col("source"))
    return r.select("*", root.alias("root"), F.when(root.isNotNull(), host_of(F.col("source"))).alias("host"))


ROOTS = r"""WITH t AS (SELECT DISTINCT id, source, schema_hash, regexp_replace(source, '^\s+|\s+$', '', 'g') s FROM raw_rows WHERE id IS NOT NULL),
h AS (SELECT id, source, schema_hash, CASE WHEN regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*://') AND NOT regexp_matches(lower(s), '^https?://') THEN NULL
  ELSE lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(s, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''), '\.+$', '')) END host0 FROM t),
r AS (SELECT id, source, schema_hash, CASE WHEN host0 LIKE '%.%' AND NOT regexp_matches(host0, '^\d+\.\d+\.\d+\.\d+$') AND NOT regexp_matches(host0, '[\s:]') THEN host0 END host,
  CASE WHEN host0 LIKE '%.%' AND NOT regexp_matches(host0, '^\d+\.\d+\.\d+\.\d+$') AND NOT regexp_matches(host0, '[\s:]') THEN CASE WHEN regexp_matches(host0, '(^|\.)(""" + "|".join(REGISTRY_LABELS) + r""")\.[a-z]{2}$') THEN nullif(regexp_extract(host0, '([^.]+\.[^.]+\.[^.]+)$', 1), '') ELSE regexp_extract(host0, '([^.]+\.[^.]+)$', 1) END END root FROM h) """


@query("domain_summary", ROOTS + "SELECT count(*) AS rows, count(root) AS web_rows, count(DISTINCT CASE WHEN root IS NOT NULL THEN source END) AS urls, count(DISTINCT host) AS hosts, count(DISTINCT root) AS roots, count(DISTINCT schema_hash) AS schemas FROM r")
def domain_summary(spark, d):
    return concentration.distinct_summary(_sources(spark, d), "source", "host", "root", "schema_hash")


_CONC = ", c AS (SELECT {k} k, count(*) n FROM r WHERE {k} IS NOT NULL GROUP BY 1), o AS (SELECT n, row_number() OVER (ORDER BY n DESC, k) rn, row_number() OVER (ORDER BY n, k) up FROM c), tt AS (SELECT sum(n)::DOUBLE total, count(*)::DOUBLE m FROM c) " + _union(
    [f"SELECT 'top_{k}_share' AS metric, round((SELECT sum(n) FROM o WHERE rn <= {k}) / total, 6) AS value FROM tt" for k in concentration.KS]
    + ["SELECT 'contributors', m FROM tt", "SELECT 'singletons', (SELECT count(*) FROM c WHERE n = 1)::DOUBLE", "SELECT 'singleton_share', round((SELECT count(*) FROM c WHERE n = 1) / m, 6) FROM tt",
       "SELECT 'median_rows', quantile_cont(n, 0.5)::DOUBLE FROM c", "SELECT 'hhi', round(sum(pow(n / total, 2)), 6) FROM c, tt", "SELECT 'gini', round(2 * sum(up * n) / any_value(m * total) - any_value((m + 1) / m), 6) FROM o, tt"])


@query("domain_concentration", ROOTS + _CONC.replace("{k}", "root"))
def domain_concentration(spark, d):
    return concentration.concentration(_sources(spark, d), "root")


@query("schema_concentration", ROOTS + _CONC.replace("{k}", "schema_hash"))
def schema_concentration(spark, d):
    return concentration.concentration(_sources(spark, d), "schema_hash")


_SIDE = "SELECT '{a}' AS per, sum(n)::BIGINT AS pairs, round(avg(n), 6) AS mean, quantile_cont(n, 0.5)::DOUBLE AS median, max(n) AS max, count(*) FILTER (WHERE n = 1) AS singletons FROM (SELECT {a}, count(*) n FROM p GROUP BY 1)"


@query("schema_domain_links", ROOTS + ", p AS (SELECT DISTINCT root, schema_hash FROM r WHERE root IS NOT NULL AND schema_hash IS NOT NULL) " + _union([_SIDE.format(a="root"), _SIDE.format(a="schema_hash")]))
def schema_domain_links(spark, d):
    return concentration.links(_sources(spark, d), "root", "schema_hash")


@query("top_domains", ROOTS + "SELECT root, count(*) AS n, round(count(*) / (SELECT count(root) FROM r), 5) AS share, count(DISTINCT schema_hash) AS others FROM r WHERE root IS NOT NULL GROUP BY 1 ORDER BY n DESC, root LIMIT 50")
def top_domains(spark, d):
    return concentration.top_contributors(_sources(spark, d), "root", "schema_hash", 50)


@query("domain_tiers", ROOTS + ", k AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) rn FROM r WHERE root IS NOT NULL GROUP BY 1) SELECT CASE WHEN rn <= 10 THEN 'head' WHEN rn <= 100 THEN 'torso' ELSE 'tail' END AS tier, count(*) AS n FROM r LEFT JOIN k USING (root) GROUP BY 1")
def domain_tiers(spark, d):
    return concentration.tiers(_sources(spark, d), "root").groupBy("tier").agg(F.count("*").alias("n"))


@query("bootstrap_validity")
def bootstrap_validity(spark, d):
    df = raw(spark, d, "llm_model", "response_is_valid").withColumn("v", F.col("response_is_valid").cast("double"))
    return stats.bootstrap_interval(df.filter("llm_model is not null"), "v", ["llm_model"])
