"""Queries over model results and judgments."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions.text import long_page
from leafloom.operators import judging, runs
from leafloom.operators.concentration import tiers
from leafloom.plans.describing import ROOTS, _sources
from leafloom.plans.registry import query
from leafloom.session import cut_lineage
from leafloom.sources.tables import table

ORDER = ["is_valid_json", "cost", "api_error", "model_response"]
_LAST = "WITH m AS (SELECT DISTINCT model, idx, complexity_bucket, schema_depth, schema_keys, structured_mode_used, schema_rejected, cost, api_error, is_valid_json, is_schema_compliant, key_precision, key_recall, key_f1, missing_keys, extra_keys, value_score, overall_bleu FROM model_results)"
_GRP = ", g AS (SELECT 'overall' grp, * FROM m UNION ALL SELECT complexity_bucket, * FROM m WHERE complexity_bucket IS NOT NULL UNION ALL SELECT 'depth>=7', * FROM m WHERE schema_depth >= 7 UNION ALL SELECT 'keys>=200', * FROM m WHERE schema_keys >= 200) "
COLUMNS = ["model", "idx", "complexity_bucket", "schema_depth", "schema_keys", "structured_mode_used", "schema_rejected", "cost", "api_error", *runs.METRICS]


def _results(spark, d):
    """Each record once: exact repeats go."""
    return table(spark, d, "model_results", COLUMNS).dropDuplicates()


@query("latest_record_wins", "SELECT model, idx, max(cost) AS cost FROM model_results GROUP BY 1, 2")
def latest_record_wins(spark, d):
    t = table(spark, d, "model_results", ["model", "idx", "cost"])
    return runs.last_wins(t, ["model", "idx"], ["cost"])


@query("overlapping_group_means", _LAST + _GRP + "SELECT model, grp, count(*) AS n, round(coalesce(sum(cost), 0) + 1e-10, 6) AS total_cost, " + ", ".join(f"round(avg({m}) + 1e-10, 6) AS {m}" for m in runs.METRICS) + ", round(avg(coalesce(schema_rejected, false)::INT) + 1e-10, 6) AS schema_rejected_rate, round(avg(CASE WHEN structured_mode_used = 'json_schema' THEN 0 ELSE 1 END) + 1e-10, 6) AS fallback_rate FROM g GROUP BY 1, 2")
def overlapping_group_means(spark, d):
    return runs.group_means(_results(spark, d))


_RL = "(contains(lower(coalesce(api_error, '')), 'rate limit') OR contains(lower(coalesce(api_error, '')), 'try again later'))"


@query("rejection_table", _LAST + _GRP + f", h AS (SELECT *, coalesce(schema_rejected, false) rej FROM g) SELECT model, grp, count(*) AS n_done, count(*) FILTER (WHERE rej AND {_RL}) AS n_rej_ratelimit, count(*) FILTER (WHERE rej AND NOT {_RL}) AS n_rej_schema, count(*) FILTER (WHERE NOT rej) AS n_accepted, round(avg(is_schema_compliant) + 1e-10, 6) AS compliant_all, round(avg(key_f1) + 1e-10, 6) AS key_f1_all, round(avg(is_schema_compliant) FILTER (WHERE NOT rej) + 1e-10, 6) AS compliant_accepted, round(avg(key_f1) FILTER (WHERE NOT rej) + 1e-10, 6) AS key_f1_accepted, round(coalesce(sum(is_schema_compliant) FILTER (WHERE NOT rej), 0) / count(*) + 1e-10, 6) AS e2e_strict_done FROM h GROUP BY 1, 2".replace(_GRP + ",", _GRP.rstrip() + ","))
def rejection_table(spark, d):
    return runs.rejection_table(_results(spark, d))


_NORM = r"""left(trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(s, 'output_format\.schema: ([^"]+)', 1), ''), nullif(regexp_extract(s, '"invalid_request_error","message":"([^"]+)"', 1), ''), regexp_replace(regexp_replace(s, '(?i)req(?:uest)?[_ ]?id["'':=\s]+\S+', '', 'g'), '[''"][^''"]{40,}[''"]', '''<snip>''', 'g')), '[0-9]{4,}', '<n>', 'g'), '\s+', ' ', 'g')), 220)"""


@query("rejection_causes", _LAST + r""", e AS (SELECT replace(replace(replace(regexp_replace(coalesce(api_error, ''), '^schema_rejected: ', ''), '\\', '\'), '\''', ''''), '\"', '"') s FROM m WHERE schema_rejected) SELECT """ + _NORM + " AS cause, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, cause LIMIT 20")
def rejection_causes(spark, d):
    return runs.rejection_causes(_results(spark, d))


@query("rejected_against_accepted", _LAST + "SELECT coalesce(schema_rejected, false) AS rejected, count(*) AS n, round(avg(schema_keys) + 1e-10, 6) AS mean_keys, round(avg(schema_depth) + 1e-10, 6) AS mean_depth FROM m GROUP BY 1")
def rejected_against_accepted(spark, d):
    return runs.rejected_against_accepted(_results(spark, d))


_ENDS = ", lo AS (SELECT * FROM m WHERE model = (SELECT min(model) FROM m)), hi AS (SELECT DISTINCT idx FROM m WHERE model = (SELECT max(model) FROM m))"


@query("coverage_sensitivity", _LAST + _ENDS + ", m2 AS (SELECT lo.*, hi.idx IS NOT NULL c FROM lo LEFT JOIN hi USING (idx)), g AS (SELECT 'overall' grp, * FROM m2 UNION ALL SELECT complexity_bucket, * FROM m2 WHERE complexity_bucket IS NOT NULL UNION ALL SELECT 'depth>=7', * FROM m2 WHERE schema_depth >= 7 UNION ALL SELECT 'keys>=200', * FROM m2 WHERE schema_keys >= 200) SELECT grp, count(*) AS n_full, count(*) FILTER (WHERE c) AS n_covered, round(avg(is_schema_compliant) + 1e-10, 6) AS compliant_full, round(avg(is_schema_compliant) FILTER (WHERE c) + 1e-10, 6) AS compliant_covered, round(avg(is_schema_compliant) FILTER (WHERE c) - avg(is_schema_compliant) + 1e-10, 6) AS compliant_delta, round(avg(key_f1) + 1e-10, 6) AS key_f1_full, round(avg(key_f1) FILTER (WHERE c) + 1e-10, 6) AS key_f1_covered, round(avg(key_f1) FILTER (WHERE c) - avg(key_f1) + 1e-10, 6) AS key_f1_delta FROM g GROUP BY 1 HAVING count(*) FILTER (WHERE c) > 0")
def coverage_sensitivity(spark, d):
    m = _results(spark, d)
    first, last = m.agg(F.min("model")).scalar(), m.agg(F.max("model")).scalar()
    return runs.coverage_sensitivity(m.filter(F.col("model") == first), m.filter(F.col("model") == last))


@query("validity_and_means", _LAST + "SELECT count(*) AS n, round(avg(is_valid_json) + 1e-10, 6) AS valid_rate, round(avg(is_schema_compliant) + 1e-10, 6) AS compliant_rate, " + ", ".join(f"round(avg({x}) FILTER (WHERE is_valid_json = 1 AND is_schema_compliant = 1) + 1e-10, 6) AS mean_{x}" for x in runs.METRICS[2:]) + " FROM m")
def validity_and_means(spark, d):
    return runs.validity_and_means(_results(spark, d))


@query("outcome_counts", _LAST + "SELECT model, count(*) AS total, count(*) FILTER (WHERE is_valid_json IS NULL) AS failed, count(*) FILTER (WHERE is_valid_json = 0) AS invalid, count(*) FILTER (WHERE is_schema_compliant = 1) AS compliant, bool_and(is_valid_json IS NOT NULL) AS all_completed FROM m GROUP BY 1")
def outcome_counts(spark, d):
    return runs.outcome_counts(_results(spark, d))


_TODO = "SELECT DISTINCT unit_id FROM judgments WHERE unit_id NOT IN (SELECT unit_id FROM judgments WHERE judge_model = (SELECT max(judge_model) FROM judgments){0})"


def _second(spark, d):
    j = table(spark, d, "judgments", ["unit_id", "judge_model", "error"])
    return j.select("unit_id").distinct(), j.filter(F.col("judge_model") == j.agg(F.max("judge_model")).scalar())


@query("resume_errors_done", _TODO.format(""))
def resume_errors_done(spark, d):
    planned, done = _second(spark, d)
    return runs.still_to_do(planned, done, "unit_id", retry_errors=False)


@query("resume_errors_retried", _TODO.format(" AND error IS NULL"))
def resume_errors_retried(spark, d):
    planned, done = _second(spark, d)
    return runs.still_to_do(planned, done, "unit_id", retry_errors=True)


@query("tier_shares", "SELECT judge_model, count(tier) AS n, " + ", ".join(f"round(count(*) FILTER (WHERE tier = '{t}') / greatest(count(tier), 1), 6) AS {t.replace('-', '_')}_rate" for t in judging.TIERS) + " FROM judgments WHERE error IS NULL GROUP BY 1")
def tier_shares(spark, d):
    return judging.tier_shares(table(spark, d, "judgments", ["judge_model", "tier", "error"]).filter("error is null"), ["judge_model"])


_J = ROOTS + ", k AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) rn FROM r WHERE root IS NOT NULL GROUP BY 1), s AS (SELECT id, CASE WHEN rn <= 10 THEN 'head' WHEN rn <= 100 THEN 'torso' ELSE 'tail' END AS domain_tier FROM r LEFT JOIN k USING (root)), j AS (SELECT s.domain_tier, g.* FROM judgments g JOIN s ON g.unit_id = 'u-' || s.id WHERE error IS NULL) "


def _units(spark, d):
    return tiers(_sources(spark, d), "root").select(F.concat(F.lit("u-"), "id").alias("unit_id"), F.col("tier").alias("domain_tier"))


def _judged(spark, d):
    j = table(spark, d, "judgments", ["unit_id", "judge_model", "tier", "error"]).filter("error is null")
    return j.join(_units(spark, d), "unit_id")


@query("tier_shares_by_slice", _J + "SELECT domain_tier, count(tier) AS n, " + ", ".join(f"round(count(*) FILTER (WHERE tier = '{t}') / greatest(count(tier), 1), 6) AS {t.replace('-', '_')}_rate" for t in judging.TIERS) + " FROM j GROUP BY 1")
def tier_shares_by_slice(spark, d):
    return judging.tier_shares(_judged(spark, d), ["domain_tier"])


@query("stratum_reweighted_tiers", _J + ", w AS (SELECT domain_tier, count(*) / (SELECT count(*) FROM s) w FROM s GROUP BY 1), n AS (SELECT domain_tier, count(*) c FROM j WHERE tier IS NOT NULL GROUP BY 1), v AS (SELECT unnest(['good', 'so-so', 'reject']) tier) SELECT v.tier, round(sum(w * (SELECT count(*) FROM j WHERE j.domain_tier = n.domain_tier AND j.tier = v.tier) / c), 6) AS weighted_share, round(sum(w), 6) AS covered_weight FROM n JOIN w USING (domain_tier), v GROUP BY 1")
def stratum_reweighted_tiers(spark, d):
    units = cut_lineage(_units(spark, d))
    strata = units.groupBy("domain_tier").agg(F.count("*").alias("population"))
    j = table(spark, d, "judgments", ["unit_id", "judge_model", "tier", "error"]).filter("error is null")
    return judging.reweighted_shares(j.join(units, "unit_id"), strata, "domain_tier")


def _two_judges(spark, d):
    j = table(spark, d, "judgments", ["unit_id", "judge_model", "tier", "error"]).filter("error is null")
    one = lambda end: runs.last_wins(j.filter(F.col("judge_model") == j.agg(end("judge_model")).scalar()).select("unit_id", "tier"), ["unit_id"], ["tier"])
    return one(F.min), one(F.max)


_TWO = "WITH j AS (SELECT * FROM judgments WHERE error IS NULL), a AS (SELECT unit_id, max(tier) x FROM j WHERE judge_model = (SELECT min(judge_model) FROM j) GROUP BY 1), b AS (SELECT unit_id, max(tier) y FROM j WHERE judge_model = (SELECT max(judge_model) FROM j) GROUP BY 1), p AS (SELECT unit_id, x, y FROM a JOIN b USING (unit_id) WHERE x IS NOT NULL AND y IS NOT NULL) "


@query("kappa_agreement", _TWO + ", q AS (SELECT (SELECT count(*) FROM p)::DOUBLE n, (SELECT count(*) FROM p WHERE x = y)::DOUBLE same, (SELECT sum(ca * cb) FROM (SELECT x t, count(*) ca FROM p GROUP BY 1) JOIN (SELECT y t, count(*) cb FROM p GROUP BY 1) USING (t))::DOUBLE pe0), q2 AS (SELECT *, coalesce(pe0, 0) pe FROM q) SELECT n::BIGINT AS n, round(same / n, 6) AS agreement, round((same / n - pe / n / n) / (1 - pe / n / n), 6) AS kappa FROM q2")
def kappa_agreement(spark, d):
    a, b = _two_judges(spark, d)
    return judging.agreement(a, b, "unit_id", "tier")


_RANK = "list_position(['good', 'so-so', 'reject'], {0})"


@query("pair_delta_rates", _TWO + f", z AS (SELECT {_RANK.format('x')} - {_RANK.format('y')} d FROM p WHERE {_RANK.format('x')} > 0 AND {_RANK.format('y')} > 0) SELECT count(*) AS n, round(count(*) FILTER (WHERE d > 0) / count(*), 6) AS better_rate, round(count(*) FILTER (WHERE d < 0) / count(*), 6) AS worse_rate, round(count(*) FILTER (WHERE d = 0) / count(*), 6) AS same_rate FROM z")
def pair_delta_rates(spark, d):
    a, b = _two_judges(spark, d)
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    return judging.pair_deltas(both, "unit_id", "side", "a", "b")


@query("first_leaf_verdicts", "WITH l AS (SELECT unit_id, judge_model, unnest(leaves) l, generate_subscripts(leaves, 1) i FROM judgments WHERE leaves IS NOT NULL), f AS (SELECT unit_id, judge_model, l.key k, l.verdict v, i, row_number() OVER (PARTITION BY unit_id, judge_model, l.key ORDER BY i) rn FROM l) SELECT judge_model, v AS verdict, count(*) AS n FROM f WHERE rn = 1 GROUP BY 1, 2")
def first_leaf_verdicts(spark, d):
    j = table(spark, d, "judgments", ["unit_id", "judge_model", "leaves"]).dropDuplicates(["unit_id", "judge_model"])
    return judging.first_verdicts(j, ["unit_id", "judge_model"]).groupBy("judge_model", "verdict").agg(F.count("*").alias("n"))


def _verdicts(spark, d):
    """Verdicts, leaves of the judged responses, and the judged units."""
    j = table(spark, d, "judgments", ["unit_id", "judge_model", "leaves", "error"]).filter("error is null")
    ids = j.select(F.expr("substring(unit_id, 3)").alias("id")).distinct()
    r = table(spark, d, "raw_rows", ["id", "response"]).join(ids, "id", "left_semi").dropDuplicates(["id"]).select(F.concat(F.lit("u-"), "id").alias("unit_id"), "response")
    return judging.first_verdicts(j, ["unit_id", "judge_model"]), judging.response_leaves(r, "unit_id", "response"), j


@query("leaf_verdict_counts")
def leaf_verdict_counts(spark, d):
    verdicts, found, _ = _verdicts(spark, d)
    return judging.leaf_counts(verdicts, found)


@query("leaf_verdict_rates")
def leaf_verdict_rates(spark, d):
    return judging.leaf_rates(*_verdicts(spark, d), ("correct", "wrong", "unsupported"), ("missing",), "unsupported")


@query("rejection_table_with_plan", _LAST + _GRP.replace(", g AS", ", pl AS (SELECT DISTINCT idx, complexity_bucket, schema_depth, schema_keys FROM m), pg AS (SELECT 'overall' grp, * FROM pl UNION ALL SELECT complexity_bucket, * FROM pl WHERE complexity_bucket IS NOT NULL UNION ALL SELECT 'depth>=7', * FROM pl WHERE schema_depth >= 7 UNION ALL SELECT 'keys>=200', * FROM pl WHERE schema_keys >= 200), pn AS (SELECT grp, count(*) n FROM pg GROUP BY 1), g AS") + "SELECT model, grp, count(*) AS n_done, max(pn.n) AS n_planned, round(coalesce(sum(is_schema_compliant) FILTER (WHERE NOT coalesce(schema_rejected, false)), 0) / max(pn.n) + 1e-10, 6) AS e2e_strict_planned FROM g JOIN pn USING (grp) GROUP BY 1, 2")
def rejection_table_with_plan(spark, d):
    """A20 against a plan: every call that any model has made."""
    m = _results(spark, d)
    planned = m.select("idx", "complexity_bucket", "schema_depth", "schema_keys").distinct()
    return runs.rejection_table(m, planned).select("model", "grp", "n_done", "n_planned", "e2e_strict_planned")


@query("gold_coverage", "WITH g AS (SELECT DISTINCT idx FROM model_results), p AS (SELECT idx, max(key_f1) f FROM model_results WHERE model = (SELECT min(model) FROM model_results) AND key_f1 IS NOT NULL GROUP BY 1) SELECT count(*) AS n_gold, count(*) FILTER (WHERE f IS NULL) AS n_missing, round(avg(f) + 1e-10, 6) AS mean_covered, round(avg(coalesce(f, 0)) + 1e-10, 6) AS mean_strict FROM g LEFT JOIN p USING (idx)")
def gold_coverage(spark, d):
    """A model's key F1 against all calls; calls without score count 0 in the strict mean."""
    m = table(spark, d, "model_results", ["idx", "model", "key_f1"])
    run = runs.last_wins(m.filter((F.col("model") == m.agg(F.min("model")).scalar()) & F.col("key_f1").isNotNull()).drop("model"), ["idx"], ["key_f1"])
    return runs.against_gold(run, m, "idx", "key_f1")


@query("tier_shares_by_page_length", "WITH r AS (SELECT id, bool_or(coalesce(length(content) > 14336, false)) long_page FROM raw_rows WHERE id IS NOT NULL GROUP BY 1), j AS (SELECT g.tier, r.long_page FROM judgments g JOIN r ON g.unit_id = 'u-' || r.id WHERE error IS NULL) SELECT long_page, count(tier) AS n, " + ", ".join(f"round(count(*) FILTER (WHERE tier = '{t}') / greatest(count(tier), 1), 6) AS {t.replace('-', '_')}_rate" for t in judging.TIERS) + " FROM j GROUP BY 1")
def tier_shares_by_page_length(spark, d):
    """The slices of short and long pages."""
    j = table(spark, d, "judgments", ["unit_id", "tier", "error"]).filter("error is null")
    r = table(spark, d, "raw_rows", ["id", "content"]).select(F.concat(F.lit("u-"), "id").alias("unit_id"), long_page(F.col("content")).alias("long_page"))
    return judging.tier_shares(j.join(r.groupBy("unit_id").agg(F.bool_or("long_page").alias("long_page")), "unit_id"), ["long_page"])


@query("judge_prompts")
def judge_prompts(spark, d):
    """The prompt for each judged unit, as its length and digest."""
    ids = table(spark, d, "judgments", ["unit_id"]).select(F.expr("substring(unit_id, 3)").alias("id")).distinct()
    r = table(spark, d, "raw_rows", ["id", "schema", "content", "response"]).join(ids, "id", "left_semi").dropDuplicates(["id"])
    lines = judging.leaf_lines(judging.response_leaves(r, "id", "response")).withColumnRenamed("key", "id")
    p = judging.judge_prompt("Schema:\n{schema}\n\nContent:\n{content}\n\nLeaves:\n{leaves}", F.col("schema"), F.col("content"), F.col("lines"))
    return r.join(lines, "id").select("id", F.char_length(p).alias("chars"), F.md5(p).alias("digest")).filter("digest is not null")
