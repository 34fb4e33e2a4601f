"""Queries that align records with pages and look for leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.operators import align
from leafloom.plans.preparing import OVERLAP, SIZE, STEP
from leafloom.plans.registry import query
from leafloom.sources.tables import table

_P = "WITH p AS (SELECT DISTINCT id, schema, content, response FROM raw_rows WHERE id IS NOT NULL), "
_CH = f"pc AS (SELECT DISTINCT id, schema, substr(content, (i * {STEP} + 1)::BIGINT, {SIZE}) ck, content FROM (SELECT *, unnest(range(0, (length(content) - 1) // {STEP} + 1)) i FROM p WHERE length(content) > 0)), "
_EX = "ex AS (SELECT ft_id, id, bool_or(ck = pc.content) full_page FROM finetune f JOIN pc ON f.schema = pc.schema AND f.content = pc.ck GROUP BY 1, 2), "
_PX = "px AS (SELECT ft_id, id, false full_page FROM finetune f JOIN p ON f.schema = p.schema AND contains(p.content, substr(f.content, 1, 1000)) WHERE length(f.content) > 0 AND ft_id NOT IN (SELECT ft_id FROM ex)), "
_M = "m AS (SELECT *, 'exact' how FROM ex UNION ALL SELECT *, 'prefix' FROM px) "
_AL = _P + _CH + _EX + _PX + _M + ", a AS (SELECT ft_id, min(how) how, count(DISTINCT m.id) n, bool_and(full_page) fp, count(DISTINCT coalesce(response, '\\0null')) answers FROM m JOIN p USING (id) GROUP BY 1), z AS (SELECT ft_id, CASE WHEN how IS NULL THEN 'unmatched' WHEN answers = 1 THEN how ELSE 'ambiguous' END AS match, coalesce(n, 0) n_pages, CASE WHEN answers = 1 THEN fp END full_page FROM finetune LEFT JOIN a USING (ft_id)) "


def _tables(spark, d):
    # an id delivered twice changes no match and no distinct count, so the texts needn't be shuffled to drop it
    pages = table(spark, d, "raw_rows", ["id", "schema", "content", "response"]).filter("id is not null")
    return table(spark, d, "finetune"), pages


@query("aligned_records", _AL + "SELECT ft_id, match, n_pages, full_page FROM z")
def aligned_records(spark, d):
    return align.alignment(*_tables(spark, d), SIZE, OVERLAP).drop("response")


@query("align_match_types", _AL + "SELECT match, count(*) AS n, count(*) FILTER (WHERE full_page) AS n_full_page FROM z GROUP BY 1")
def align_match_types(spark, d):
    a = align.alignment(*_tables(spark, d), SIZE, OVERLAP)
    return a.groupBy("match").agg(F.count("*").alias("n"), F.count_if("full_page").alias("n_full_page"))


@query("leak_funnel", _P + _CH + _EX + _PX + _M + ", tr AS (SELECT * FROM finetune WHERE split = 'train'), te AS (SELECT * FROM finetune WHERE split = 'test'), tp AS (SELECT DISTINCT m.id FROM m JOIN tr USING (ft_id)), sb AS (SELECT DISTINCT ft_id FROM m WHERE id IN (SELECT id FROM tp)) SELECT CASE WHEN content IN (SELECT content FROM tr WHERE content IS NOT NULL) THEN 'same_content' WHEN coalesce(schema || chr(0), '') || coalesce(response, '') IN (SELECT coalesce(schema || chr(0), '') || coalesce(response, '') FROM tr) THEN 'same_schema_response' WHEN ft_id IN (SELECT ft_id FROM sb) THEN 'sibling_page' ELSE 'clean' END AS reason, count(*) AS n FROM te GROUP BY 1")
def leak_funnel(spark, d):
    records, pages = _tables(spark, d)
    exact = align.exact_matches(records, pages, SIZE, OVERLAP)
    matches = exact.unionByName(align.prefix_matches(records, pages, exact))
    return align.leak_reasons(records, matches).groupBy("reason").agg(F.count("*").alias("n"))


@query("run_coverage_difference", "WITH v AS (SELECT DISTINCT idx, model FROM model_results WHERE is_schema_compliant = 1), a AS (SELECT idx FROM v WHERE model = (SELECT min(model) FROM model_results)), b AS (SELECT idx FROM v WHERE model = (SELECT max(model) FROM model_results)) SELECT coalesce(a.idx, b.idx) AS idx, CASE WHEN a.idx IS NULL THEN 'missing' ELSE 'extra' END AS side FROM a FULL JOIN b USING (idx) WHERE a.idx IS NULL OR b.idx IS NULL")
def run_coverage_difference(spark, d):
    """Calls that one of two models alone has answered in compliance."""
    m = table(spark, d, "model_results", ["idx", "model", "is_schema_compliant"])
    good = m.filter("is_schema_compliant = 1")
    first, last = m.agg(F.min("model")).scalar(), m.agg(F.max("model")).scalar()
    return align.set_difference(good.filter(F.col("model") == first), good.filter(F.col("model") == last), "idx")
