"""The pN_ queries of the operators in this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.llm import boilerplate, capping, language, leaks, overlap, packing, pairs, pieces, pii
from leafloom.operators.joining import first_of_each
from leafloom.sources.tables import PLACE, placed_table, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


P5_SQL = r"""
WITH t AS (SELECT id, any_value(regexp_replace(source, '^\s+|\s+$', '', 'g')) s, any_value(schema_hash) schema_hash FROM raw_rows WHERE id IS NOT NULL GROUP BY id),
h AS (SELECT id, schema_hash, CASE WHEN regexp_matches(s, '^[A-Za-z][A-Za-z0-9+.-]*://') AND NOT regexp_matches(lower(s), '^https?://') THEN NULL
  ELSE lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(regexp_replace(s, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?#]*)', 1), '^.*@', ''), ':\d*$', ''), '\.+$', '')) END host FROM t),
d AS (SELECT id, schema_hash, CASE WHEN host LIKE '%.%' AND NOT regexp_matches(host, '^\d+\.\d+\.\d+\.\d+$') AND NOT regexp_matches(host, '[\s:]') THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1) END dom FROM h),
q AS (SELECT id, arg_max(quality, scored_at) quality FROM row_quality GROUP BY id),
x AS (SELECT d.*, q.quality, (SELECT greatest(1, count(*) * 2 // 100) FROM t) cap FROM d LEFT JOIN q USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY dom ORDER BY quality DESC NULLS LAST, id) k FROM x),
a AS (SELECT id FROM r WHERE dom IS NOT NULL AND k > cap),
b AS (SELECT id, cap, schema_hash, row_number() OVER (PARTITION BY schema_hash ORDER BY quality DESC NULLS LAST, id) k FROM x WHERE id NOT IN (SELECT id FROM a))
SELECT id, 'source' AS capped_by FROM a UNION ALL SELECT id, 'schema_hash' FROM b WHERE schema_hash IS NOT NULL AND k > cap
"""


@query("p5_found", P5_SQL)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return capping.cap_contributors(table(spark, d, "raw_rows", ["id", "source", "schema_hash"]), table(spark, d, "row_quality"))


def _contents(spark: SparkSession, d: str) -> DataFrame:
    raw = first_of_each(placed_table(spark, d, "raw_rows", ["id", "content"]), "id", PLACE)
    fine = table(spark, d, "finetune", ["ft_id", "content"])
    return raw.select(F.lit("raw_rows").alias("origin"), F.col("id").alias("item_key"), "content").unionByName(
        fine.select(F.lit("finetune").alias("origin"), F.col("ft_id").cast("string").alias("item_key"), "content")
    ).filter("item_key is not null")


P6_SQL = """
SELECT DISTINCT 'raw_rows' AS origin, id AS item_key FROM raw_rows WHERE length(content) > 4096
UNION ALL SELECT 'finetune', ft_id::VARCHAR FROM finetune WHERE length(content) > 4096
"""


@query("p6_found", P6_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.split_pieces(_contents(spark, d), ["origin", "item_key"], "content")
    return cut.filter("piece_no = 2").select("origin", "item_key")


@query("p6_pieces")
def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_pieces(_contents(spark, d), ["origin", "item_key"], "content")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_rows", ["id", "source", "content"])


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.template_lines(_pages(spark, d))


@query("p1_body")
def p1_body(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_body(placed_table(spark, d, "raw_rows", ["id", "source", "content"]), PLACE)


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, d, "raw_rows", ["id", "prompt", "response", "schema", "content"]))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "eval_items"))


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id")


@query("p9_items")
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks_by_item(_leaked(spark, d))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split_pairs(table(spark, d, "finetune", ["ft_id", "split", "schema", "content", "source"]))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("ft_id_a", "ft_id_b")


@query("p7_report")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(_pairs(spark, d))


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    found = language.document_languages(table(spark, d, "documents", ["doc_id", "text", "lang"]))
    return language.wrong_labels(found).select("doc_id", "para_no", "lang")


@query("p10_languages")
def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(table(spark, d, "documents", ["doc_id", "text", "lang"]))


@query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_containers(table(spark, d, "documents", ["doc_id", "text"]))


@query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, d))


_TEXTS = ["id", "prompt", "content", "schema", "response"]


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_items(table(spark, d, "raw_rows", _TEXTS))


@query("p4_redacted")
def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(placed_table(spark, d, "raw_rows", _TEXTS), PLACE)
