"""Queries of problem 3: nested JSON into flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafloom.operators import nested
from leafloom.plans.registry import query
from leafloom.sources.tables import table


def _records(spark: SparkSession, d: str) -> DataFrame:
    return nested.records_of(table(spark, d, "raw_rows", ["id", "schema_hash", "response", "schema"]))


#: The same rows by a recursion over the JSON, without graph and tables.
P3_SQL = r"""
WITH RECURSIVE src AS (
  SELECT DISTINCT 'response' AS rec_kind, id AS rec_key, response AS t FROM raw_rows WHERE id IS NOT NULL AND response IS NOT NULL
  UNION ALL SELECT DISTINCT 'schema', schema_hash, schema FROM raw_rows WHERE schema_hash IS NOT NULL AND schema IS NOT NULL),
s0 AS (SELECT rec_kind, rec_key, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM src),
s1 AS (SELECT rec_kind, rec_key, t, regexp_replace(regexp_extract(t, '```[A-Za-z0-9_-]*[ \t]*\r?\n?([\s\S]*?)```', 1), '^\s+|\s+$', '', 'g') AS body, regexp_replace(regexp_extract(t, '[{\[][\s\S]*'), '[ \r\n\t`]+$', '') AS rest FROM s0),
s2 AS (SELECT rec_kind, rec_key, CASE WHEN json_valid(t) THEN t WHEN json_valid(body) AND body <> '' THEN body WHEN json_valid(rest) AND rest <> '' THEN rest END AS j FROM s1),
u AS (SELECT rec_kind, rec_key, j FROM s2 WHERE j IS NOT NULL
  UNION ALL SELECT rec_kind, rec_key, regexp_replace(j ->> '$', '^\s+|\s+$', '', 'g') FROM u WHERE json_type(j) = 'VARCHAR' AND json_valid(regexp_replace(j ->> '$', '^\s+|\s+$', '', 'g'))),
f AS (SELECT rec_kind, rec_key, j FROM u WHERE json_type(j) IN ('OBJECT', 'ARRAY')
  UNION ALL SELECT rec_kind, rec_key, b FROM (SELECT rec_kind, rec_key, regexp_replace(regexp_extract(j ->> '$', '```[A-Za-z0-9_-]*[ \t]*\r?\n?([\s\S]*?)```', 1), '^\s+|\s+$', '', 'g') AS b FROM u WHERE json_type(j) = 'VARCHAR') WHERE b <> '' AND json_valid(b) AND json_type(b) IN ('OBJECT', 'ARRAY')),
n AS (SELECT rec_kind, rec_key, '$' AS path, '' AS parent, j::JSON AS j FROM f
  UNION ALL SELECT rec_kind, rec_key, CASE WHEN json_type(n.j) = 'OBJECT' THEN n.path || '.' || replace(replace(e.key, '\', '\\'), '.', '\.') ELSE n.path || '[' || e.key || ']' END,
    CASE WHEN json_type(n.j) = 'OBJECT' THEN n.path ELSE n.parent END, e.value FROM n, json_each(n.j) e WHERE e.type IN ('OBJECT', 'ARRAY'))
SELECT DISTINCT rec_kind, rec_key, path AS node_path, parent AS parent_path FROM n WHERE json_type(j) = 'OBJECT'
"""


@query("p3_found", P3_SQL)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_rows(_records(spark, d))


@query("p3_schema_graph")
def p3_schema_graph(spark: SparkSession, d: str) -> DataFrame:
    return nested.shared_inlining(nested.parsed_objects(_records(spark, d)))


@query("p3_tables")
def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    objects = nested.parsed_objects(_records(spark, d))
    return nested.relational_rows(objects, nested.shared_inlining(objects))
