"""Queries of corpus preparation and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.functions.text import CAPS, chat_messages, chunk_geometry, chunks, estimated_tokens, extraction_prompt, file_name, long_page, request_options, score_bucket
from leafloom.operators import corpus
from leafloom.operators.concentration import tiers
from leafloom.plans.describing import _BUCKET, ROOTS, _raw, _sources, raw
from leafloom.plans.registry import query
from leafloom.sources.tables import once_per_id, table

SIZE, OVERLAP = chunk_geometry()
STEP = SIZE - OVERLAP
_OK = " AND ".join(f"coalesce(length({c}) <= {n}, false)" for c, n in CAPS.items())
_REASON = "CASE " + " ".join(f"WHEN NOT coalesce(length({c}) <= {n}, false) THEN '{c}'" for c, n in CAPS.items()) + " ELSE 'kept' END"


@query("char_cap_funnel", _raw("content", "schema", "response") + f"SELECT {_REASON} AS reason, count(*) AS n FROM r GROUP BY 1")
def char_cap_funnel(spark, d):
    df = table(spark, d, "raw_rows", ["id", *CAPS])
    reasons = df.select("id", corpus.first_reason(CAPS).alias("reason"))
    return once_per_id(reasons).groupBy("reason").agg(F.count("*").alias("n"))


@query("chunk_overlap_rows", "SELECT ft_id, i AS chunk_no, i * 872 AS chunk_start, substr(content, i * 872 + 1, 1000) AS chunk FROM (SELECT ft_id, content, unnest(range(0, (length(content) - 1) // 872 + 1))::INT AS i FROM finetune WHERE length(content) > 0)")
def chunk_overlap_rows(spark, d):
    return chunks(table(spark, d, "finetune", ["ft_id", "content"]), "content", 1000, 128).select("ft_id", "chunk_no", "chunk_start", "chunk")


@query("chunk_overlap_stats", f"WITH c AS (SELECT lang, doc_id, unnest(range(0, (length(text) - 1) // {STEP} + 1)) i, text FROM documents WHERE length(text) > 0) SELECT lang, count(DISTINCT doc_id) AS n_docs, count(*) AS n_chunks, round(avg(length(substr(text, (i * {STEP} + 1)::BIGINT, {SIZE}))), 6) AS mean_chars FROM c GROUP BY 1")
def chunk_overlap_stats(spark, d):
    c = chunks(table(spark, d, "documents", ["doc_id", "lang", "text"]), "text", SIZE, OVERLAP)
    return c.groupBy("lang").agg(F.count_distinct("doc_id").alias("n_docs"), F.count("*").alias("n_chunks"), F.round(F.avg(F.char_length("chunk")), 6).alias("mean_chars"))


_PREPARED = _raw("content", "schema", "response") + f""", c AS (SELECT *, unnest(range(0, (length(content) - 1) // {STEP} + 1)) i FROM r WHERE {_OK} AND length(content) > 0)
SELECT CASE WHEN ('0x' || left(md5(concat(id, '#', i, ':42')), 8))::BIGINT % 100 < 10 THEN 'test' ELSE 'train' END AS split, count(*) AS n_chunks, sum(length(substr(content, (i * {STEP} + 1)::BIGINT, {SIZE})))::BIGINT AS chars FROM c GROUP BY 1"""


@query("prepared_split", _PREPARED)
def prepared_split(spark, d):
    rows = corpus.prepared(table(spark, d, "raw_rows", ["id", *CAPS]))
    once = rows.select("id", "chunk_no", "split", F.char_length("content").alias("chars")).dropDuplicates(["id", "chunk_no"])
    return once.groupBy("split").agg(F.count("*").alias("n_chunks"), F.sum("chars").alias("chars"))


@query("split_hash_90_10", "SELECT ft_id, CASE WHEN ('0x' || left(md5(concat(ft_id, ':42')), 8))::BIGINT % 100 < 10 THEN 'test' ELSE 'train' END AS split FROM finetune")
def split_hash(spark, d):
    return corpus.hash_split(table(spark, d, "finetune", ["ft_id"]), F.col("ft_id"), 10, 42)


@query("token_length_filter", "SELECT ft_id, ceil((length(schema) + length(content)) / 3.5)::BIGINT AS tokens FROM finetune WHERE ceil((length(schema) + length(content)) / 3.5) <= 2048")
def token_filter(spark, d):
    t = table(spark, d, "finetune", ["ft_id", "schema", "content"]).select("ft_id", estimated_tokens(F.char_length("schema") + F.char_length("content")).cast("bigint").alias("tokens"))
    return t.filter("tokens <= 2048")


@query("prompt_projection", "SELECT ft_id, length(concat('Extract data from the content according to the JSON schema.\nSchema: ' || schema || '\nContent: ' || content || '\nReturn ONLY valid JSON matching the schema.')) AS chars, md5('Extract data from the content according to the JSON schema.\nSchema: ' || schema || '\nContent: ' || content || '\nReturn ONLY valid JSON matching the schema.') AS digest FROM finetune WHERE schema IS NOT NULL AND content IS NOT NULL")
def prompt_projection(spark, d):
    p = extraction_prompt(F.col("schema"), F.col("content"))
    return table(spark, d, "finetune", ["ft_id", "schema", "content"]).select("ft_id", F.char_length(p).cast("bigint").alias("chars"), F.md5(p).alias("digest")).filter("digest is not null")


@query("safe_file_names", _raw("llm_model", "source") + "SELECT id, regexp_replace(source, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM r WHERE source IS NOT NULL")
def safe_file_names(spark, d):
    return raw(spark, d, "source").filter("source is not null").select("id", file_name(F.col("source")).alias("name"))


@query("uniform_sample", _raw("schema_depth") + "SELECT id FROM r ORDER BY md5(id || ':7'), id LIMIT 100")
def uniform_sample(spark, d):
    return corpus.sample(raw(spark, d, "schema_depth"), "id", 100, 7).select("id")


_STRATA = "WITH m AS (SELECT DISTINCT idx, complexity_bucket FROM model_results), s AS (SELECT complexity_bucket b, count(*) c FROM m GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY complexity_bucket ORDER BY md5(concat(idx, ':13')), idx) k FROM m) "


@query("stratified_sample")
def stratified_sample(spark, d):
    m = table(spark, d, "model_results", ["idx", "complexity_bucket"]).dropDuplicates(["idx"])
    return corpus.stratified_sample(m, "idx", "complexity_bucket", 50, 13)


@query("sample_by_quota", _STRATA + "SELECT idx, complexity_bucket FROM r WHERE k <= CASE complexity_bucket WHEN '0-50' THEN 5 WHEN '50-100' THEN 10 WHEN '100-200' THEN 7 ELSE 0 END")
def sample_by_quota(spark, d):
    m = table(spark, d, "model_results", ["idx", "complexity_bucket"]).distinct()
    return corpus.by_quota(m, "idx", "complexity_bucket", {"0-50": 5, "50-100": 10, "100-200": 7}, 13)


@query("tier_page_strata", ROOTS + ", n AS (SELECT DISTINCT id, length(content) > 14336 AS long_page FROM raw_rows WHERE id IS NOT NULL), k AS (SELECT root, row_number() OVER (ORDER BY count(*) DESC, root) rn FROM r WHERE root IS NOT NULL GROUP BY 1), x AS (SELECT r.id, CASE WHEN rn <= 10 THEN 'head' WHEN rn <= 100 THEN 'torso' ELSE 'tail' END AS tier, coalesce(long_page, false) AS long_page FROM r LEFT JOIN k USING (root) JOIN n USING (id)), s AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5(id || ':3'), id) q FROM x) SELECT tier, long_page, count(*) AS population, count(*) FILTER (WHERE q <= CASE tier WHEN 'head' THEN 40 WHEN 'torso' THEN 40 ELSE 20 END) AS sampled FROM s GROUP BY 1, 2")
def tier_page_strata(spark, d):
    long = once_per_id(table(spark, d, "raw_rows", ["id", "content"]).select("id", long_page(F.col("content")).alias("long_page")))
    pop = tiers(_sources(spark, d), "root").select("id", "tier").join(long, "id")
    got = corpus.by_quota(pop, "id", "tier", {"head": 40, "torso": 40, "tail": 20}, 3)
    return corpus.strata(pop, got, ["tier", "long_page"])


@query("schema_stats_lookup", "WITH s AS (SELECT schema, arg_max(schema_complexity_score, id) score, arg_max(schema_depth, id) depth FROM raw_rows WHERE schema IS NOT NULL AND id IS NOT NULL GROUP BY 1) SELECT ft_id, score, depth, " + _BUCKET.format("score") + " AS bucket FROM finetune LEFT JOIN s USING (schema)")
def schema_stats_lookup(spark, d):
    """Schema statistics for each record, the last row of a schema (by id) wins; unknown where no row has it."""
    r = table(spark, d, "raw_rows", ["id", "schema", "schema_complexity_score", "schema_depth"]).filter("schema is not null and id is not null")
    keyed = r.select(F.xxhash64("schema").alias("h1"), F.md5("schema").alias("h2"), "id", "schema_complexity_score", "schema_depth")
    s = keyed.groupBy("h1", "h2").agg(F.max_by("schema_complexity_score", "id").alias("score"), F.max_by("schema_depth", "id").alias("depth"))
    f = table(spark, d, "finetune", ["ft_id", "schema"]).select("ft_id", F.xxhash64("schema").alias("h1"), F.md5("schema").alias("h2"))
    return f.join(s, ["h1", "h2"], "left").select("ft_id", "score", "depth", score_bucket(F.col("score")).alias("bucket"))


@query("tier_page_sample")
def tier_page_sample(spark, d):
    """Of each tier half short and half long pages, filled up from the other side."""
    long = once_per_id(table(spark, d, "raw_rows", ["id", "content"]).select("id", long_page(F.col("content")).alias("long_page")))
    pop = tiers(_sources(spark, d), "root").select("id", "tier").join(long, "id")
    quota = corpus.page_quotas(pop, "tier", "long_page", {"head": 40, "torso": 40, "tail": 20})
    named = pop.withColumn("stratum", F.concat_ws("/", "tier", F.when(F.col("long_page"), "long").otherwise("short")))
    return corpus.by_quota(named, "id", "stratum", quota, 3).select("id", "stratum")


@query("calibration_sample", "WITH p AS (SELECT ft_id, length(content) n, row_number() OVER (ORDER BY md5(concat(ft_id, ':42')), ft_id) k FROM finetune WHERE content IS NOT NULL) SELECT ft_id FROM p WHERE k <= 2048 AND ceil(n / 3.5) <= 512 ORDER BY k LIMIT 256")
def calibration_sample(spark, d):
    """a pool of 2,048 records, those short enough, the first 256."""
    f = table(spark, d, "finetune", ["ft_id", "content"]).filter("content is not null").select("ft_id", F.char_length("content").alias("n"))
    return corpus.calibration(f, "ft_id", F.ceil(F.col("n") / 3.5), most_tokens=512).select("ft_id")


@query("chat_turns", "SELECT ft_id, unnest(['user', 'assistant']) AS role, unnest([md5('Extract data from the content according to the JSON schema.\nSchema: ' || schema || '\nContent: ' || content || '\nReturn ONLY valid JSON matching the schema.'), md5(response)]) AS digest FROM finetune WHERE schema IS NOT NULL AND content IS NOT NULL AND response IS NOT NULL")
def chat_turns(spark, d):
    """the two turns of each training example."""
    f = table(spark, d, "finetune", ["ft_id", "schema", "content", "response"]).dropna(subset=["schema", "content", "response"])
    turns = chat_messages(extraction_prompt(F.col("schema"), F.col("content")), F.col("response"))
    return f.select("ft_id", F.explode(turns).alias("t")).select("ft_id", "t.role", F.md5("t.content").alias("digest"))


@query("request_option_sizes", """SELECT ft_id, length('{"type":"json_schema","json_schema":{"name":"extraction","schema":' || schema || ',"strict":false}}') AS json_schema, length('{"type":"json_object"}') AS json_object, length('{}') AS none_ FROM finetune WHERE schema IS NOT NULL""")
def request_option_sizes(spark, d):
    """Characters of the structured-output options of each request, by mode."""
    f = table(spark, d, "finetune", ["ft_id", "schema"]).filter("schema is not null")
    return f.select("ft_id", *[F.char_length(request_options(m, F.col("schema"))).cast("bigint").alias(n) for m, n in (("json_schema", "json_schema"), ("json_object", "json_object"), ("none", "none_"))])


@query("restricted_to_gold", "SELECT f.ft_id, f.split FROM finetune f WHERE ft_id IN (SELECT idx FROM model_results)")
def restricted_to_gold(spark, d):
    """the records that a model was asked about."""
    gold = table(spark, d, "model_results", ["idx"]).select(F.col("idx").alias("ft_id"))
    return corpus.restricted(table(spark, d, "finetune", ["ft_id", "split"]), gold, "ft_id")
