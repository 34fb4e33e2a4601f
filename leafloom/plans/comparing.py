"""Queries that score, diff and audit JSON answers and texts, and windows over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafloom.operators import audit, judging, scoring
from leafloom.plans.registry import query
from leafloom.sources.tables import table
from leafloom.streaming import incremental


def _answers(spark, d):
    m = table(spark, d, "model_results", ["model", "idx", "model_response", "clean_response", "schema", "ground_truth"])
    return m.dropDuplicates(["model", "idx"])


@query("json_validity", "SELECT model, idx, coalesce(bool_and(json_valid(clean_response)), false) AS valid FROM model_results GROUP BY 1, 2")
def json_validity(spark, d):
    m = table(spark, d, "model_results", ["model", "idx", "clean_response", "schema"])
    per = m.groupBy("model", "idx").agg(F.max("clean_response").alias("clean_response"), F.max("schema").alias("schema"))
    v = scoring.validated(per.withColumn("k", F.concat_ws("#", "model", "idx")), "k", "clean_response", "schema")
    s = F.split("key", "#")
    return v.select(s[0].alias("model"), s[1].cast("bigint").alias("idx"), F.col("is_valid").alias("valid"))


_TOKENS = r"""'"(?:\\[\s\S]|[^"\\])*"?|\\[\s\S]?|[{}\[\]]|[^"\\{}\[\]]+'"""
EXTRACTION_SQL = r"""
WITH m AS (SELECT model, idx, max(model_response) AS r FROM model_results WHERE model_response IS NOT NULL GROUP BY 1, 2),
f AS (SELECT *, regexp_matches(r, '```(?:json)?\s*([\s\S]*?)```') AS fenced, regexp_extract(r, '[{\[][\s\S]*') AS tail FROM m),
t AS (SELECT model, idx, unnest(regexp_extract_all(tail, TOKENS)) AS tok, generate_subscripts(regexp_extract_all(tail, TOKENS), 1) AS i, left(tail, 1) AS o FROM f WHERE NOT fenced AND tail <> ''),
d AS (SELECT *, sum(CASE WHEN tok = o THEN 1 WHEN tok = CASE o WHEN '{' THEN '}' ELSE ']' END THEN -1 ELSE 0 END) OVER (PARTITION BY model, idx ORDER BY i) AS depth FROM t),
e AS (SELECT model, idx, min(i) FILTER (WHERE depth = 0) AS stop FROM d GROUP BY 1, 2),
s AS (SELECT d.model, d.idx, string_agg(tok, '' ORDER BY i) AS span FROM d JOIN e ON d.model = e.model AND d.idx = e.idx AND d.i <= e.stop GROUP BY 1, 2)
SELECT f.model, f.idx, CASE WHEN fenced THEN regexp_replace(regexp_extract(r, '```(?:json)?\s*([\s\S]*?)```', 1), '^\s+|\s+$', '', 'g') ELSE coalesce(s.span, r) END AS json FROM f LEFT JOIN s USING (model, idx)
""".replace("TOKENS", _TOKENS)


@query("json_extraction", EXTRACTION_SQL)
def json_extraction(spark, d):
    m = table(spark, d, "model_results", ["model", "idx", "model_response"]).filter("model_response is not null")
    return scoring.extracted(m.groupBy("model", "idx").agg(F.max("model_response").alias("model_response")), ["model", "idx"], "model_response")


@query("json_scores")
def json_scores(spark, d):
    return scoring.scored(_answers(spark, d), ["model", "idx"], "clean_response", "schema", "ground_truth")


@query("json_score_means")
def json_score_means(spark, d):
    s = json_scores(spark, d)
    return s.groupBy("model").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in scoring.SCORES])


@query("response_leaf_counts")
def response_leaf_counts(spark, d):
    """Leaves, missing leaves and characters of the leaves' values of every response that holds JSON, however it is wrapped."""
    r = table(spark, d, "raw_rows", ["id", "response"]).filter("id is not null")
    found = judging.response_leaves(r, "id", "response").dropDuplicates(["key", "leaf"])
    return found.groupBy(F.col("key").alias("id")).agg(F.count("*").alias("leaves"), F.count_if("missing").alias("missing"), F.sum(F.char_length("value")).alias("chars"))


def _pairs(spark, d):
    """Two answers to one schema: those of its first and of its last row."""
    r = table(spark, d, "raw_rows", ["id", "schema_hash", "schema", "response"]).dropna()
    ends = r.groupBy("schema_hash").agg(
        F.min_by(F.struct("schema", "response"), "id").alias("a"), F.max_by("response", "id").alias("after"), (F.min("id") < F.max("id")).alias("two")
    )
    return ends.filter("two").select("schema_hash", F.col("a.schema").alias("schema"), F.col("a.response").alias("before"), "after", (F.col("a.response") == F.col("after")).alias("same"))


@query("regeneration_diff")
def regeneration_diff(spark, d):
    return scoring.diff_summary(scoring.compared(_pairs(spark, d), "schema_hash", "schema", "before", "after", "same"))


@query("answer_diff_by_compliance")
def answer_diff_by_compliance(spark, d):
    a = _answers(spark, d).withColumn("same", F.col("clean_response") == F.col("ground_truth")).withColumn("k", F.concat_ws("#", "model", "idx"))
    return scoring.diff_summary(scoring.compared(a, "k", "schema", "ground_truth", "clean_response", "same"), ["flag"])


@query("soft_sample_means")
def soft_sample_means(spark, d):
    """Over 5,000 pairs of a model's answer and the expected one."""
    return scoring.soft_means(_answers(spark, d).withColumn("k", F.concat_ws("#", "model", "idx")), "k", "ground_truth", "clean_response")


@query("rewrite_shares")
def rewrite_shares(spark, d):
    """Label shares, those that need a judge spread by the answer that the expected value supports."""
    r = scoring.rewrites(_pairs(spark, d), "schema_hash", "before", "after")
    judged = r.filter("heuristic = 'needs_judge'").select("leaf_id", F.when(F.char_length("orig") >= F.char_length("regen"), "shorter").otherwise("longer").alias("judge"), F.lit(None).cast("string").alias("manual"))
    return scoring.extrapolated(r, judged)


@query("gold_edits")
def gold_edits(spark, d):
    """Leaves that differ between a model's answer, as the draft, and the expected one, per bucket."""
    m = table(spark, d, "model_results", ["model", "idx", "complexity_bucket", "clean_response", "ground_truth"]).dropDuplicates(["model", "idx"])
    return scoring.edits(m.withColumn("k", F.concat_ws("#", "model", "idx")), "k", "clean_response", "ground_truth", "complexity_bucket")


@query("annotation_problems")
def annotation_problems(spark, d):
    """The answers of the first model as the annotations of all calls."""
    m = _answers(spark, d)
    done = m.filter(F.col("model") == m.agg(F.min("model")).scalar()).select("idx", (F.col("idx") % 10 != 0).alias("verified"), F.col("clean_response").alias("gold"), "schema")
    return scoring.annotation_problems(m.select("idx").distinct(), done, "idx")


@query("pair_units", "WITH p AS (SELECT id, schema, content, response FROM raw_rows WHERE id IS NOT NULL AND content IS NOT NULL AND response IS NOT NULL GROUP BY ALL), u AS (SELECT 'pair_orig-' || id AS unit_id, id, 'pair_orig' AS kind, content FROM p UNION ALL SELECT 'pair_regen-' || id, id, 'pair_regen', substr(content, 1, 1000) FROM p) SELECT unit_id, id AS pair_id, kind, length(content) AS chars FROM u")
def pair_units(spark, d):
    """Each response on its page and on the head of it."""
    r = table(spark, d, "raw_rows", ["id", "schema", "content", "response"]).filter("id is not null and content is not null and response is not null")
    pairs = r.select(F.col("id").alias("pair_id"), "schema", F.col("content").alias("page"), F.substring("content", 1, 1000).alias("chunk"), F.col("response").alias("before"), F.col("response").alias("after"))
    return scoring.pair_units(pairs).select("unit_id", "pair_id", "kind", F.char_length("content").cast("bigint").alias("chars")).dropDuplicates(["unit_id"])


@query("rewrite_taxonomy")
def rewrite_taxonomy(spark, d):
    r = scoring.rewrites(_pairs(spark, d), "schema_hash", "before", "after")
    return r.groupBy("heuristic").agg(F.count("*").alias("n"), F.count_distinct("key").alias("pairs"))


FIELDS = ["prompt", "content", "schema", "response"]
_CELLS = "WITH r AS (SELECT DISTINCT id, prompt, content, schema, response FROM raw_rows WHERE id IS NOT NULL), c AS (UNPIVOT r ON prompt, content, schema, response INTO NAME field VALUE txt), f AS (" + " UNION ALL ".join(
    f"SELECT id, field, '{n}' AS label, len(regexp_extract_all(txt, '{p}')) AS k FROM c" for n, p in audit.PLAIN.items()) + ") "


def _findings(spark, d):
    raw = table(spark, d, "raw_rows", ["id", *FIELDS]).filter("id is not null")
    per_cell = audit.cells(raw, "id", FIELDS)
    found = audit.spans(per_cell, audit.pattern_detector(audit.PLAIN), audit.pattern_detector(audit.SECRETS, "secret"))
    return audit.once(found)


@query("pii_span_matrix", _CELLS + ", g AS (SELECT label, field, sum(k)::BIGINT AS spans, count(*) FILTER (WHERE k > 0) AS rows FROM f GROUP BY 1, 2), z AS (SELECT * FROM (SELECT unnest(['email', 'url', 'long_number', 'secret']) AS label), (SELECT unnest(['prompt', 'content', 'schema', 'response']) AS field)), q AS (SELECT label, field, coalesce(spans, 0) AS spans, coalesce(rows, 0) AS rows FROM z LEFT JOIN g USING (label, field)) SELECT *, sum(rows) OVER (PARTITION BY label)::BIGINT AS sum_over_fields FROM q")
def pii_span_matrix(spark, d):
    return audit.matrix(_findings(spark, d), ["email", "url", "long_number", "secret"], FIELDS)


@query("pii_affected_rows", _CELLS + "SELECT id AS key, count(DISTINCT label) AS labels, sum(k)::BIGINT AS spans FROM f WHERE k > 0 GROUP BY 1")
def pii_affected_rows(spark, d):
    return _findings(spark, d).groupBy("key").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("spans"))


@query("pii_distinct_texts", "WITH r AS (SELECT DISTINCT id, prompt, content, schema, response FROM raw_rows WHERE id IS NOT NULL), c AS (UNPIVOT r ON prompt, content, schema, response INTO NAME field VALUE txt) SELECT field, count(*) AS cells, count(DISTINCT txt) AS texts FROM c GROUP BY 1")
def pii_distinct_texts(spark, d):
    """How many cells hold a text that another cell holds too."""
    raw = table(spark, d, "raw_rows", ["id", *FIELDS]).filter("id is not null")
    c = audit.cells(raw, "id", FIELDS).select("key", "field", F.sha2("text", 256).alias("h")).distinct()
    return c.groupBy("field").agg(F.count("*").alias("cells"), F.count_distinct("h").alias("texts"))


@query("event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return incremental.windowed_counts(table(spark, d, "events", ["ts", "event_type"]), "ts", "1 hour", "1 day", ["event_type"])


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END s FROM events), k AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g) SELECT min(ts) AS session_start, user_id, count(*) AS n FROM k GROUP BY user_id, k")
def event_sessions(spark, d):
    return incremental.sessions(table(spark, d, "events", ["ts", "user_id"]), "ts", "30 minutes", ["user_id"])
