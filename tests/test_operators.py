import json

import pytest
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.functions.urls import host_of, last_two_labels, root_domain
from leafloom.operators import align, audit, concentration, corpus, judging, nested, ranking, runs, scoring, stats


def test_chunks(spark, rows):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "ab")], "k int, t string")
    got = rows(T.chunks(df, "t", 4, 1).select("k", "chunk_no", "chunk_start", "chunk"))
    assert got == [(1, 0, 0, "abcd"), (1, 1, 3, "defg"), (1, 2, 6, "ghij"), (1, 3, 9, "j"), (4, 0, 0, "ab")]
    assert rows(T.chunks(df, "t", 4, 1, keep_short=True).filter("k = 2").select("chunk")) == [("",)]
    with pytest.raises(ValueError):
        T.chunks(df, "t", 4, 4)


def test_bins_and_messages(spark):
    df = spark.createDataFrame([(0.0,), (50.0,), (1000.0,), (None,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(T.score_bucket(F.col("x"))).collect()] == ["0-50", "50-100", "1000+", "unknown", "1000+"]
    edges, labels = (0, 50, 100, 200, 500, 1000, float("inf")), ("<50", "b", "c", "d", "500-1k", "e")
    assert [r[0] for r in df.select(T.right_closed_bin(F.col("x"), edges, labels)).collect()] == [None, "<50", "500-1k", None, None]
    e = spark.createDataFrame([('schema_rejected: x output_format.schema: too deep 12345"',), ("Error request_id: abc99 at 77777",), (None,)], "e string")
    assert [r[0] for r in e.select(T.normalized_error(F.col("e"))).collect()] == ["too deep <n>", "Error at <n>", ""]
    m = spark.createDataFrame([("N/A",), (" Not specified yet",), ("x",), (None,)], "e string")
    assert [r[0] for r in m.select(T.is_missing_text(F.col("e"))).collect()] == [True, True, False, True]
    assert df.select(T.clipped(F.lit("abcdef"), 3, "…")).first()[0] == "abc…" and T.request_options("none", F.lit("x")) is not None
    with pytest.raises(ValueError):
        T.request_options("other", F.lit("x"))


def test_urls(spark):
    cases = {
        "blog.example.com/x": ("blog.example.com", "example.com"), "HTTP://User@WWW.Ex.org.:80/p": ("www.ex.org", "ex.org"), "http://127.0.0.1/x": ("127.0.0.1", None), "localhost:8080": ("localhost", None),
        "ftp://a.com": (None, None), "": (None, None), None: (None, None), "mailto:a@b.com": (None, None), "  https://a.b.co.uk/x ": ("a.b.co.uk", "co.uk"), "n/a": ("n", None), "file:///tmp/x": (None, None), "http://": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r[0]: (r[1], r[2]) for r in df.select("s", host_of(F.col("s")), last_two_labels(F.col("s"))).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in cases.items()}
    assert all(got[k][0] == v[0] for k, v in cases.items() if v[0])
    assert df.filter("s like '%co.uk%'").select(root_domain(F.col("s"))).first()[0] == "b.co.uk"


def test_statistics(spark):
    df = spark.createDataFrame([("a",), ("b",)] + [("c",)] * 8 + [(None,)], "k string")
    got = {r.metric: r.value for r in concentration.concentration(df, "k").collect()}
    assert got["gini"] == pytest.approx(0.466667) and got["hhi"] == pytest.approx(0.66) and got["singletons"] == 2 and got["top_1_share"] == 0.8
    even = spark.createDataFrame([(i % 5,) for i in range(20)], "k int")
    assert {r.metric: r.value for r in concentration.concentration(even, "k").collect()}["gini"] == 0
    x = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "v double")
    d = stats.describe(x, ["v"]).first()
    assert (d.n, d.p25, d.p50, d.max) == (4, 1.75, 2.5, 10.0)
    assert {r.bin: r.n for r in stats.histogram(x, "v", 3).collect()} == {1: 3, 3: 1}
    t = {r.k: r.n for r in stats.top_and_other(df, "k", 1).collect()}
    assert t == {"c": 8, "Other": 2}
    b = stats.bootstrap_interval(spark.range(200).select((F.col("id") % 2).cast("double").alias("v"), "id"), "v", [], 300).first()
    assert b.mean == 0.5 and 0.4 < b.lo < 0.5 < b.hi < 0.6
    assert [r.tier for r in concentration.tiers(df, "k", 1, 2).orderBy("k").collect()].count("head") == 8


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k string, v double, t string")
    assert stats.describe(df, ["v"]).first().n == 0 and stats.histogram(df, "v").count() == 0 and stats.top_and_other(df, "k", 2).count() == 0
    assert concentration.concentration(df, "k").count() > 0 and corpus.sample(df, "k", 3, 1).count() == 0
    assert ranking.rank_in_groups(df, "k", [F.col("v")]).count() == 0


def test_quotas_and_samples(spark):
    assert corpus.quotas({"A": 6, "B": 3, "C": 1}, 5) == {"A": 2, "B": 2, "C": 1}
    for n in (3, 4, 7, 10, 50):
        assert sum(corpus.quotas({"a": 30, "b": 15, "c": 5}, n).values()) == n
    df = spark.range(50).select("id", F.when(F.col("id") < 40, "a").when(F.col("id") < 49, "b").alias("s"))
    got = corpus.stratified_sample(df, "id", "s", 10, 1)
    assert got.count() == 10 and got.select("id").distinct().count() == 10 and got.filter("s is null").count() == 1
    again = corpus.stratified_sample(df.repartition(7), "id", "s", 10, 1)
    assert {r.id for r in got.collect()} == {r.id for r in again.collect()}
    assert corpus.half_short_half_long(10, 100, 2) == (8, 2) and corpus.half_short_half_long(10, 1, 100) == (1, 9)
    split = corpus.hash_split(df, F.col("id"), 10, 42)
    assert {r.split for r in split.collect()} <= {"train", "test"}


def test_prepared_chunks_reassemble(spark):
    page = "".join(chr(97 + i % 26) for i in range(30_000))
    df = spark.createDataFrame([("x", page, "{}", "{}"), ("y", None, "{}", "{}"), ("z", "a" * 50_001, "{}", "{}")], "id string, content string, schema string, response string")
    size, overlap = T.chunk_geometry()
    parts = corpus.prepared(df).orderBy("chunk_no").collect()
    assert (size, overlap) == (14336, 448) and {r.id for r in parts} == {"x"}
    assert "".join(r.content[: size - overlap] for r in parts[:-1]) + parts[-1].content == page
    assert {r.reason: r.n for r in corpus.funnel(df).collect()} == {"kept": 1, "content": 2}
    assert len({r.split for r in corpus.prepared(df, page_level=True).collect()}) == 1


def test_ranks_match_brute_force(spark):
    data = [(i, "hot" if i % 3 else f"g{i % 7}", (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(data, "id int, g string, s int")
    got = {r.id: r.rank for r in ranking.rank_in_groups(df, "g", [F.col("s").desc(), F.col("id")]).collect()}
    want = {}
    for g in {x[1] for x in data}:
        for k, x in enumerate(sorted((x for x in data if x[1] == g), key=lambda x: (-x[2], x[0]))):
            want[x[0]] = k
    assert got == want


def test_alignment_and_leaks(spark, rows):
    page = "p" * 1200 + "q" * 300
    pages = spark.createDataFrame([("1", "s", page, "r1"), ("2", "s", "short", "r2"), ("3", "s", "short", "r3"), ("4", None, None, None)], "id string, schema string, content string, response string")
    rec = spark.createDataFrame(
        [(1, "train", "s", page[:1000], "r1"), (2, "test", "s", "p" * 1100 + "x", "r9"), (3, "test", "s", "short", "r2"), (4, "test", "t", "short", "q"), (5, "train", None, None, None), (6, "test", "s", page[900:], "r1")],
        "ft_id int, split string, schema string, content string, response string",
    )
    got = {r.ft_id: (r.match, r.response) for r in align.alignment(rec, pages, 1000, 100).collect()}
    assert got == {1: ("exact", "r1"), 2: ("prefix", "r1"), 3: ("ambiguous", None), 4: ("unmatched", None), 5: ("unmatched", None), 6: ("exact", "r1")}
    ex = align.exact_matches(rec, pages, 1000, 100)
    m = ex.unionByName(align.prefix_matches(rec, pages, ex))
    assert {r.ft_id: r.reason for r in align.leak_reasons(rec, m).collect()} == {2: "sibling_page", 3: "clean", 4: "clean", 6: "same_schema_response"}
    assert rows(align.set_difference(rec.filter("ft_id < 3"), rec.filter("ft_id > 1"), "ft_id").filter("side = 'extra'")) == [(1, "extra")]


def test_runs(spark, rows):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None)], "k int, v string, o int")
    assert rows(runs.last_wins(df, ["k"], ["o"])) == [(1, "b", 2), (2, "c", None)]
    g = spark.createDataFrame([("0-50", 9, 300), (None, None, None)], "complexity_bucket string, schema_depth int, schema_keys int")
    assert sorted(r.grp for r in runs.in_groups(g).collect()) == ["0-50", "depth>=7", "keys>=200", "overall", "overall"]
    done = spark.createDataFrame([(1, None), (2, "boom")], "k int, error string")
    plan = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert rows(runs.still_to_do(plan, done, "k", False)) == [(3,)] and rows(runs.still_to_do(plan, done, "k", True)) == [(2,), (3,)]


def test_agreement(spark):
    mk = lambda ts: spark.createDataFrame(list(enumerate(ts)), "u int, tier string")
    r = judging.agreement(mk("ggsr"), mk("gssr"), "u", "tier").first()
    assert (r.n, r.agreement, r.kappa) == (4, 0.75, 0.636364)
    assert judging.agreement(mk("gs"), mk("gs"), "u", "tier").first().kappa == 1 and judging.agreement(mk("gg"), mk("gg"), "u", "tier").first().kappa is None
    assert judging.agreement(mk("g").filter("u < 0"), mk("g"), "u", "tier").first().n == 0
    j = spark.createDataFrame([("u", "j", [("a", "x"), ("a", "y"), ("zz", "x")]), ("v", "j", [])], "unit_id string, judge_model string, leaves array<struct<key:string,verdict:string>>")
    fv = judging.first_verdicts(j, ["unit_id", "judge_model"])
    assert sorted((r.leaf, r.verdict) for r in fv.collect()) == [("a", "x"), ("zz", "x")]
    found = judging.response_leaves(spark.createDataFrame([("u", '{"a": "N/A"}'), ("v", None)], "unit_id string, response string"), "unit_id", "response")
    assert {(r.kind, r.n) for r in judging.leaf_counts(fv, found).collect()} == {("missing", 1), ("unmatched", 1)}


def test_leaf_rates(spark):
    text = json.dumps({"a": 1, "b": "x", "c": None, "d": {}, "e": "N/A"})
    found = judging.response_leaves(spark.createDataFrame([("u", text), ("v", text)], "unit_id string, response string"), "unit_id", "response")
    said = [("u", "j", "a", "supported"), ("u", "j", "b", "hallucinated"), ("u", "j", "c", "correctly_missing"), ("u", "j", "e", "supported"), ("u", "j", "zz", "hallucinated"), ("v", "j", "a", "missed_in_content"), ("v", "k", "a", "supported")]
    verdicts = spark.createDataFrame(said, "unit_id string, judge_model string, leaf string, verdict string")
    units = spark.createDataFrame([("u", "j"), ("v", "j"), ("w", "j"), ("v", "k")], "unit_id string, judge_model string")
    r = {x.judge_model: x for x in judging.leaf_rates(verdicts, found, units).collect()}
    j = r["j"]
    assert (j.n_filled_leaves, j.n_missing_leaves, j.n_unmatched_leaf_keys) == (3, 2, 1)
    assert (j.filled_supported_rate, j.filled_hallucinated_rate, j.filled_crossover_rate) == (0.3333, 0.3333, 0.3333)
    assert (j.missing_correctly_missing_rate, j.missing_crossover_rate, j.units_with_any_hallucination_rate) == (0.5, 0.5, 0.3333)
    assert r["k"].units_with_any_hallucination_rate == 0 and r["k"].filled_supported_rate == 1


def test_bootstrap(spark):
    rows = [("a", float(i % 4 == 0)) for i in range(400)] + [("b", 1.0)] * 5 + [("c", None), (None, 2.0)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, v double, i int")
    one, two = (sorted(((r.g, r.mean, r.n, r.lo, r.hi) for r in stats.bootstrap_interval(df.repartition(p), "v", ["g"]).collect()), key=str) for p in (1, 5))
    assert one == two  # the draws don't depend on the partitions
    by = {g: x for g, *x in one}
    mean, n, lo, hi = by["a"]
    assert (mean, n) == (0.25, 400) and abs(lo - 0.2075) < 0.01 and abs(hi - 0.2925) < 0.01  # 1.96 deviations of 0.0217 around it
    assert by["b"] == [1.0, 5, 1.0, 1.0] and by["c"] == [None, 0, None, None] and by[None][0] == 2.0
    assert stats.bootstrap_interval(df, "v", []).first().n == 406 and stats.bootstrap_interval(df.limit(0), "v", ["g"]).count() == 0


def test_rejections_against_a_plan(spark):
    cols = "model string, idx int, complexity_bucket string, schema_depth int, schema_keys int, schema_rejected boolean, api_error string, is_schema_compliant double, key_f1 double"
    done = spark.createDataFrame([("m", 1, "0-50", 1, 1, False, None, 1.0, 0.5), ("m", 2, "0-50", 1, 1, True, "rate limit", 1.0, 0.5)], cols)
    planned = spark.createDataFrame([(i, "0-50", 1, 1) for i in range(4)], "idx int, complexity_bucket string, schema_depth int, schema_keys int")
    r = {x.grp: x for x in runs.rejection_table(done, planned).collect()}
    assert all((x.n_planned, x.n_done, x.e2e_strict_done, x.e2e_strict_planned) == (4, 2, 0.5, 0.25) for x in r.values()) and set(r) == {"overall", "0-50"}


def test_soft_means(spark):
    df = spark.createDataFrame([(1, '{"a":1,"b":2}', '{"a":1}'), (2, '{"a":1}', "no json"), (3, None, "{}")], "k int, x string, y string")
    r = scoring.soft_means(df, "k", "x", "y").first()
    assert (r.sample_key_precision, r.sample_key_recall, r.sample_key_f1, r.sample_n) == (0.5, 0.25, 0.3333, 2)


def test_page_quotas_and_calibration(spark):
    df = spark.createDataFrame([(i, "head" if i < 30 else "tail", i % 10 == 0) for i in range(40)], "id int, tier string, long boolean")
    assert corpus.page_quotas(df, "tier", "long", {"head": 10, "tail": 4, "torso": 3}) == {"head/short": 7, "head/long": 3, "tail/short": 3, "tail/long": 1, "torso/short": 0, "torso/long": 0}
    got = corpus.calibration(df.withColumn("n", F.col("id")), "id", F.col("n"), pool=20, most_tokens=25, n=5)
    assert got.count() == 5 and got.filter("n > 25").count() == 0


def test_nested_tables(spark, rows):
    doc = {"a.b": {"c": 1, "d": {"e": [{"x": 1}, {"x": 2, "y": {}}]}}, "t": [[{"z": 1}]], "r": {"r": {"v": 1}}}
    rec = spark.createDataFrame([("response", "1", json.dumps(doc)), ("response", "1", json.dumps(doc)), ("response", "2", None), ("response", None, "{}"), ("response", "3", "prose"), ("response", "4", "[]")], "rec_kind string, rec_key string, text string")
    got = {(r.node_path, r.parent_path) for r in nested.node_rows(rec.withColumn("node_path", F.lit(1))).collect()}
    assert got == {
        ("$", ""), ("$.a\\.b", "$"), ("$.a\\.b.d", "$.a\\.b"), ("$.a\\.b.d.e[0]", "$.a\\.b.d"), ("$.a\\.b.d.e[1]", "$.a\\.b.d"), ("$.a\\.b.d.e[1].y", "$.a\\.b.d.e[1]"), ("$.t[0][0]", "$"), ("$.r", "$"), ("$.r.r", "$.r"),
    }
    assert nested.node_rows(rec).count() == 9
    objects = nested.parsed_objects(rec)
    graph = nested.shared_inlining(objects)
    why = {r.type_path: (r.reason, r.table_path) for r in graph.collect()}
    assert why["$.a\\.b"] == (None, "$") and why["$.a\\.b.d.e[]"][0] == "repeated" and why["$.r.r"][0] == "recursive" and why["$.a\\.b.d.e[].y"] == (None, "$.a\\.b.d.e[]")
    tables = nested.relational_rows(objects, graph)
    top = tables.filter("table_path = '$'").first()
    assert top.columns["a\\.b.c"] == "1"
    e = sorted(rows(nested.one_table(tables, "response", "$.a\\.b.d.e[]", ["x"])))
    assert [(x[1], x[3]) for x in e] == [("$.a\\.b.d.e[0]", "1"), ("$.a\\.b.d.e[1]", "2")]
    assert nested.node_rows(rec.limit(0)).count() == 0


def test_very_deep_json(spark):
    depth = 300
    text = '{"a":' * depth + "1" + "}" * depth
    rec = spark.createDataFrame([("response", "1", text), ("response", "2", "[" * 100_000)], "rec_kind string, rec_key string, text string")
    assert nested.node_rows(rec).count() == depth


def test_audit(spark, rows):
    find = lambda text: [("name", 10, 40, "model")] if len(text) > 40 else []
    second = lambda text: [("secret", 12, 30, "re"), ("secret", 50, 70, "re")] if len(text) > 70 else []
    df = spark.createDataFrame([("1", "x" * 80, None), ("2", "x" * 80, "y")], "id string, a string, b string")
    got = audit.spans(audit.cells(df, "id", ["a", "b"]), find, second)
    assert rows(got.filter("key = '1'").select("start", "stop")) == [(10, 40), (50, 70)] and got.count() == 4
    twice = got.unionByName(got.withColumn("detector", F.lit("zz")))
    assert audit.once(twice).count() == 4
    m = {(r.label, r.field): (r.spans, r.rows, r.sum_over_fields) for r in audit.matrix(got, ["name", "secret", "other"], ["a", "b"]).collect()}
    assert m["name", "a"] == (2, 2, 2) and m["other", "b"] == (0, 0, 0)
    d = audit.pattern_detector(audit.SECRETS, "secret")
    assert [x[3] for x in d("key AKIA" + "A" * 16 + " and sk-" + "a" * 20)] == ["aws_access_key", "openai_key"]
    chunked = audit.spans(audit.cells(df, "id", ["a"]), audit.pattern_detector({"w": "x{5}"}), lambda t: [], 20, 10)
    assert chunked.select("start", "stop").distinct().count() >= 16


def test_scoring_tables(spark):
    df = spark.createDataFrame(
        [("1", '{"a": 1}', '{"type": "object", "required": ["a"]}', '{"a": 1}'), ("2", None, None, '{"a": 1}'), ("3", "{", "{}", "[1]"), ("4", "{}", "{}", None)], "k string, p string, s string, t string"
    )
    got = {r.k: r for r in scoring.scored(df, ["k"], "p", "s", "t").collect()}
    assert got["1"].key_f1 == 1 and got["1"].is_schema_compliant == 1 and got["2"].is_valid_json == 0 and got["4"].key_f1 is None
    v = {r.key: (r.is_valid, r.is_compliant) for r in scoring.validated(df, "k", "p", "s").collect()}
    assert v == {"1": (True, True), "2": (False, False), "3": (False, False), "4": (True, True)}
    pairs = spark.createDataFrame([("1", True, "{}", '{"a": "Hello there, you two", "b": 1}', '{"a": "Hello there, you two and more", "b": 1.0}')], "k string, f boolean, s string, x string, y string")
    s = scoring.diff_summary(scoring.compared(pairs, "k", "s", "x", "y", "f")).first()
    assert s.value_change_rate == 1 and s.chg_numeric_format_rate == 0.5 and s.mean_jaccard == 1
    r = scoring.rewrites(pairs, "k", "x", "y").collect()
    assert [x.heuristic for x in r] == ["completion"]
    labels = spark.createDataFrame([("completion",), ("needs_judge",), ("needs_judge",), ("formatting",)], "heuristic string")
    judged = spark.createDataFrame([("l1", "equivalent", None), ("l2", "equivalent", "partial")], "leaf_id string, judge string, manual string")
    assert {x.label: x.share for x in scoring.extrapolated(labels, judged).collect()} == {"completion": 0.25, "formatting": 0.25, "judged_equivalent": 0.25, "judged_partial": 0.25}
    units = scoring.pair_units(spark.createDataFrame([(1, "s", "page", "chunk", "b", "a")], "pair_id int, schema string, page string, chunk string, before string, after string"))
    assert sorted((u.kind, u.content, u.response) for u in units.collect()) == [("pair_orig", "page", "b"), ("pair_regen", "chunk", "a")]


def test_gold_and_judge_helpers(spark, rows):
    sheet = spark.createDataFrame([(i,) for i in range(5)], "hb int")
    notes = spark.createDataFrame([(0, True, "{}", "{}"), (1, False, "{}", "{}"), (2, True, "{", "{}"), (3, True, "[]", '{"type": "object"}'), (0, True, "{}", "{}")], "hb int, verified boolean, gold string, schema string")
    assert rows(scoring.annotation_problems(sheet, notes, "hb")) == [(0, "ok"), (1, "unverified"), (2, "invalid"), (3, "not_compliant"), (4, "missing")]
    pairs = spark.createDataFrame([("a", "s", '{"x": 1, "y": 2}', '{"x": 2, "z": 1}'), ("b", "s", "{}", "{}"), ("c", None, None, '{"q": 1}')], "k string, st string, d string, g string")
    got = {r.stratum: (r.n, r.added, r.removed, r.changed, r.edited_share) for r in scoring.edits(pairs, "k", "d", "g", "st").collect()}
    assert got == {"s": (2, 1, 1, 1, 0.5), None: (1, 1, 0, 0, 1.0)}
    pred = spark.createDataFrame([(0, 0.5), (1, 1.0), (1, 1.0), (9, 0.0)], "hb int, m double")
    r = runs.against_gold(pred, sheet, "hb", "m").first()
    assert (r.n_gold, r.n_missing, r.mean_covered, r.mean_strict) == (5, 3, 0.75, 0.3)
    assert corpus.restricted(pred, sheet, "hb").count() == 3
    texts = spark.createDataFrame([(1, "a\nb"), (2, " "), (3, None)], "k int, t string")
    assert rows(corpus.with_language(texts, "k", "t", lambda t: "xx" if t == "a b" else None)) == [(1, "xx"), (2, "unknown"), (3, "unknown")]
    found = judging.response_leaves(spark.createDataFrame([("u", json.dumps({"b": "y" * 400, "a": 1}))], "k string, t string"), "k", "t")
    lines = judging.leaf_lines(found).first().lines.split("\n")
    assert lines[1] == "a = 1" and lines[0].startswith('b = "yy') and lines[0].endswith("…") and len(lines[0]) == 305 and judging.leaf_lines(found, 1).first().lines == lines[0]
    p = spark.range(1).select(judging.judge_prompt("S {schema} C {content} L {leaves}", F.lit("{content}"), F.lit("%c"), F.lit("x")).alias("p")).first().p
    assert p == "S {content} C %c L x"
    assert [x[0] for x in texts.select(T.long_page(F.col("t"), 2)).collect()] == [True, False, False]


def test_found_objects_are_those_of_the_tables(spark, monkeypatch):
    docs = {
        "1": {"b.c": 1, "b": {"c": 2, "d": {"p": [{"q": 1}, {"q": {"p": {}}}]}}, "k\\": {"m": {"y": "\ud83d"}}, "": {"": {"": 3}}},
        "2": [{"a": {"b": 1}}, [{"a": {"b": 2}}], 3], "3": {"x[0]": {"v": 1}, "x": [{"v": 2}], "x[]": {"v": {"w": 3}}}, "4": {},
    }
    rec = spark.createDataFrame([(kind, k, json.dumps(d)) for kind in ("response", "schema") for k, d in docs.items()], "rec_kind string, rec_key string, text string")
    want = sorted((kind, k, p, q) for kind in ("response", "schema") for k, d in docs.items() for p, q, *_ in nested.walk_objects(d))
    seen = []
    for name in ("shared_inlining", "relational_rows"):
        monkeypatch.setattr(nested, name, lambda *x, f=getattr(nested, name), name=name: (seen.append(name), f(*x))[1])
    assert sorted(map(tuple, nested.node_rows(rec).collect())) == want and seen == ["shared_inlining", "relational_rows"]
    objects = nested.parsed_objects(rec)
    tables = nested.relational_rows(objects, nested.shared_inlining(objects)).collect()
    assert sorted((r.rec_kind, r.rec_key, *n) for r in tables for n in r.objects) == want
    top = next(r for r in tables if (r.rec_kind, r.rec_key, r.row_path) == ("response", "1", "$"))
    assert top.columns["b\\.c"] == "1" and top.columns["b.c"] == "2" and top.columns["k\\\\.m.y"] == "\ufffd"


def test_join_counted(spark):
    from leafloom.operators.joining import join_counted

    a, b = spark.range(20), spark.range(5, 30).withColumn("x", F.lit(1))
    ways = [join_counted(a, b, ["id"], how, most) for how in ("inner", "left_semi") for most in (0, 100)]
    assert [sorted(r.id for r in w.collect()) for w in ways] == [list(range(5, 20))] * 4
    hinted = ["strategy=broadcast" in w._jdf.queryExecution().optimizedPlan().toString() or "rightHint" in w._jdf.queryExecution().optimizedPlan().toString() for w in ways]
    assert hinted == [False, True, False, True]


def test_exact_quantiles(spark):
    import random

    import numpy as np

    from leafloom.operators.quantiles import quantiles

    r = random.Random(6)
    rows = [("a", r.random()) for _ in range(5000)] + [("b", float(r.randrange(3))) for _ in range(1000)] + [("c", 7.0), ("d", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    points = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = quantiles(df, points)
    assert set(got) == {"a", "b", "c"}
    for g in got:
        want = np.quantile([v for k, v in rows if k == g], points)
        assert np.allclose(got[g], want, atol=1e-12)
    assert quantiles(df.limit(0), points) == {}


def test_first_of_each(spark, tmp_path):
    from leafloom.operators.joining import first_of_each
    from leafloom.sources.tables import PLACE, placed_table

    rows = [(str(i % 40) if i % 11 else None, f"text {i % 40}") for i in range(100)]
    spark.createDataFrame(rows, "id string, t string").repartition(3).write.parquet(str(tmp_path / "x.parquet"))
    got = first_of_each(placed_table(spark, str(tmp_path), "x", ["id", "t"]), "id", PLACE).collect()
    assert sorted((r.id, r.t) for r in got) == sorted({r for r in rows if r[0] is not None})
    assert first_of_each(placed_table(spark, str(tmp_path), "x", ["id", "t"]).limit(0), "id", PLACE).count() == 0


def test_prefix_matches_against_brute_force(spark):
    import random

    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randint(2, 9)))
    menu = " ".join(word() for _ in range(60))
    pages = [(f"p{i}", f"s{i % 3}", menu + " ".join(word() for _ in range(r.choice([5, 300, 900])))) for i in range(40)]
    records = []
    for i in range(60):
        _, s, t = r.choice(pages)
        a = r.choice([0, r.randint(0, len(t) - 5)])
        content = t[a : a + r.choice([3, 30, 400, 1500])] + r.choice(["", " tail"])
        records.append((i, s if i % 7 else "s9", content))
    records += [(100, None, menu), (101, "s0", None), (102, "s0", "")]
    rec = spark.createDataFrame(records, "ft_id bigint, schema string, content string")
    pag = spark.createDataFrame([*pages, pages[0], ("n", None, menu), ("m", "s0", None)], "id string, schema string, content string")
    none = spark.createDataFrame([], "ft_id bigint, id string")
    got = [(x.ft_id, x.id) for x in align.prefix_matches(rec, pag, none, 1000).collect()]
    want = {(k, i) for k, s, c in records for i, z, t in pages if s == z and c and c[:1000] in t}
    assert set(got) == want and len(got) == len(want) and len(want) > 20
