"""JSON scoring and diffs over tables.

One Arrow pass per row computes all measures together, so texts cross to Python once; everything after it is native.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions import leaves as L
from leafloom.functions.jsontext import NOTHING, find_value
from leafloom.operators.corpus import sample
from leafloom.operators.quantiles import quantile_rows

SCORES = ("is_valid_json", "is_schema_compliant", "key_precision", "key_recall", "key_f1", "missing_keys", "extra_keys", "value_score", "overall_bleu")
CHANGES = ("chg_missing_convention", "chg_orig_missing_regen_content", "chg_orig_content_regen_missing", "chg_case_whitespace_only", "chg_numeric_format", "chg_content_rewrite")


@lru_cache(maxsize=4096)
def _value(text: str | None):
    """The JSON value of a text, strings that hold JSON opened; ``NOTHING`` if there is none."""
    return find_value(text, container=False)


def _batch(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, columns.values())], names=list(columns))


def extracted(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys..., json``: the JSON in each text; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.array([None if t is None else L.json_in(t) for t in b.column(len(keys)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], out], names=[*keys, "json"])

    x = df.select(*keys, text)
    kinds = dict(x.dtypes)
    return x.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", json string")


def validated(df: DataFrame, key: str, text: str, schema: str) -> DataFrame:
    """``key, is_valid, is_compliant, error``; rows with null text or unreadable schema are not compliant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t, s in zip(*(c.to_pylist() for c in b.columns)):
                sv = _value(s)
                rows.append((k, *(L.validity(t, sv) if sv is not NOTHING else (L.validity(t, True)[0], False, "no schema"))) if t is not None else (k, False, False, "no text"))
            yield _batch({"key": pa.string(), "is_valid": pa.bool_(), "is_compliant": pa.bool_(), "error": pa.string()}, rows)

    return df.select(F.col(key).cast("string").alias("key"), text, schema).mapInArrow(run, "key string, is_valid boolean, is_compliant boolean, error string")


def scored(df: DataFrame, keys: list[str], pred: str, schema: str, true: str) -> DataFrame:
    """``keys...`` and the nine scores; rows without true value have none, a null prediction counts as invalid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for b in batches:
            got = []
            for p, s, t in zip(*(c.to_pylist() for c in b.columns[n:])):
                tv, sv = _value(t), _value(s)
                if tv is NOTHING:
                    got.append((None,) * len(SCORES))
                    continue
                x = L.all_scores(p if p is not None else "", True if sv is NOTHING else sv, tv)
                got.append(tuple(x[k] for k in SCORES))
            cols = list(zip(*got)) or [()] * len(SCORES)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(c, pa.float64()) for c in cols]], names=[*keys, *SCORES])

    x = df.select(*keys, pred, schema, true)
    kinds = dict(x.dtypes)
    return x.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + "".join(f", {s} double" for s in SCORES))


_DIFF = {
    "orig_valid_json": pa.bool_(), "orig_compliant": pa.bool_(), "regen_valid_json": pa.bool_(), "regen_compliant": pa.bool_(), "orig_chars": pa.int64(), "regen_chars": pa.int64(),
    "jaccard": pa.float64(), "top_jaccard": pa.float64(), "identical_keys": pa.bool_(),
} | dict.fromkeys(("n_keys_orig", "n_null_orig", "n_missing_orig", "n_keys_regen", "n_null_regen", "n_missing_regen", "n_shared", "n_changed", *CHANGES), pa.int64())


def _ddl(t: pa.DataType) -> str:
    return {pa.bool_(): "boolean", pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string"}[t]


def compared(pairs: DataFrame, key: str, schema: str, before: str, after: str, flag: str) -> DataFrame:
    """One row per pair with validity, lengths, key overlap and counts of changed leaves by class; ``flag`` is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, f, s, x, y in zip(*(c.to_pylist() for c in b.columns)):
                sv = _value(s)
                got = L.compare(True if sv is NOTHING else sv, x, y)
                both = got["orig_valid_json"] and got["regen_valid_json"]
                rows.append((k, f, *[got.get(c, 0 if both else None) for c in _DIFF]))
            yield _batch({"key": pa.string(), "flag": pa.bool_()} | _DIFF, rows)

    x = pairs.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(flag).alias("flag"), schema, before, after)
    return x.mapInArrow(run, "key string, flag boolean, " + ", ".join(f"{k} {_ddl(t)}" for k, t in _DIFF.items()))


def diff_summary(diffs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rates and means over the pairs in one aggregate, and the median Jaccard similarity; ratios are of sums.

    ``by`` must have few values.
    """
    name = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("all")
    diffs = diffs.withColumn("_set", name)
    both = F.col("jaccard").isNotNull()
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    ratio = lambda a, b: F.round(F.try_divide(F.sum(a), F.sum(b)), 6)
    same = F.col("n_changed") == 0
    out = [
        F.count("*").alias("pairs"), *[rate(F.col(c)).alias(f"{c}_rate") for c in ("orig_valid_json", "regen_valid_json", "orig_compliant", "regen_compliant")],
        F.round(F.avg("jaccard"), 6).alias("mean_jaccard"), F.round(F.avg("top_jaccard"), 6).alias("mean_top_jaccard"),
        rate(F.col("identical_keys")).alias("identical_keys_rate"), rate(F.when(both, F.col("n_shared") == 0)).alias("no_shared_keys_rate"),
        F.round(F.avg("n_keys_orig"), 6).alias("mean_keys_orig"), F.round(F.avg("n_keys_regen"), 6).alias("mean_keys_regen"),
        F.percentile("orig_chars", 0.5).cast("double").alias("median_chars_orig"), F.percentile("regen_chars", 0.5).cast("double").alias("median_chars_regen"),
        *[ratio(f"n_{k}_{s}", f"n_keys_{s}").alias(f"{k}_leaf_rate_{s}") for k in ("null", "missing") for s in ("orig", "regen")],
        ratio("n_changed", "n_shared").alias("value_change_rate"), rate(F.when(both, F.col("identical_keys") & same)).alias("identical_pairs_rate"), rate(F.when(both, same)).alias("no_value_change_rate"),
        *[F.round(F.sum(c) / F.greatest(F.sum("n_changed"), F.lit(1)), 6).alias(f"{c}_rate") for c in CHANGES],
    ]
    median = quantile_rows(diffs.select(F.col("_set").alias("g"), F.col("jaccard").alias("v")), {"median_jaccard": 0.5}, "_set")
    median = median.select("_set", F.round("median_jaccard", 6).alias("median_jaccard"))
    table = diffs.groupBy("_set", *by).agg(*out) if by else diffs.agg(*out).withColumn("_set", F.lit("all"))
    return table.join(F.broadcast(median), "_set", "left").drop("_set")  # a row for each group


def soft_means(pairs: DataFrame, key: str, before: str, after: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """Over a sample of ``n`` pairs the mean key precision, recall and F1 of the later answer against the earlier one.

    Pairs with an answer that is no JSON count as empty objects, as everywhere; null answers are no pairs.
    """
    x = pairs.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).select(F.col(key).cast("string").alias("key"), before, after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key_precision", "key_recall", "key_f1")
        for b in batches:
            rows = []
            for old, new in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                s = L.scores(L.without_repeated_keys(new), L.without_repeated_keys(old))
                rows.append(tuple(s[c] for c in names))
            yield _batch(dict.fromkeys(names, pa.float64()), rows)

    got = sample(x, "key", n, seed).mapInArrow(run, "key_precision double, key_recall double, key_f1 double")
    return got.agg(*[F.round(F.avg(c), 4).alias(f"sample_{c}") for c in ("key_precision", "key_recall", "key_f1")], F.count("*").alias("sample_n"))


def rewrites(pairs: DataFrame, key: str, before: str, after: str, most: int = 2000) -> DataFrame:
    """The leaves whose content was rewritten: ``leaf_id, key, path, orig, regen, heuristic``, values cut to ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, x, y in zip(*(c.to_pylist() for c in b.columns)):
                fa, fb = (L.leaves(L.rooted(L.without_repeated_keys(t))) for t in (x, y))
                for path in fa.keys() & fb.keys():
                    o, r = L.plain(fa[path]), L.plain(fb[path])
                    if L.canon(o) != L.canon(r) and L.change_class(o, r) == "chg_content_rewrite":
                        cut = [(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":")))[:most] for v in (o, r)]
                        rows.append((L.leaf_id(path, o, r), k, path, *cut, L.rewrite_label(o, r)))
            yield _batch(dict.fromkeys(("leaf_id", "key", "path", "orig", "regen", "heuristic"), pa.string()), rows)

    x = pairs.filter(F.col(before).isNotNull() & F.col(after).isNotNull()).select(F.col(key).cast("string").alias("key"), before, after)
    return x.mapInArrow(run, "leaf_id string, key string, path string, orig string, regen string, heuristic string")


def extrapolated(labels: DataFrame, judged: DataFrame) -> DataFrame:
    """Shares of the heuristic labels; the share of ``needs_judge`` is spread over the verdicts that judged leaves got.

    ``judged`` has ``leaf_id, judge, manual``; a manual verdict goes before the judge's.
    """
    counts = labels.groupBy("heuristic").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    rest = counts.agg(F.coalesce(F.sum(F.when(F.col("heuristic") == "needs_judge", F.col("n"))), F.lit(0))).scalar()
    verdicts = judged.select(F.coalesce("manual", "judge").alias("verdict")).filter("verdict is not null").groupBy("verdict").agg(F.count("*").alias("v"))
    sure = counts.filter("heuristic <> 'needs_judge'").select(F.col("heuristic").alias("label"), (F.col("n") / total).alias("share"))
    spread = verdicts.select(F.concat(F.lit("judged_"), "verdict").alias("label"), (rest / total * F.col("v") / verdicts.agg(F.sum("v")).scalar()).alias("share"))
    return sure.unionByName(spread)


def annotation_problems(sheet: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """``key, problem`` of every line of a sheet: missing, unverified, invalid (no JSON), not_compliant, or ok.

    ``annotations`` has ``key, verified, gold, schema``; a key annotated twice counts once.
    """
    a = annotations.dropDuplicates([key])
    v = validated(a, key, "gold", "schema").withColumnRenamed("key", "_k")
    x = sheet.select(key).join(a.select(key, "verified"), key, "left").join(v, F.col(key).cast("string") == F.col("_k"), "left")
    return x.select(key, F.when(F.col("verified").isNull(), "missing").when(~F.col("verified"), "unverified").when(~F.col("is_valid"), "invalid").when(~F.col("is_compliant"), "not_compliant").otherwise("ok").alias("problem"))


def edits(pairs: DataFrame, key: str, draft: str, gold: str, stratum: str) -> DataFrame:
    """Per stratum the pairs, leaves added, removed and changed from draft to gold, and the share of edited pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, g, x, y in zip(*(c.to_pylist() for c in b.columns)):
                d = L.leaf_diff(*(L.leaves(L.rooted(L.without_repeated_keys(t or "{}"))) for t in (x, y)))
                rows.append((k, g, d["added"], d["removed"], d["changed"]))
            yield _batch({"key": pa.string(), "stratum": pa.string()} | dict.fromkeys(("added", "removed", "changed"), pa.int64()), rows)

    x = pairs.select(F.col(key).cast("string").alias("key"), F.col(stratum).cast("string").alias("stratum"), draft, gold)
    d = x.mapInArrow(run, "key string, stratum string, added bigint, removed bigint, changed bigint")
    any_edit = (F.col("added") + F.col("removed") + F.col("changed") > 0).cast("int")
    return d.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("added", "removed", "changed")], F.round(F.avg(any_edit), 6).alias("edited_share"))


def pair_units(pairs: DataFrame) -> DataFrame:
    """Each pair (``pair_id, schema, page, chunk, before, after``) as two units: the old answer on its page, the new on its chunk."""
    unit = lambda kind, content, response: F.struct(F.lit(kind).alias("kind"), F.col(content).alias("content"), F.col(response).alias("response"))
    x = pairs.select("pair_id", "schema", F.explode(F.array(unit("pair_orig", "page", "before"), unit("pair_regen", "chunk", "after"))).alias("u"))
    return x.select(F.concat_ws("-", F.col("u.kind"), "pair_id").alias("unit_id"), "pair_id", "schema", "u.*")
