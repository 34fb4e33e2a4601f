"""Chunks to pages, and leakage between splits.

Pages are cut into chunks once; (schema, chunk) pairs are joined on digests, so the shuffle carries two hashes and a
row key instead of the texts. Where that misses, records and pages that share anchors are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions.text import chunks

_DIGEST = lambda *cols: F.sha2(F.concat_ws("\0", *cols), 256)


def exact_matches(records: DataFrame, pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """``ft_id, id, full_page``: records whose schema and content equal a page's schema and one of its chunks."""
    page_chunks = chunks(pages.filter("schema is not null"), "content", size, overlap).select(
        _DIGEST("schema", "chunk").alias("k"), "id", (F.col("chunk") == F.col("content")).alias("full_page")
    ).dropDuplicates(["k", "id"])
    keys = records.filter("schema is not null and content is not null").select("ft_id", _DIGEST("schema", "content").alias("k"))
    return keys.join(page_chunks, "k").select("ft_id", "id", "full_page")


#: Anchors are the runs of ``_RUN`` characters whose hash is a multiple of ``_ONE_IN``; a record asks for ``_ASKED`` of its own.
_RUN, _ONE_IN, _ASKED = 24, 128, 4


def anchors(text: str) -> np.ndarray:
    """Hashes of the runs of characters of a text that are anchors, by their content alone; sorted, each once."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - _RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(_RUN):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
    return np.unique(h[h % np.uint64(_ONE_IN) == 0])


def _anchor_rows(df: DataFrame, key: str, text: str, most: int | None) -> DataFrame:
    """``key, s, gram, asked``: a row per anchor (the least ``most`` of them) and how many of them the key has."""
    x = df.select(key, "s", text)
    kind = dict(x.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [anchors(t)[:most] for t in b.column(2).to_pylist()]
            size = np.array([len(f) for f in found], np.int64)
            whose = pa.array(np.repeat(np.arange(len(found)), size))
            grams = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(whose), b.column(1).take(whose), pa.array(grams), pa.array(np.repeat(size, size))], names=[key, "s", "gram", "asked"])

    return x.mapInArrow(run, f"`{key}` {kind}, s string, gram bigint, asked bigint")


def prefix_matches(records: DataFrame, pages: DataFrame, exact: DataFrame, chars: int = 1000) -> DataFrame:
    """For records without exact match, pages of the same schema that contain the first ``chars`` characters.

    A page that contains the head of a record has all its anchors, so records and pages are joined by schema and anchor,
    which are narrow rows; only the texts of pairs that share all anchors asked for are compared. Heads without an anchor
    (short ones) are compared with the pages of their schema.
    """
    rest = records.filter("schema is not null and char_length(content) > 0").join(exact.select("ft_id").distinct(), "ft_id", "left_anti")
    head = rest.select("ft_id", F.md5("schema").alias("s"), F.substring("content", 1, chars).alias("head"))
    whole = pages.filter("schema is not null and content is not null").select("id", F.md5("schema").alias("s"), F.col("content").alias("page"))
    asked = _anchor_rows(head, "ft_id", "head", _ASKED)
    there = _anchor_rows(whole, "id", "page", None).drop("asked")
    pairs = asked.join(there, ["s", "gram"]).groupBy("ft_id", "id", "asked").agg(F.count_distinct("gram").alias("met")).filter("met = asked").select("ft_id", "id")
    near = pairs.join(head.select("ft_id", "head"), "ft_id").join(whole.select("id", "page"), "id")
    short = head.join(asked.select("ft_id").distinct(), "ft_id", "left_anti").join(whole, "s").select("id", "ft_id", "head", "page")
    return near.select("id", "ft_id", "head", "page").unionByName(short).filter(F.contains("page", "head")).select("ft_id", "id", F.lit(False).alias("full_page")).distinct()


def alignment(records: DataFrame, pages: DataFrame, size: int, overlap: int, chars: int = 1000) -> DataFrame:
    """``ft_id, match, n_pages, full_page, response``: one row per record.

    ``match`` is exact or prefix, ``ambiguous`` if the pages don't share one response, else ``unmatched``; only the first
    two have a response. ``full_page`` is true if all pages equal the record's content.
    """
    exact = exact_matches(records, pages, size, overlap)
    both = exact.withColumn("how", F.lit("exact")).unionByName(prefix_matches(records, pages, exact, chars).withColumn("how", F.lit("prefix")))
    per = (
        both.join(pages.select("id", "response", F.md5("response").alias("rd")), "id").groupBy("ft_id")
        .agg(F.min("how").alias("how"), F.count_distinct("id").alias("n_pages"), F.bool_and("full_page").alias("full_page"),
             F.count_distinct(F.coalesce("rd", F.lit("null"))).alias("answers"), F.min_by("response", "id").alias("answer"))
    )
    out = records.select("ft_id").join(per, "ft_id", "left")
    one = F.col("answers") == 1
    return out.select(
        "ft_id", F.when(F.col("how").isNull(), "unmatched").when(one, F.col("how")).otherwise("ambiguous").alias("match"),
        F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.when(one, F.col("full_page")).alias("full_page"), F.when(one, F.col("answer")).alias("response"),
    )


def leak_reasons(records: DataFrame, matches: DataFrame, train: str = "train", test: str = "test") -> DataFrame:
    """``ft_id, reason`` of each test record: the first of same_content, same_schema_response, sibling_page, else clean."""
    keyed = records.select("ft_id", "split", F.md5("content").alias("c"), F.md5(F.concat_ws("\0", "schema", "response")).alias("p"))
    tr, te = keyed.filter(F.col("split") == train), keyed.filter(F.col("split") == test)
    touched = matches.join(tr.select("ft_id"), "ft_id").select("id").distinct()
    siblings = matches.join(touched, "id", "left_semi").select("ft_id").distinct().withColumn("sib", F.lit(True))
    out = (
        te.join(tr.select("c").filter("c is not null").distinct().withColumn("same", F.lit(True)), "c", "left")
        .join(tr.select("p").distinct().withColumn("pair", F.lit(True)), "p", "left").join(siblings, "ft_id", "left")
    )
    return out.select("ft_id", F.when(F.col("same"), "same_content").when(F.col("pair"), "same_schema_response").when(F.col("sib"), "sibling_page").otherwise("clean").alias("reason"))


def set_difference(run: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two runs has: ``missing`` from the run or ``extra`` in it."""
    a, b = run.select(key).distinct().withColumn("a", F.lit(1)), reference.select(key).distinct().withColumn("b", F.lit(1))
    return a.join(b, key, "full_outer").filter("a is null or b is null").select(key, F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("side"))
