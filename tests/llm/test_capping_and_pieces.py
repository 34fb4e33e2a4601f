import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import capping, pieces


def brute(ids, quality, percent):
    cap = max(1, len(ids) * percent // 100)
    rank = lambda k: (-quality[k] if quality.get(k) is not None else 1, k)
    gone = {}
    for what, col in (("source", 0), ("schema_hash", 1)):
        groups = {}
        for k, v in ids.items():
            if v[col] is not None and k not in gone:
                groups.setdefault(v[col], []).append(k)
        for ks in groups.values():
            for k in sorted(ks, key=rank)[cap:]:
                gone[k] = what
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    hosts = [None] + ["hot.example"] * 6 + [f"s{i}.test" for i in range(40)]
    ids = {f"{i:04d}": (r.choice(hosts), r.choice([None, "h1", "h1", "h1"] + [f"h{i}" for i in range(2, 30)])) for i in range(400)}
    quality = {k: r.choice([0.1, 0.5, 0.5, 0.9, None]) for k in ids if r.random() < 0.8}
    raw = [(k, v[0] and f"https://www.{v[0]}/x", v[1]) for k, v in ids.items()]
    df = spark.createDataFrame(raw + raw[:20] + [(None, "https://hot.example", "h1")], "id string, source string, schema_hash string").withColumn("c", F.lit("clash"))
    q = spark.createDataFrame([(k, x, 2) for k, x in quality.items()] + [(k, 1.0, 1) for k in list(quality)[:50]], "id string, quality double, scored_at int")
    got = {x.id: x.capped_by for x in capping.cap_contributors(df, q, 5).collect()}
    assert got == brute(ids, quality, 5)


def test_nothing_to_cap(spark):
    df = spark.createDataFrame([], "id string, source string, schema_hash string")
    q = spark.createDataFrame([], "id string, quality double, scored_at int")
    assert capping.cap_contributors(df, q).count() == 0
    with pytest.raises(ValueError):
        capping.beyond_cap(df, "source", 0, "schema_hash", "id")


def check(text, parts, limit, overlap):
    assert all(len(p.piece) <= limit for p in parts) and len(parts) > 1
    assert "".join(p.piece[p.overlap :] for p in parts) == text
    for a, b in zip(parts, parts[1:]):
        assert b.overlap <= overlap and a.piece.endswith(b.piece[: b.overlap]) and text[b.piece_start :].startswith(b.piece)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ab .\n,!。é𝒩", min_size=1, max_size=60), min_size=20, max_size=60))
def test_pieces_join_to_the_text(spark, chunks_):
    text = "x" + "".join(chunks_)
    df = spark.createDataFrame([(1, text)], "k int, t string")
    parts = pieces.split_pieces(df, ["k"], "t", 200, 20).orderBy("piece_no").collect()
    if len(text) > 200:
        check(text, parts, 200, 20)
    else:
        assert parts == []


def test_boundaries(spark):
    text = ("First paragraph with words. " * 5).strip() + "\n\n" + "Second one, also with words. " * 8
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "y" * 200), (5, "z" * 100_000)], "k int, t string").withColumn("piece", F.lit("clash"))
    got = pieces.split_pieces(df, ["k"], "t", 200, 20).orderBy("k", "piece_no").collect()
    one = [p for p in got if p.k == 1]
    check(text, one, 200, 20)
    assert one[0].piece.endswith("\n\n") and {p.k for p in got} == {1, 5}
    check("z" * 100_000, [p for p in got if p.k == 5], 200, 20)
    assert one[1].piece[: one[1].overlap].lstrip()[:1] != "" and not one[1].piece[0].isspace() or one[1].overlap <= 20
    assert sorted(r.k for r in pieces.oversized(df, "k", "t", 200, 20).collect()) == [1, 5]
    for limit, overlap in ((10, 10), (10, -1), (60, 10)):
        with pytest.raises(ValueError):
            pieces.split_pieces(df, ["k"], "t", limit, overlap)
