import random
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import leaks, overlap
from leafloom.llm.words import word_hashes, words_of


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_common_subsequence_against_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert overlap.agree_in_order(np.array(a, np.uint32), np.array(b, np.uint32)) == t[-1][-1]


def test_words():
    assert words_of("Caf&eacute; CAFÉ café **bold**") == ["cafe", "cafe", "cafe", "bold"]
    assert words_of("FÃ¼r <b>x</b>") == ["fur", "x"] and words_of("176.5 o'clock", join=True) == ["1765", "oclock"] and words_of("") == []
    assert words_of("ａｂ１") == ["ab1"]


def brute(records, least=0.75):
    from leafloom.functions.jsontext import canonical, find_value

    out = set()
    for a in records:
        for b in records:
            if a[1] == "train" and b[1] in ("test", "human_eval") and None not in (a[2], b[2], a[3], b[3]) and canonical(find_value(a[2], False)) == canonical(find_value(b[2], False)):
                x, y = words_of(a[3]), words_of(b[3])
                if x and y and overlap.agree_in_order(np.array([hash(w) & 0xFFFFFFFF for w in x], np.uint32), np.array([hash(w) & 0xFFFFFFFF for w in y], np.uint32)) >= least * max(len(x), len(y)):
                    out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_pairs_against_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    schemas = ['{"a": 1, "b": 2}', '{"b":2,"a":1}', '"{\\"a\\": 1, \\"b\\": 2}"', '{"c": 1}']
    records = []
    for i in range(60):
        base = [r.choice(vocab) for _ in range(r.randint(30, 90))]
        records.append((i, r.choice(["train", "test", "human_eval", None]), r.choice(schemas), " ".join(base)))
        edit = [w if r.random() > r.choice([0, 0.03, 0.08]) else r.choice(vocab) for w in base]
        records.append((100 + i, r.choice(["train", "test"]), r.choice(schemas), "**" + "  ".join(edit).upper() + "**!"))
    hot = " ".join(r.choice(vocab) for _ in range(50))
    records += [(300 + i, "train" if i % 2 else "test", schemas[0], hot) for i in range(12)]
    records += [(400, "train", schemas[0], None), (401, "test", None, hot), (402, "test", schemas[0], ""), (403, "test", schemas[0], "!!")]
    df = spark.createDataFrame(records + records[:5], "ft_id bigint, split string, schema string, content string").withColumn("source", F.lit("s")).withColumn("band", F.lit(1))
    found = overlap.cross_split_pairs(df)
    got = [(x.ft_id_a, x.ft_id_b) for x in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(records)
    assert {x.jaccard for x in found.filter("ft_id_a >= 300").collect()} == {1.0}
    assert overlap.overlap_report(found).agg(F.sum("n_pairs")).first()[0] == len(got)
    assert overlap.cross_split_pairs(df.limit(0)).count() == 0


def items_and_documents():
    r = random.Random(8)
    vocab = [f"t{i}" for i in range(400)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(30, 60)))) for k in range(12)]
    docs, want = [], set()
    for d in range(80):
        k, text = r.choice(items)
        w = text.split()
        n = r.choice([0, int(0.3 * len(w)), int(0.62 * len(w)), len(w)])
        part = w[r.randint(0, len(w) - n) :][:n]
        part = [x if i % 9 != 4 or i in (0, len(part) - 1) else "other" for i, x in enumerate(part)]
        around = [[r.choice(vocab) for _ in range(40)] for _ in range(2)]
        docs.append((d, " ".join(around[0]) + "\n**" + "  ".join(part).upper() + "**. " + " ".join(around[1])))
        if n > 0.5 * len(w):
            want.add((d, k))
    return items, docs, want


def test_leaks_against_what_was_planted(spark):
    items, docs, want = items_and_documents()
    it = spark.createDataFrame([*items, (98, ""), (99, None)], "item_id bigint, text string")
    df = spark.createDataFrame([*docs, docs[0], (900, None), (901, ""), (None, docs[0][1]), (902, "q " * 100_000)], "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    got = leaks.leaked_items(df, it)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    assert leaks.leaks_by_item(got).agg(F.sum("n_docs")).first()[0] == len(want)
    assert leaks.leaked_items(df.limit(0), it).count() == 0 and leaks.leaked_items(df, it.limit(0)).count() == 0
    blocks = leaks.leaked_items(df, it, block_bytes=400)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), min_size=5, max_size=9), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=40))
def test_wu_manber_against_direct_search(items, doc):
    t = leaks.ItemTables([(k, " ".join(w)) for k, w in enumerate(items)])
    hashes, _ = word_hashes([" ".join(doc)], join=True)
    number = {w: int(t.number(word_hashes([w])[0])[0]) for w in "abcd"}
    want = []
    for k, w in enumerate(items):
        least = -(-len(w) // 2)
        for places in [tuple(range(min(3, least)))] + ([(0, 1, 3, 4)] if least == 5 else []):
            want += [
                (k, i, p) for i in range(len(w) - places[-1]) for p in range(len(doc) - places[-1])
                if all(w[i + x] == doc[p + x] and number[w[i + x]] for x in places)
            ]
    assert sorted(zip(*(x.tolist() for x in t.hits(t.number(hashes))))) == sorted(want)


def test_items_of_one_word_on_are_searched(spark):
    items = [(1, "zygote"), (2, "two plus two equals"), (3, "数えてみましょう。"), (4, "alpha beta gamma delta epsilon"), (5, "...")]
    docs = [(1, "A ZYGOTE is here"), (2, "it says: two plus  **two** equals four"), (3, "今日は\n数えてみましょう。"), (4, "alpha beta gamma"), (5, "alpha and beta"), (6, "nothing")]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_more_than_a_hundred_thousand_items(spark):
    items = spark.range(100_001).selectExpr("id as item_id", "concat('item', id, ' a', id, ' b', id, ' c', id) as text")
    docs = spark.createDataFrame([(1, "see item100000 a100000 b100000 c100000"), (2, "none")], "doc_id bigint, text string")
    got = leaks.leaked_items(docs, items, block_bytes=1 << 20)
    assert [(x.doc_id, x.item_id) for x in got.collect()] == [(1, 100_000)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB1é ßñ.,'_-*&<>;\u00ad\u0301\n日・ｱ", max_size=30), max_size=5), st.booleans())
def test_hashed_words_are_the_words(texts, join):
    hashes, ends = word_hashes(texts, join)
    seen: dict[str, int] = {}
    for t, a, z in zip(texts, ends[:-1], ends[1:]):
        words = words_of(t, join)
        assert len(words) == z - a
        for w, h in zip(words, hashes[a:z].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_every_fourth_word_replaced_is_found(spark):
    r = random.Random(5)
    records = []
    for i in range(150):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([40, 100, 203]))]
        out = range(3, len(base), 4) if i % 3 else r.sample(range(len(base)), len(base) // 4)
        edit = [f"x{i}y{j}" if j in set(out) else w for j, w in enumerate(base)]
        if i % 5 == 0:
            edit = base[: -(-3 * len(base) // 4)]
        records += [(i, "train", '{"a": 1}', " ".join(base)), (1000 + i, "test", '{"a":1}', " ".join(edit)), (2000 + i, "test", '{"b":1}', " ".join(base))]
    records += [(3000, "train", '{"a": 1}', "one"), (3001, "test", '{"a": 1}', "one two"), (3002, "test", '{"a": 1}', "ONE")]
    df = spark.createDataFrame(records, "ft_id bigint, split string, schema string, content string").withColumn("source", F.lit("s"))
    got = {(x.ft_id_a, x.ft_id_b) for x in overlap.cross_split_pairs(df).collect()}
    assert got == brute(records) and got >= {(i, 1000 + i) for i in range(150)} | {(3000, 3002)}


def test_passages_with_every_fifth_word_replaced(spark):
    r = random.Random(12)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(n))) for k, n in enumerate([9, 10, 11, 12, 20, 30, 38, 39, 40, 41, 60, 100] * 5)]
    docs = []
    for k, text in items:
        w = text.split()
        half = -(-len(w) // 2)
        at = r.randint(0, len(w) - half)
        part = w[at : at + half]
        if half == 5:
            part[2] = "other"
        else:
            for j in range(r.choice((2, 4)) if half > 10 else 3, half - 2, 5):  # the verification wants two equal words after each
                if sum(x == "other" for x in part) < int(0.2 * half):
                    part[j] = "other"
        docs.append((k, " ".join(["before"] * 9 + part + ["after"] * 9)))
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(k, k) for k, _ in items}


def disk_files(spark):
    """Bytes of the shuffle and checkpoint files that are there, by name."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    there = {f.getPath(): f.length() for f in (files.apply(i) for i in range(files.size()))}
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder.isDefined():
        root = Path(folder.get().removeprefix("file:"))
        there |= {str(f): f.stat().st_size for f in root.rglob("*") if f.is_file()}
    return there


def written(spark, texts, schema='{"a": 1}'):
    """Bytes that the search writes for texts, a sixth of them of the evaluation."""
    df = spark.createDataFrame([(i, "train" if i % 6 else "test", schema, t, "s") for i, t in enumerate(texts)], "ft_id bigint, split string, schema string, content string, source string")
    before = disk_files(spark)
    overlap.cross_split_pairs(df).write.format("noop").mode("overwrite").save()
    return sum(n - before.get(name, 0) for name, n in disk_files(spark).items())


def test_words_are_moved_once(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(200)) for _ in range(900)]
    assert written(spark, texts) < 2 * sum(4 * len(t.split()) for t in texts)


def test_disk_grows_as_the_texts_of_one_schema(spark):
    r = random.Random(10)
    texts = [" ".join(f"w{r.randint(0, 400)}" for _ in range(150)) for _ in range(2000)]
    assert written(spark, texts) < 5 * written(spark, texts[:500])


def test_large_cells_are_cut_without_loss(spark):
    r = random.Random(11)
    records = []
    for i in range(120):
        base = [f"w{r.randint(0, 200)}" for _ in range(r.randint(20, 60))]
        edit = [w if r.random() > 0.1 else "x" for w in base]
        records += [(i, "train", '{"a": 1}', " ".join(base)), (1000 + i, "test", '{"a":1}', " ".join(edit)), (2000 + i, r.choice(["train", "test"]), '{"a":1}', " ".join(base))]
    df = spark.createDataFrame(records, "ft_id bigint, split string, schema string, content string").withColumn("source", F.lit("s"))
    for sizes in ((300, 500), (50, 10**9), (10**9, 50)):
        got = [(x.ft_id_a, x.ft_id_b) for x in overlap.cross_split_pairs(df, eval_words=sizes[0], train_words=sizes[1]).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(records)
