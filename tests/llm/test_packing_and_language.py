import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import language as L
from leafloom.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0.1, 5)), min_size=1, max_size=5, unique_by=lambda x: x[0]), st.integers(9, 20))
def test_knapsack_against_brute_force(classes, capacity):
    sizes, price = np.array([s for s, _ in classes]), np.array([p for _, p in classes])
    best = [0.0] * (capacity + 1)
    for j in range(1, capacity + 1):
        best[j] = max([best[j - 1], *(best[j - s] + p for s, p in classes if s <= j)])
    solved = P.Knapsack(price, sizes, capacity)
    fill, value = solved.filling(capacity), solved.value[-1]
    assert solved.value == pytest.approx(best)
    for near in solved.good(0.1, np.arange(len(sizes))):
        assert sum(sizes[k] * n for k, n in near.items()) <= capacity and sum(price[k] * n for k, n in near.items()) >= 0.9 * value - 1e-9
    assert sum(sizes[k] * n for k, n in fill.items()) <= capacity and value == pytest.approx(best[-1]) and sum(price[k] * n for k, n in fill.items()) == pytest.approx(value)


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), max_size=12))
def test_plan_holds_every_item_once(histogram):
    plan, bound = P.plan(histogram, 32)
    held: dict[int, int] = {}
    for fill, copies in plan:
        assert copies > 0 and sum(s * n for s, n in fill.items()) <= 32
        for s, n in fill.items():
            held[s] = held.get(s, 0) + n * copies
    assert held == histogram
    used, least = sum(c for _, c in plan), math.ceil(sum(s * n for s, n in histogram.items()) / 32)
    assert bound <= used + 1e-6 and least <= used <= 1.05 * sum(c for _, c in P.best_fit(histogram, 32)) + 2


@pytest.mark.parametrize("low, high, items, most", [(150, 299, 50_000, 1.04), (1, 257, 20_000, 1.005), (20, 80, 100, 1.2), (20, 80, 10_000, 1.01)])
def test_plan_is_near_the_dual_bound_at_every_size(low, high, items, most):
    r = random.Random(3)
    histogram: dict[int, int] = {}
    for _ in range(items):
        s = r.randint(low, high)
        histogram[s] = histogram.get(s, 0) + 1
    plan, bound = P.plan(histogram, 512)
    assert sum(c for _, c in plan) <= most * bound + 1


def test_containers(spark):
    r = random.Random(5)
    docs = [(i, "é" * r.randint(0, 60) + "x" * r.randint(0, 200)) for i in range(400)] + [(1000, "word " * 300), (1001, ""), (1002, None), (1003, "𝒩" * 500), (None, "x")]
    df = spark.createDataFrame(docs + docs[:5], "doc_id bigint, text string").withColumn("position", F.lit(9)).withColumn("rank", F.lit(9))
    got = P.fill_containers(df, 256, 4).collect()
    text = dict(docs)
    boxes: dict[int, list] = {}
    for x in got:
        part = text[x.doc_id][x.piece_start : x.piece_start + x.piece_chars]
        assert x.tokens == len(part.encode()) + 1 <= 256
        boxes.setdefault(x.container_no, []).append(x)
    assert all(sum(x.tokens for x in b) <= 256 and sorted(x.position for x in b) == list(range(1, len(b) + 1)) for b in boxes.values())
    assert sorted(boxes) == list(range(1, len(boxes) + 1))
    for d in (i for i, t in docs if t is not None and i is not None):
        parts = sorted((x for x in got if x.doc_id == d), key=lambda x: x.piece_no)
        assert "".join(text[d][x.piece_start : x.piece_start + x.piece_chars] for x in parts) == text[d]
        assert len(parts) == 1 or len(text[d].encode()) + 1 > 256
    report = P.fill_report(P.fill_containers(df, 256, 4), 256, 4).first()
    assert report.fill > 0.93 and report.containers >= report.lp_bound >= 1 and report.containers >= report.least_possible
    assert P.fill_containers(df.limit(0), 256, 4).count() == 0
    with pytest.raises(ValueError):
        P.fill_containers(df, 16, 8)


SENT = {
    "en": "The committee will discuss the new timetable and the opening hours of the library tomorrow.", "de": "Der Ausschuss wird morgen den neuen Fahrplan und die Öffnungszeiten der Bücherei besprechen.",
    "fr": "Le comité discutera demain du nouvel horaire et des heures d'ouverture de la bibliothèque.", "es": "El comité hablará mañana sobre el nuevo horario y las horas de apertura de la biblioteca.",
    "pt": "A comissão vai discutir amanhã o novo horário e as horas de abertura da biblioteca da cidade.", "it": "Il comitato discuterà domani il nuovo orario e gli orari di apertura della biblioteca della città.",
    "ja": "委員会は明日、新しい時刻表と図書館の開館時間について話し合います。",
}


def test_held_out_sentences():
    p = L.Profiles({k: [v] for k, v in L.STARTING_TEXTS.items()})
    assert {k: p.best(L._RUN.findall(v))[0] for k, v in SENT.items()} == {k: k for k in SENT}
    assert p.best([]) is None and p.best(["ξξξ"]) is None


def test_out_of_place_distance_by_hand():
    p = L.Profiles({"a": ["ab"], "b": ["cd"]}, 50)
    d = p.distances(["ab"])
    assert d[0] == pytest.approx(0) and d[1] > 0.5


def test_documents(spark):
    mixed = SENT["en"] + "\n\n" + SENT["de"] + "\n\n```\n{\"a\": 1}\n```\n\n" + SENT["en"]
    rows = [(1, SENT["fr"], " FR-XX"), (2, SENT["fr"], "de"), (3, SENT["it"], None), (4, mixed, "en"), (5, '```json\n{"a": "the and of"}\n```', None), (6, None, "en"), (7, "", "en"), (8, "12 34", ""), (None, SENT["en"], None)]
    rows += [(9, SENT["ja"], "unknown"), (3, SENT["it"], None), (10, (SENT["es"] + " ") * 2000, "und")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("para_no", F.lit(1)).withColumn("label", F.lit(1))
    got = sorted((r.doc_id, r.para_no, r.lang) for r in L.wrong_labels(L.document_languages(df)).collect())
    assert got == [(2, 0, "fr"), (3, 0, "it"), (4, 1, "en"), (4, 2, "de"), (4, 4, "en"), (9, 0, "ja"), (10, 0, "es")]
    assert all(0 <= r.confidence <= 1 for r in L.document_languages(df).collect())
    assert L.document_languages(df.limit(0)).count() == 0


def test_paragraphs():
    assert L.paragraphs("a\n\n\nb\nc\n \nd") == ["a", "b\nc", "d"] and L.paragraphs("\n\n") == []
    assert L.running_text('{"a": 1}') == "" and L.running_text("see `x` at https://a.b/c").split() == ["see", "at"]


def test_what_no_profile_fits_is_und(spark):
    model = L.Profiles({k: [v] for k, v in L.STARTING_TEXTS.items()})
    for text in (
        "Дети ждали автобус, когда начался дождь, и никто не взял зонт.", "De kinderen wachtten op de bus toen het begon te regenen, en niemand had een paraplu meegenomen. Na een tijdje kwam de chauffeur terug met de sleutels.",
        "孩子们在等公共汽车时开始下雨了，没有人带伞。",
    ):
        assert L.judge(model, text)[0] == L.UNKNOWN, text
    for lang, text in L.STARTING_TEXTS.items():
        main, conf, parts = L.judge(model, text + "\n\nДети ждали автобус, когда начался дождь, и никто не взял зонт.")
        assert main == lang and conf > 0.05 and [x for _, x, _ in parts] == [lang, L.UNKNOWN]
    docs = [(1, "Дети ждали автобус, когда начался дождь.", "ru"), (2, "Дети ждали автобус, когда начался дождь.", None), (3, L.STARTING_TEXTS["de"], "nl")]
    got = L.document_languages(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert {(r.doc_id, r.lang) for r in got.collect()} == {(1, "und"), (2, "und"), (3, "de")} and [r.doc_id for r in L.wrong_labels(got).collect()] == [3]


def test_short_paragraphs_are_judged_by_one_rule_at_every_length():
    model = L.Profiles({k: [v] for k, v in L.STARTING_TEXTS.items()})
    de = L.STARTING_TEXTS["de"]
    leads = []
    for n in range(1, 60):
        part = L.judge(model, de + "\n\n" + "the children were waiting for the bus when it began to rain and nobody had it"[:n])[2]
        assert len(part) == 2  # a paragraph of one letter has a row too
        leads.append(part[1][1])
    assert leads[0] == "de" and leads[-1] == "en"
