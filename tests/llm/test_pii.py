import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import pii, pii_train
from leafloom.llm.pii_spans import candidates, transition
from leafloom.llm.pii_weights import WEIGHTS


def test_held_out_accuracy():
    r = random.Random(99)
    hit = found = gold = 0
    for _ in range(1500):
        text, want = pii_train.parse(pii_train.sentence(r))
        got = {(a, z, lab) for lab, a, z in pii.find_items(text)}
        hit, found, gold = hit + len(got & want), found + len(got), gold + len(want)
    assert hit / found > 0.97 and hit / gold > 0.97


def test_examples():
    t = "Contact: Calla Marmark, phone +33 9 99 66 72 05, e-mail calla.marmark [at] fjorlo [dot] test\nFlat 3, 12 Quarry Avenue, Duneford; Ref. 0161-17-3132, logo@2x.png, lot 00352715, 54.05681, 9.93254."
    got = [(lab, t[a:z]) for lab, a, z in pii.find_items(t)]
    assert got == [
        ("private_person", "Calla Marmark"), ("private_phone", "+33 9 99 66 72 05"), ("private_email", "calla.marmark [at] fjorlo [dot] test"), ("private_address", "Flat 3, 12 Quarry Avenue, Duneford"),
    ]
    assert pii.redact(t).startswith("Contact: [PRIVATE_PERSON], phone [PRIVATE_PHONE], e-mail [PRIVATE_EMAIL]\n[PRIVATE_ADDRESS];")


SPANS = st.lists(st.tuples(st.integers(0, 9), st.integers(1, 4), st.floats(-2, 3), st.sampled_from("xy")), max_size=7)


@settings(max_examples=200, deadline=None)
@given(SPANS, st.lists(st.floats(-3, 3), min_size=8, max_size=8), st.text(alphabet=" ,|", min_size=14, max_size=14))
def test_decoding_and_likelihood_against_all_choices(raw, joints, text):
    spans = sorted({(a, a + n, lab): (a, a + n, lab, (f"w{i}",)) for i, (a, n, _, lab) in enumerate(raw)}.values())
    w = {f"w{i}": x for i, (_, _, x, _) in enumerate(raw)}
    w |= {f"next:{p}>{q}:{g}": x for (p, q, g), x in zip(((p, q, g) for p in "xy" for q in "xy" for g in ("list", "beside")), joints)}
    totals = {}
    for mask in range(1 << len(spans)):
        pick = tuple(sorted(s for i, s in enumerate(spans) if mask >> i & 1))
        if all(p[1] <= q[0] for p, q in zip(pick, pick[1:])):
            totals[pick] = sum(pii.score(s, w) for s in pick) + sum(w.get(transition(text, p, q) or "", 0.0) for p, q in zip(pick, pick[1:]))
    got = tuple(pii.decode(spans, w, text))
    assert abs(totals[got] - max(totals.values())) < 1e-9
    gold = max(totals, key=lambda p: (len(p), p))
    ll, _ = pii_train.gradient(text, spans, {s[:3] for s in gold}, w)
    assert abs(ll - (totals[gold] - math.log(sum(map(math.exp, totals.values()))))) < 1e-6


def test_gradient_is_exact():
    text, gold = pii_train.parse("By <private_person|Calla Marmark|>, <private_person|Orla Ulverdale|> · <private_phone|030/555 12 34|> or <private_person|Jan Kowalski|>")
    spans, w = candidates(text), dict(WEIGHTS)
    _, g = pii_train.gradient(text, spans, gold, w)
    for f in ("person", "form=GS", "private_phone:slash", "next:private_person>private_person:list", "next:private_person>private_phone:beside", "plain"):
        up, down = (pii_train.gradient(text, spans, gold, w | {f: w.get(f, 0.0) + e})[0] for e in (1e-5, -1e-5))
        assert abs((up - down) / 2e-5 - g.get(f, 0.0)) < 1e-4


def test_tables(spark):
    mail = "write to ab@mintlo.example now"
    df = spark.createDataFrame(
        [("1", mail, None, "{}", ""), ("1", mail, None, "{}", ""), ("2", None, None, None, None), (None, mail, None, None, None), ("3", None, "z" * 200_000 + " " + mail, "[1]", None)],
        "id string, prompt string, content string, schema string, response string",
    ).withColumn("label", F.lit("clash"))
    got = sorted((r.id, r.field, r.label, r.span_start, r.span_end) for r in pii.personal_items(df).collect())
    assert got == [("1", "prompt", "private_email", 9, 26), ("3", "content", "private_email", 200_010, 200_027)]
    red = {r.id: r for r in pii.redacted(df).collect()}
    assert red["1"].prompt == "write to [PRIVATE_EMAIL] now" and red["2"].prompt is None and set(red) == {"1", "2", "3"}
    assert pii.personal_items(df.limit(0)).count() == 0


def test_names_outside_the_lists():
    for text in ("By John Smith · 2025-03-11", "Contact: Anna Kowalski, phone +33 9 99 66 72 05", '{"author": "Marie Dupont", "title": "Harbour News"}', "Kontakt: Jürgen P. Schäfer\n"):
        found = [text[a:z] for lab, a, z in pii.find_items(text) if lab == "private_person"]
        assert found in (["John Smith"], ["Anna Kowalski"], ["Marie Dupont"], ["Jürgen P. Schäfer"])
    for text in ("# Annual Report\n\nThe Harbour Museum opens.", "Kontakt\nMein Konto\nWarenkorb", "Contact: Customer Service. The customer may call.", '{"venue": "Harbour Hall"}'):
        assert not pii.find_items(text)
    r = random.Random(77)
    hit = found = gold = 0
    for _ in range(1500):
        text, want = pii_train.parse(pii_train.plain_sentence(r))
        got = {(a, z, lab) for lab, a, z in pii.find_items(text)}
        hit, found, gold = hit + len(got & want), found + len(got), gold + len(want)
    assert hit / found > 0.9 and hit / gold > 0.9, (hit, found, gold)


@pytest.mark.parametrize("text, label, items", [
    ("Please contact John Smith", "private_person", ["John Smith"]), ("by Emily Johnson", "private_person", ["Emily Johnson"]), ("Author: Wolfgang Müller", "private_person", ["Wolfgang Müller"]),
    ("contact Jürgen Klopp or Angela Merkel", "private_person", ["Jürgen Klopp", "Angela Merkel"]), ("Contact: Maria Garcia Lopez", "private_person", ["Maria Garcia Lopez"]),
    ("my number is 415-555-2671", "private_phone", ["415-555-2671"]), ("Phone: 555 123 4567", "private_phone", ["555 123 4567"]), ("Passport 123456789", "account_number", ["123456789"]),
    ("DNI 12345678Z", "account_number", ["12345678Z"]), ("4111 1111 1111 1111", "account_number", ["4111 1111 1111 1111"]),
    ("10 Downing Street, London SW1A 2AA", "private_address", ["10 Downing Street, London SW1A 2AA"]),
    ("see 12 " + "Averyverylongname" * 20 + " Street, Duneford 99123.", "private_address", ["12 " + "Averyverylongname" * 20 + " Street, Duneford 99123"]),
])
def test_items_of_other_wording_and_length(text, label, items):
    assert [(lab, text[a:z]) for lab, a, z in pii.find_items(text)] == [(label, x) for x in items]


@pytest.mark.parametrize("text", ["published 2025-03-12", "total 1,234,567", "order 555 123 4567", "ISBN 978-0-306-40615-7", "4111 1111 1111 1112", "on the mobile site. 2025-04-16", "Harbour Board, Annual Report"])
def test_no_items(text):
    assert not pii.find_items(text)


def test_redaction_of_placed_rows(spark):
    rows = [(str(i % 7), f"write to ab{i % 7}@mintlo.example", None, None, None, i) for i in range(20)] + [(None, "x", None, None, None, 99)]
    df = spark.createDataFrame(rows, "id string, prompt string, content string, schema string, response string, n int")
    a, b = (sorted((r.id, r.prompt) for r in pii.redacted(df, place).collect()) for place in (None, ["n"]))
    assert a == b == [(str(i), "write to [PRIVATE_EMAIL]") for i in range(7)]
