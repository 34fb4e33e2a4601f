import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafloom.llm import pairs as P

ASK = "Extract the title and summary from the page"
GOOD = '{"title": "The harbour office", "summary": "The weekly digest of the town lists the spare parts before the next release."}'


@pytest.mark.parametrize("prompt, response, schema, content, want", [
    (ASK, GOOD, None, None, None), (None, None, None, None, None), ("  ", "", None, None, None),
    *[(ASK, r, None, None, "empty") for r in (None, "", " \n", "null", "{}", "[]", '""', '{"a": null, "b": [], "c": "N/A"}', "```json\n{}\n```", "NA", "```json\n\n```")],
    (ASK, "I'm sorry, but I can't extract that information from this page.", None, None, "refusal"), (ASK, '{"error": "No puedo facilitar datos personales del texto."}', None, None, "refusal"),
    (ASK, '{"title": "x y z", "summary": "Sorry, we cannot ship this item to the islands at the moment."}', None, None, None),
    (ASK, ASK.upper(), None, None, "copy"), (ASK, '{"answer": "' + ASK + '."}', None, None, "copy"), (ASK, '{"type":"object","properties":{"a":{}}}', '{"properties": {"a": {}}, "type": "object"}', None, "copy"),
    (ASK, GOOD[:60], None, None, "truncated"), (ASK, "```json\n" + GOOD[:60] + "\n```", None, None, "truncated"), (ASK, '"{\\"a\\": \\"b', None, None, "truncated"),
    (ASK, '{"summary": "The harbour office li"}', None, "The harbour office lists the parts.", "truncated"), (ASK, '{"summary": "The harbour office lists"}', None, "The harbour office lists the parts.", None),
    (ASK, '{"summary": "Das Hafenamt nennt die Ersatzteile und die Wartezeiten vor der nächsten Ausgabe auf der mobilen Seite."}', None, None, "wrong_language"),
    (ASK + ". Answer in German.", GOOD, None, None, "wrong_language"), (ASK + ". Answer in German.", '{"s": "Das Hafenamt nennt die Ersatzteile und die Wartezeiten vor der nächsten Ausgabe."}', None, None, None),
])
def test_defects(prompt, response, schema, content, want):
    assert P.defect_of(prompt, response, schema, content) == want


def brute(prompt, words, least):
    hit = [False] * len(words)
    grams = {tuple(prompt[i : i + n]) for n in range(least, len(prompt) + 1) for i in range(len(prompt) - n + 1)}
    for n in range(least, len(words) + 1):
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit[i : i + n] = [True] * n
    return sum(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9), st.integers(1, 3))
def test_automaton_against_brute_force(prompt, words, least):
    assert P.SuffixAutomaton(tuple(prompt)).covered(words, least) == brute(prompt, words, least)


def test_table(spark, rows):
    df = spark.createDataFrame(
        [("1", ASK, None, None, None), ("1", ASK, None, None, None), ("2", ASK, GOOD, None, None), (None, ASK, None, None, None), ("3", None, None, None, None), ("4", ASK, "{" * 100_000, None, "x" * 100_000)],
        "id string, prompt string, response string, schema string, content string",
    ).withColumn("defect", F.lit("clash"))
    assert rows(P.defective_pairs(df)) == [("1", "empty"), ("4", "truncated")]
    assert P.defective_pairs(df.limit(0)).count() == 0


def test_languages_of_random_sentences():
    r = random.Random(1)
    de, en = "der Hafen ist nicht auf der Seite und die Werkstatt wird mit dem Text geprüft".split(), "the office of the town is not on this page and it has been with the text".split()
    for _ in range(20):
        assert P.language_of([w.lower() for w in r.sample(de, 10)]) == "de" and P.language_of(r.sample(en, 10)) == "en"
    assert P.language_of([]) is None and P.language_of(["zzz"]) is None

UNSEEN = """
Sorry, I won't do that. | As an AI language model I am not comfortable with this request. | I'm afraid this is against my guidelines. | I must respectfully refuse. | I'm not able to comply with that.
We cannot share this data. | That goes against my content policy, so no. | I cannot in good conscience complete this task. | It would be impossible for me to answer this question.
Leider kann ich das nicht beantworten. | Das verstößt gegen meine Richtlinien. | Ich möchte diese Frage nicht beantworten. | Désolé, cela m'est impossible. | Je refuse de répondre. | Mes règles m'interdisent de le faire.
Lo lamento, no puedo hacer eso. | Mis normas no me permiten contestar. | Infelizmente não posso fazer isso. | Recuso-me a responder. | Purtroppo non posso farlo. | Mi rifiuto di rispondere.
"""
ANSWERS = """
Sorry, we cannot ship this item to the islands at the moment. | The office answers questions on Monday. | Our rules forbid dogs in the hall. | We do not sell tickets at the door. | Sie können nicht mit Karte zahlen.
Refunds are given within ten days. | I like the harbour, it never gets cold. | The museum declined the loan. | Les chiens ne sont pas admis. | No se admiten perros en la sala.
"""


def test_refusals_of_other_wording():
    unseen, answers = ([s.strip() for line in block.strip().splitlines() for s in line.split("|")] for block in (UNSEEN, ANSWERS))
    found = [P.defect_of(ASK, '{"title": null, "note": "%s"}' % s, None, "The page.") for s in unseen]
    assert len(unseen) >= 20 and found.count("refusal") >= 0.9 * len(unseen)
    assert all(P.declines(s) < 1 for s in answers)


def test_a_refusal_counts_at_any_length_and_in_any_number_of_fields_but_not_on_the_page():
    long = " ".join(f"I am sorry, but I cannot answer question {i} of this request." for i in range(60))
    assert len(long) > 3000 and P.defect_of(ASK, '{"a": "' + long + '"}', None, None) == "refusal" == P.defect_of(ASK, long, None, None)
    many = "{" + ", ".join(f'"f{i}": "I must refuse to answer this."' for i in range(9)) + "}"
    assert P.defect_of(ASK, many, None, None) == "refusal"
    assert P.defect_of(ASK, '{"a": "I must refuse to answer this."}', None, "He said: I must refuse to answer this.") is None


def test_languages_beyond_those_of_the_corpus_are_wrong_too():
    assert P.defect_of(ASK, '{"s": "Het kantoor in de haven is niet open voor deze week, maar wordt morgen ook nog gebruikt."}', None, None) == "wrong_language"
    assert P.defect_of(ASK, '{"s": "Контора в порту на этой неделе закрыта, но завтра она снова откроется."}', None, None) == "wrong_language"
    assert P.defect_of(ASK, "Das Hafenamt nennt die Ersatzteile und die Wartezeiten vor der nächsten Ausgabe auf der Seite.", None, None) == "wrong_language"
