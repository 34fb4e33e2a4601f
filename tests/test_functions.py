import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafloom.functions import leaves as L
from leafloom.functions.bleu import sentence_bleu, tokens_13a
from leafloom.functions.jsonschema import Validator
from leafloom.functions.jsontext import NOTHING, find_value

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab.\\[]", max_size=4),
    lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("ab.\\", max_size=3), c, max_size=3), max_leaves=12,
)


@pytest.mark.parametrize("text, want", [
    ('{"a": 1}', '{"a": 1}'), ("[1, 2]", "[1, 2]"), ('```json\n{"a": 1}\n```', '{"a": 1}'), ("```\n[1]\n```", "[1]"), ('so:\n```json\n{"a":1}\n```\nend', '{"a":1}'),
    ('text {"a": {"b": [1]}} more', '{"a": {"b": [1]}}'), ("x [1] {\"a\":2}", "[1]"), ('  {"a": 1}  ', '{"a": 1}'), ("no json here", "no json here"), ('{"a": "}"}', '{"a": "}"}'),
    ('{"a": 1', '{"a": 1'), ('{"a": "\\"}"}', '{"a": "\\"}"}'), ("", ""), ('[{"a":1},{"b":2}]', '[{"a":1},{"b":2}]'),
])
def test_json_in(text, want):
    assert L.json_in(text) == want


def test_repeated_keys_and_leaves():
    assert L.without_repeated_keys('{"a":1,"a":2,"b":3}') == {"b": 3}
    assert L.without_repeated_keys("{") == {}
    got = L.leaves({"a.b": {"c": 1}, "e": {}, "l": [], "items": [{"n": "A"}, {"n": "B", "t": {}}, 7], "m": [[1], [2]]})
    assert got == {"a\\.b.c": 1, "e": L.EMPTY, "l": [], "items[*].n": ["A", "B"], "items[*].t": [L.EMPTY], "m": [[1], [2]]}


def test_scores():
    s = L.scores({"name": "John", "age": 30, "tags": ["a", "b"]}, {"name": "john", "age": 30, "tags": ["b", "a"], "city": "NYC"})
    assert (s["key_precision"], s["key_recall"], s["missing_keys"], s["extra_keys"], s["value_score"]) == (1.0, 0.75, 1.0, 0.0, 0.5)
    assert s["key_f1"] == pytest.approx(6 / 7)
    assert L.scores({}, {})["value_score"] == 1.0 and L.scores({}, {"a": 1})["key_f1"] == 0.0
    assert L.scores([1], [1])["key_f1"] == 1.0 and L.scores(3, 3)["value_score"] == 1.0
    assert L.value_score(True, 1) == 1.0 and L.value_score(1.0, 1) == 1.0 and L.value_score("x", None) == 0.0


@settings(max_examples=60, deadline=None)
@given(VALUES)
def test_truth_scores_fully_against_itself(v):
    s = L.scores(v, v)
    assert s["key_precision"] == s["key_recall"] == s["key_f1"] == 1.0 and s["missing_keys"] == s["extra_keys"] == 0.0


def test_bleu():
    assert sentence_bleu("the cat sat on the mat", "the cat sat on the mat") == pytest.approx(1)
    assert sentence_bleu("John", "john") == 0.0 and sentence_bleu("", "a") == 0.0
    # 2 of 3 words, 1 of 2 pairs, no triple of 1: exponential smoothing halves the last
    assert sentence_bleu("a b d", "a b c") == pytest.approx((2 / 3 * 1 / 2 * 1 / 2) ** (1 / 3))
    assert tokens_13a('He said "1,000.5"-ish.') == ["He", "said", '"', "1,000.5", '"', "-ish", "."]


def test_change_classes_and_readings():
    c = L.change_class
    assert c(None, "N/A") == "chg_missing_convention" and c("NA", "x") == "chg_orig_missing_regen_content" and c("x", []) == "chg_orig_content_regen_missing"
    assert c(" Foo", "foo ") == "chg_case_whitespace_only" and c(1, 1.0) == "chg_numeric_format" and c(True, 1) == "chg_content_rewrite"
    assert L.numeric_readings("1,234") == {1234.0, 1.234} and L.numeric_readings("$1,299.00") == {1299.0} and L.numeric_readings("about 5 units") == set() and L.numeric_readings(True) == set()
    assert L.rewrite_label("Hello, World", "hello world!") == "formatting" and L.rewrite_label(["a", "b"], ["b", "a"]) == "reorder"
    assert L.rewrite_label("2024-05-01", "May 1, 2024") == "formatting" and L.rewrite_label("a long enough text", "a long enough text goes on") == "completion"
    assert L.rewrite_label("a long enough text goes on", "a long enough text") == "truncation" and L.rewrite_label("red", "blue") == "needs_judge"
    assert L.leaf_counts({"a": None, "b": [None, None], "c": "n/a", "d": 1}) == (4, 2, 3)
    assert L.leaf_diff({"a": 1, "b": 2}, {"b": 3, "c": 4}) == {"added": 1, "removed": 1, "changed": 1}
    assert len(L.leaf_id("k", 1, {})) == 16 and L.plain([L.EMPTY, 1]) == [{}, 1]


def test_compare():
    got = L.compare(True, '{"a": 1, "b": "x", "u": []}', '{"a": 1.0, "b": "y", "u": [{"v": 1}]}')
    assert got["n_shared"] == 2 and got["n_changed"] == 2 and got["chg_numeric_format"] == 1 and got["chg_content_rewrite"] == 1 and got["top_jaccard"] == 1.0 and got["jaccard"] == 0.5
    assert "jaccard" not in L.compare(True, "{", "{}")


@pytest.mark.parametrize("schema, good, bad", [
    ({"type": "object", "required": ["a"], "properties": {"a": {"type": ["string", "null"]}}, "additionalProperties": False}, [{"a": None}], [{}, {"a": 1}, {"a": "x", "b": 1}, []]),
    ({"type": "array", "items": {"$ref": "#/$defs/n"}, "minItems": 1, "$defs": {"n": {"type": "integer", "minimum": 2}}}, [[2, 3.0]], [[], [1], ["x"], [2.5]]),
    ({"anyOf": [{"type": "string", "pattern": "^a"}, {"const": 1}]}, ["ab", 1, 1.0], ["b", True, None]),
    ({"oneOf": [{"multipleOf": 2}, {"multipleOf": 3}]}, [2, 9], [6, 7]),
    ({"not": {"enum": [[1, {"a": 2}]]}}, [[1]], [[1, {"a": 2}]]),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"exclusiveMaximum": 5}}, ["ab", 4], ["a", 5]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "number"}, "uniqueItems": True, "contains": {"const": 3}}, [["a", 3]], [["a", "b"], ["a", 3, 3], ["a", 1]]),
    ({"propertyNames": {"maxLength": 1}, "patternProperties": {"^x": {"type": "null"}}, "maxProperties": 1}, [{"x": None}], [{"ab": 1}, {"x": 1}, {"a": 1, "b": 2}]),
])
def test_validator(schema, good, bad):
    v = Validator(schema)
    assert [x for x in good if v.error(x)] == [] and [x for x in bad if not v.error(x)] == []


def test_validator_of_broken_schemas():
    assert Validator({"$ref": "#/missing"}).error(1) and Validator({"$ref": "http://x/y"}).error(1) and Validator({"type": "thing"}).error(1) and Validator(False).error(1)
    assert Validator({"$ref": "#"}).error(1).startswith("schema")


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.text(max_size=3), VALUES, max_size=3))
def test_value_found_in_every_wrapping(v):
    bare = json.dumps(v)
    for text in (bare, f"```json\n{bare}\n```", f"Here it is:\n{bare}", json.dumps(bare), f"\n {bare}\n"):
        assert find_value(text) == v


def test_value_not_found():
    for text in (None, "", "prose", '{"a": 1', '{"a": 1} and more', "3", '"text"', "NaN", '{"a": NaN}'):
        assert find_value(text) is NOTHING
    assert find_value("3", container=False) == 3


def test_json_strings_are_opened_however_many():
    import json

    from leafloom.functions.jsontext import find_value

    text = '{"a": 1}'
    for _ in range(7):
        text = json.dumps(text)
    assert find_value(text) == {"a": 1}


def test_readings_of_numbers_and_dates():
    import datetime

    from leafloom.functions import leaves as L

    assert L.numeric_readings("1,234") == {1234.0, 1.234} and L.numeric_readings("$1,299.00") == {1299.0} and L.numeric_readings("about 5 units") == set()
    assert L.numeric_readings(True) == set() and L.numeric_readings(3) == {3.0} and L.numeric_readings("-") == set() and L.numeric_readings("1,2,3") == {123.0} and L.numeric_readings("12 EUR") == {12.0}
    day = datetime.date(2024, 3, 5)
    for text in ("2024-03-05", "3/5/2024", "03.05.2024", "3-5-24", "March 5, 2024", "Mar. 5th 2024", "2024-03-05T10:20:30Z", "2024-3-5 10:20 am", "Tue, Mar 5 2024"):
        assert L.date_reading(text) == day, text
    assert L.date_reading("25/12/2023") == datetime.date(2023, 12, 25) and L.date_reading("Mar 5") == datetime.date(datetime.date.today().year, 3, 5)
    assert all(L.date_reading(x) is None for x in ("", None, 5, "2024-13-45", "on 2024-03-05", "x" * 41, "March"))
    assert L.without_repeated_keys('{"a":1,"a":2,"b":{"c":1,"c":2,"c":3,"d":4}}') == {"b": {"d": 4}} and L.without_repeated_keys("{") == {}


def test_schemas_with_unevaluated_members_and_references():
    from leafloom.functions.jsonschema import Validator

    s = {"allOf": [{"properties": {"a": {"type": "integer"}}}], "if": {"required": ["b"]}, "then": {"properties": {"b": True}}, "unevaluatedProperties": False}
    ok = lambda schema, v: Validator(schema).error(v) is None
    assert ok(s, {"a": 1}) and ok(s, {"a": 1, "b": 2}) and not ok(s, {"a": 1, "c": 2}) and not ok(s, {"a": "x"})
    items = {"prefixItems": [True], "contains": {"type": "string"}, "unevaluatedItems": {"type": "integer"}}
    assert ok(items, [None, 1, "x"]) and not ok(items, [None, None, "x"])
    deep: object = 1
    for _ in range(220):
        deep = {"next": deep}
    chain = {"$defs": {"n": {"properties": {"next": {"$ref": "#/$defs/n"}}}}, "$ref": "#/$defs/n"}
    assert ok(chain, deep)
    assert "circle" in Validator({"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}}, "$ref": "#/$defs/a"}).error(1)
