"""Problem 4: personal items in free text, by a semi-Markov conditional random field.

Every run of capitalised words (segments of up to ``MOST_WORDS``), every run of digits and every match of a detector is a
candidate segment. Whole segments carry features (shape, cue before them, JSON key, make-up of a name, what follows), and two
segments that follow each other closely carry a transition of their labels; a linear model scores both. A dynamic program
over segment ends picks the set of disjoint segments with the greatest total, so boundaries and types are decided
together. Text outside the segments scores nothing. The weights were trained by ``pii_train`` (conditional log-likelihood,
exact gradients from forward and backward sums over the same choices).
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.pii_spans import NEAR, Span, candidates, transition
from leafloom.llm.pii_weights import WEIGHTS
from leafloom.operators.joining import first_of_each

#: Weight of a make-up of names that training has not met.
_UNSEEN = -1.5
FIELDS = ("prompt", "content", "schema", "response")


def score(span: Span, weights: dict[str, float]) -> float:
    return sum(weights.get(f, _UNSEEN if f.startswith("form=") else 0.0) for f in span[3])


def decode(spans: list[Span], weights: dict[str, float], text: str = "") -> list[Span]:
    """The disjoint segments with the greatest total score, their transitions included, in text order (Viterbi)."""
    spans = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    total: list[float] = []  # of the best choice that ends with this segment
    back: list[int] = []
    best: list[tuple[float, int]] = [(0.0, -1)]  # per prefix of the sorted segments: total and last segment
    for i, s in enumerate(spans):
        far, near = bisect.bisect_right(ends, s[0] - NEAR - 1), bisect.bisect_right(ends, s[0], 0, i)
        value, last = best[min(far, i)]
        for j in range(far, near):
            f = transition(text, spans[j], s)
            value, last = max((value, last), (total[j] + (weights.get(f, 0.0) if f else 0.0), j))
        total.append(value + score(s, weights))
        back.append(last)
        best.append(max(best[-1], (total[i], i)))
    out: list[Span] = []
    i = best[-1][1]
    while i >= 0:
        out.append(spans[i])
        i = back[i]
    return out[::-1]


def find_items(text: str) -> list[tuple[str, int, int]]:
    """(label, start, end) of the personal items of a text."""
    spans = candidates(text)
    return [(s[2], s[0], s[1]) for s in decode(spans, WEIGHTS, text)] if spans else []


@lru_cache(maxsize=2048)
def _cached(text: str) -> tuple[tuple[str, int, int], ...]:
    return tuple(find_items(text))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.struct([("field", pa.string()), ("label", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32())])
    for b in batches:
        ids, out = [], []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            found = []
            for field, text in zip(FIELDS, row[1:]):
                if text:
                    items = _cached(text) if field in ("schema", "prompt") else find_items(text)
                    found += [{"field": field, "label": x, "span_start": a, "span_end": z} for x, a, z in items]
            if found:
                ids.append(row[0])
                out.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.list_(struct))], names=["id", "items"])


def _items(rows: DataFrame) -> DataFrame:
    return (
        rows.select("id", *FIELDS).filter("id is not null")
        .mapInArrow(_run, "id string, items array<struct<field:string,label:string,span_start:int,span_end:int>>")
        .dropDuplicates(["id"])
    )


def personal_items(rows: DataFrame) -> DataFrame:
    """``id, field, label, span_start, span_end``: one row per personal item of ``prompt, content, schema, response``.

    Offsets count code points from 0, the end is exclusive. Null ids and texts give no row; an id delivered twice counts
    once; extra columns are ignored. Row-local but for the duplicates: one pass, one shuffle of the ids with items.
    """
    return _items(rows).select("id", F.explode("items").alias("i")).select("id", "i.*")


def redact(text: str) -> str:
    """The text with typed placeholders, e.g. ``[PRIVATE_EMAIL]``, in place of the items."""
    out, at = [], 0
    for label, a, z in find_items(text):
        out += [text[at:a], f"[{label.upper()}]"]
        at = z
    return "".join(out) + text[at:]


def redacted(rows: DataFrame, place: list[str] | None = None) -> DataFrame:
    """``id, prompt, content, schema, response`` with placeholders in place of personal items; nulls stay null.

    An id counts once. With ``place``, columns that tell the rows apart, no text is moved for that as long as repeated
    ids are few enough to be broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(0)] + [pa.array([None if t is None else redact(t) for t in c.to_pylist()], pa.string()) for c in b.columns[1:]]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *FIELDS])

    wide = rows.select("id", *FIELDS, *(place or [])).filter("id is not null")
    once = first_of_each(wide, "id", place) if place else wide.dropDuplicates(["id"])
    return once.select("id", *FIELDS).mapInArrow(run, "id string, prompt string, content string, schema string, response string")
