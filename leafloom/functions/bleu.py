"""Sentence BLEU: 13a tokens, four orders, exponential smoothing, effective order, brevity penalty."""

from __future__ import annotations

import math
import re
from collections import Counter

#: The rules of the 13a tokenizer.
_ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
_RULES = (
    (re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "),
    (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "),
    (re.compile(r"([\.,])([^0-9])"), r" \1 \2"),
    (re.compile(r"([0-9])(-)"), r"\1 \2 "),
)


def tokens_13a(text: str) -> list[str]:
    t = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for a, b in _ENTITIES:
        t = t.replace(a, b)
    t = f" {t} "
    for pattern, into in _RULES:
        t = pattern.sub(into, t)
    return t.split()


def sentence_bleu(hypothesis: str, reference: str) -> float:
    """0 to 1. Without any equal word the score is 0."""
    h, r = tokens_13a(hypothesis), tokens_13a(reference)
    logs, orders, smooth = 0.0, 0, 1.0
    for n in range(1, 5):
        total = len(h) - n + 1
        if total <= 0:
            break
        mine = Counter(tuple(h[i : i + n]) for i in range(total))
        theirs = Counter(tuple(r[i : i + n]) for i in range(max(0, len(r) - n + 1)))
        hits = sum((mine & theirs).values())
        if n == 1 and not hits:
            return 0.0
        if not hits:
            smooth *= 2
        logs += math.log(hits / total if hits else 1 / (smooth * total))
        orders += 1
    if not orders:
        return 0.0
    brevity = 1.0 if len(h) >= len(r) else math.exp(1 - len(r) / len(h))
    return brevity * math.exp(logs / orders)
