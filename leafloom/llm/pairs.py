"""Problem 2: prompt-response pairs that are no use, each with its type of defect.

Per pair, in this order: ``empty`` (no value but null, "", [], {}, N/A, NA), ``refusal`` (an automaton of kinds of words
marks half or more of the answer as sentences that decline and that the page lacks), ``copy`` (traversing the suffix automaton of the prompt's words covers
most of the answer, or the answer is the row's schema), ``truncated`` (a stack of delimiters is left open, or the last
text value stops within a word of the page), ``wrong_language`` (function words vote for another language than the one
that the prompt asks for or is written in). Row-local but for the duplicate ids: one pass, one narrow shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from leafloom.functions.jsontext import NOTHING, canonical, find_value
from leafloom.llm import wording as W

_WORD = re.compile(r"[^\W_]+")
_SENT = re.compile(r"(?<=[.!?])\s+|\n+")
_NULLS = frozenset(["", "n/a", "na", "null"])
_ANSWER_IN = re.compile(W.ANSWER_IN)
_NAMES = {name: lang for lang, names in W.LANGUAGE_NAMES.items() for name in names.split()}
_OPEN_FENCE = re.compile(r"^.*?```[A-Za-z0-9_-]*[ \t]*\r?\n", re.S)


def _votes() -> dict[str, dict[str, float]]:
    langs: dict[str, list[str]] = {}
    for lang, words in W.STOPWORDS.items():
        for w in set(words.split()):
            langs.setdefault(w, []).append(lang)
    more: dict[str, list[str]] = {}
    for lang, words in W.MORE_STOPWORDS.items():
        for w in set(words.split()) - langs.keys():
            more.setdefault(w, []).append(lang)
    return {w: {x: 1 / len(ls) ** 2 for x in ls} for w, ls in (langs | more).items()}


_VOTES = _votes()
_LETTERS = {ch: lang for lang, chars in W.LETTERS.items() for ch in chars}


def _script(ch: str) -> str | None:
    o = ord(ch)
    return next((lang for a, z, lang in W.SCRIPTS if a <= o <= z), None) if o >= 0x370 else None


def _refusal_automaton() -> ahocorasick.Automaton:
    """Finds the kinds of words of which refusals are made."""
    kinds: dict[str, set[str]] = {}
    for kind, lines in W.REFUSAL_KINDS.items():
        for cue in (c for line in lines.splitlines() for c in line.split("|")):
            if cue.strip():
                kinds.setdefault(" " + cue.lstrip() if cue[0] == " " else cue, set()).add(kind)
    a = ahocorasick.Automaton()
    for cue, ks in kinds.items():
        a.add_word(cue, tuple(ks))
    a.make_automaton()
    return a


_REFUSAL = _refusal_automaton()
_PLURAL = re.compile(r" (?:we|wir|nous|nós|noi|podemos|possiamo) ")
_APART = re.compile(r"[^\w'-]+|(?<!\w)['-]|['-](?!\w)")


def declines(sentence: str) -> float:
    """How surely a sentence declines to answer, by the kinds of words that meet in it: 1, 0.5 or 0.

    1: someone who speaks of themself isn't able or allowed to do the task, or declines it; rules forbid it; what is private
    will not be given. 0.5: the same without a task, which anyone may say of anything.
    """
    plain = " " + _APART.sub(" ", sentence.casefold().replace("’", "'")) + " "
    met: set[str] = set()
    for _, kinds in _REFUSAL.iter(plain):
        met.update(kinds)
    unable = {"unable", "not"} <= met
    if "self" in met:
        if "decline" in met or unable and "task" in met or {"forbid", "task"} <= met and ("not" in met or "rule" in met or "sorry" in met):
            return 1.0
        if "rule" in met and ("forbid" in met or unable) or "forbid" in met and "task" in met and ("outside" in plain or "beyond" in plain):
            return 1.0
    elif {"withheld", "private"} <= met or {"rule", "forbid", "task"} <= met or unable and {"sorry", "task"} <= met:
        return 1.0
    alone = "self" in met and not _PLURAL.search(plain)  # shops and offices say "we" of themselves
    return 0.5 if alone and (unable or "forbid" in met) or unable and "task" in met or {"sorry", "task", "not"} <= met else 0.0


class SuffixAutomaton:
    """Of a sequence of words; ``covered`` counts the words of another sequence that lie in common runs."""

    def __init__(self, words: tuple[str, ...]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len = [-1], [0]
        last = 0
        for w in words:
            cur = len(self.len)
            self.next.append({})
            self.len.append(self.len[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][w]
                if self.len[p] + 1 == self.len[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.len)
                    self.next.append(dict(self.next[q]))
                    self.len.append(self.len[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(w) == q:
                        self.next[p][w] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def covered(self, words: list[str], least: int) -> int:
        """Words inside runs of ``least`` or more words that also stand in the sequence."""
        v = n = total = upto = 0
        for i, w in enumerate(words):
            while v and w not in self.next[v]:
                v = self.link[v]
                n = self.len[v]
            if w in self.next[v]:
                v = self.next[v][w]
                n += 1
            else:
                v = n = 0
            if n >= least:
                start = max(i - n + 1, upto)
                total += i + 1 - start
                upto = i + 1
        return total


@lru_cache(maxsize=4096)
def _prompt(prompt: str) -> tuple[SuffixAutomaton, int, str | None]:
    """Automaton, number of words, and the language an answer should have (None if it can't be told)."""
    low = prompt.casefold()
    words = tuple(_WORD.findall(low))
    asked = [_NAMES[m.group(1)] for m in _ANSWER_IN.finditer(low) if m.group(1) in _NAMES]
    return SuffixAutomaton(words), len(words), asked[-1] if asked else language_of(words, 1.2)


def language_of(words, margin: float = 1.5) -> str | None:
    """The language with most votes of its function words; None without a lead of ``margin`` times the next."""
    votes: dict[str, float] = {}
    for w in words:
        for lang, x in _VOTES.get(w, {}).items():
            votes[lang] = votes.get(lang, 0.0) + x
        if not w.isascii():
            for ch in w:
                if lang := _LETTERS.get(ch) or _script(ch):
                    votes[lang] = votes.get(lang, 0.0) + 0.5
    if not votes:
        return None
    best = sorted(votes.items(), key=lambda x: -x[1])
    if best[0][1] < 0.5 or len(best) > 1 and best[0][1] < margin * best[1][1]:
        return None
    return best[0][0]


def texts_of(value: Any) -> list[str]:
    """The text values of a JSON value in their order."""
    out: list[str] = []
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict):
            stack.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            stack.extend(reversed(v))
    return out


def is_nothing(value: Any) -> bool:
    """True if the value holds nothing but null, blank or N/A texts and empty containers."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            stack.extend(v.values())
        elif isinstance(v, list):
            stack.extend(v)
        elif isinstance(v, str):
            if v.strip().casefold() not in _NULLS:
                return False
        elif v is not None:
            return False
    return True


def unclosed(text: str) -> bool:
    """True if the delimiters of the JSON that the text begins are left open at its end (or its outer string is)."""
    t = _OPEN_FENCE.sub("", text, count=1) if "```" in text else text
    t = t.rstrip().removesuffix("```").strip()
    if t.startswith('"') and "{" in t[:4] + t[4:8]:
        inner = t[1:].replace('\\"', '"').replace("\\\\", "\\")
        return not t.endswith('"') or len(t) < 2 or unclosed(inner.removesuffix('"'))
    starts = [i for i in (t.find("{"), t.find("[")) if i >= 0]
    if not starts:
        return False
    stack: list[str] = []
    inside = escaped = False
    for ch in t[min(starts) :]:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append(ch)
        elif ch in "}]" and stack:
            stack.pop()
            if not stack:
                return False
    return bool(stack) or inside


def stops_within_word(texts: list[str], content: str | None) -> bool:
    """True if the last text value ends where a word of the page goes on.

    Values of one word may be codes and keywords, which happen to begin words of the page; they say nothing.
    """
    last = next((t for t in reversed(texts) if len(_WORD.findall(t)) > 1), "").rstrip()
    cut = last.rstrip(" .…")
    if cut != last and (last.endswith("…") or last.endswith("...")):
        last = cut
    if not content or not last or not last[-1].isalpha():
        return False
    i, whole = content.find(last), False
    while i >= 0 and not whole:
        j = i + len(last)
        whole = not (j < len(content) and content[j].isalpha())
        if whole:
            return False
        i = content.find(last, i + 1)
        if i < 0:
            return True
    return False


def _refuses(texts: list[str], content: str | None) -> bool:
    """True if sentences that decline, and that the page doesn't hold, make up half of the answer's text or more.

    Sentences that may decline count if the answer holds hardly anything else.
    """
    sentences = [s for t in texts for s in _SENT.split(t) if len(s) > 3]
    said = sum(map(len, sentences))
    sure = maybe = 0
    page: str | None = None
    for s in sentences:
        if how := declines(s):
            if page is None:
                page = (content or "").casefold()
            if s.strip(" .>*").casefold() not in page:
                maybe += len(s)
                sure += len(s) * (how == 1)
    return maybe > 0 and (sure * 2 >= said or maybe >= 0.9 * said)


def defect_of(prompt: str | None, response: str | None, schema: str | None, content: str | None) -> str | None:
    """The defect of one pair, None for a good one or for a null or blank prompt."""
    if prompt is None or not prompt.strip():
        return None
    if response is None or response.strip().casefold() in _NULLS:
        return "empty"
    value = find_value(response, container=False)
    if value is not NOTHING and is_nothing(value):
        return "empty"
    if value is NOTHING and not response.replace("```json", "").replace("`", "").strip():
        return "empty"
    texts = [response] if value is NOTHING else texts_of(value)
    prose = value is NOTHING and "{" not in response
    if (prose or value is not NOTHING) and _refuses(texts, content):
        return "refusal"
    automaton, n_prompt, expected = _prompt(prompt)
    words = [w for t in texts for w in _WORD.findall(t.casefold())]
    if words and automaton.covered(words, min(3, n_prompt)) >= 0.75 * len(words):
        return "copy"
    if isinstance(value, (dict, list)) and schema:
        own = find_value(schema)
        if own is not NOTHING and own and _same_schema(value, own):
            return "copy"
    if value is NOTHING and unclosed(response):
        return "truncated"
    if stops_within_word(texts, content):
        return "truncated"
    running = [w for t in texts if t.count(" ") >= 3 and "://" not in t for w in _WORD.findall(t.casefold())]
    if expected and len(running) >= 6:
        got = language_of(running)
        if got and got != expected:
            return "wrong_language"
    return None


def _same_schema(value: Any, schema: Any) -> bool:
    a, b = canonical(value), canonical(schema)
    if a == b:
        return True
    if not (isinstance(value, dict) and "properties" in value):
        return False
    x, y = Counter(_WORD.findall(a)), Counter(_WORD.findall(b))
    return sum((x & y).values()) >= 0.8 * max(sum(x.values()), 1)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, out = [], []
        for id_, prompt, response, schema, content in zip(*(c.to_pylist() for c in b.columns)):
            d = defect_of(prompt, response, schema, content)
            if d:
                ids.append(id_)
                out.append(d)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], names=["id", "defect"])


def defective_pairs(rows: DataFrame) -> DataFrame:
    """``id, defect``: one row per defective pair.

    ``rows`` needs ``id, prompt, response, schema, content``; other columns are ignored. Null ids and null or blank
    prompts are no pairs; an id delivered twice counts once; null schema or content only switch off their tests.
    """
    return (
        rows.select("id", "prompt", "response", "schema", "content").filter("id is not null and prompt is not null")
        .mapInArrow(_run, "id string, defect string").dropDuplicates(["id"])
    )
