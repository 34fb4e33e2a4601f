"""JSON values inside texts: bare, fenced, after prose, or as a JSON string that holds JSON."""

from __future__ import annotations

import json
import re

_FENCE = re.compile(r"```[A-Za-z0-9_-]*[ \t]*\r?\n?(.*?)```", re.S)
_DECODER = json.JSONDecoder(parse_constant=lambda x: (_ for _ in ()).throw(ValueError(x)))


class NOTHING:
    """Stands for no value; a class, so that it stays the same object in other processes."""


def _loads(text: str):
    try:
        return _DECODER.decode(text)
    except (ValueError, RecursionError):
        return NOTHING


def _unwrapped(value):
    """Open JSON strings that hold JSON, however many lie in one another; each is shorter than the one around it."""
    while isinstance(value, str):
        inner = _loads(value.strip())
        if inner is NOTHING:
            break
        value = inner
    return value


def find_value(text: str | None, container: bool = True):
    """The one complete JSON object or array that ``text`` holds, else ``NOTHING``.

    Tried in order: the whole text; the body of the first fence; what follows a line of prose. Only white space (or the
    closing fence) may follow it.
    """
    if not text:
        return NOTHING
    ok = (dict, list) if container else (dict, list, str, int, float, bool, type(None))
    t = text.strip().lstrip("\ufeff")
    v = _loads(t)
    if v is NOTHING:
        m = _FENCE.search(t)
        if m:
            v = _loads(m.group(1).strip())
    if v is NOTHING:
        starts = [i for i in (t.find("{"), t.find("[")) if i >= 0]
        if starts:
            i = min(starts)
            try:
                v, end = _DECODER.raw_decode(t, i)
                if t[end:].strip(" \r\n\t`"):
                    v = NOTHING
            except (ValueError, RecursionError):
                v = NOTHING
    if v is NOTHING:
        return NOTHING
    v = _unwrapped(v)
    if isinstance(v, str) and container:
        m = _FENCE.search(v)
        v = _loads(m.group(1).strip()) if m else v
    return v if isinstance(v, ok) else NOTHING


def canonical(value) -> str:
    """Sorted-key compact JSON; equal for values that differ only in layout and key order."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
