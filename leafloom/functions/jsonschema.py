"""Validation of JSON values against a JSON Schema (N18). Unknown keywords are ignored, unknown references fail."""

from __future__ import annotations

import json
import re
from typing import Any

_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
}


def _key(value: Any) -> str:
    """Equal for equal JSON values: numbers by value, booleans apart from numbers, key order ignored."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return f"n{float(value)!r}"
    if isinstance(value, list):
        return "[" + ",".join(map(_key, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{_key(value[k])}" for k in sorted(value)) + "}"


class Validator:
    """``error(value)`` is None for a value that fulfils the schema, else what is wrong first."""

    def __init__(self, schema: Any):
        self.root = schema

    def _target(self, ref: str) -> Any:
        if not ref.startswith("#"):
            raise ValueError(f"reference {ref} can't be followed")
        at = self.root
        for step in filter(None, ref[1:].split("/")):
            step = step.replace("~1", "/").replace("~0", "~")
            at = at[int(step)] if isinstance(at, list) else at[step]
        return at

    def error(self, value: Any) -> str | None:
        try:
            return self._check(self.root, value, "$", frozenset())
        except (KeyError, IndexError, ValueError, re.error, RecursionError) as e:
            return f"schema: {e}"

    def _check(self, s: Any, v: Any, at: str, depth: frozenset) -> str | None:
        """``depth`` has the references followed for this very value: one met again would go in a circle."""
        if s is True or s == {}:
            return None
        if s is False:
            return f"{at}: nothing is allowed"
        if not isinstance(s, dict):
            raise ValueError(f"{at}: a schema must be an object or a boolean")
        if "$ref" in s:
            step = (s["$ref"], at)
            if step in depth:
                raise ValueError("references in a circle")
            if e := self._check(self._target(s["$ref"]), v, at, depth | {step}):
                return e
        if "type" in s:
            kinds = s["type"] if isinstance(s["type"], list) else [s["type"]]
            if any(k not in _TYPES for k in kinds):
                raise ValueError(f"{at}: unknown type {kinds}")
            if not any(_TYPES[k](v) for k in kinds):
                return f"{at}: not of type {'/'.join(kinds)}"
        if "enum" in s and _key(v) not in {_key(x) for x in s["enum"]}:
            return f"{at}: none of the allowed values"
        if "const" in s and _key(v) != _key(s["const"]):
            return f"{at}: not the constant"
        for part in s.get("allOf", ()):
            if e := self._check(part, v, at, depth):
                return e
        if "anyOf" in s and all(self._check(p, v, at, depth) for p in s["anyOf"]):
            return f"{at}: fits none of anyOf"
        if "oneOf" in s and sum(self._check(p, v, at, depth) is None for p in s["oneOf"]) != 1:
            return f"{at}: doesn't fit exactly one of oneOf"
        if "not" in s and self._check(s["not"], v, at, depth) is None:
            return f"{at}: fits not"
        if "if" in s:
            branch = "then" if self._check(s["if"], v, at, depth) is None else "else"
            if branch in s and (e := self._check(s[branch], v, at, depth)):
                return e
        if isinstance(v, dict):
            return self._object(s, v, at, depth) or self._unevaluated(s, v, at, depth)
        if isinstance(v, list):
            return self._array(s, v, at, depth) or self._unevaluated(s, v, at, depth)
        if isinstance(v, str):
            if len(v) < s.get("minLength", 0) or len(v) > s.get("maxLength", len(v)):
                return f"{at}: length {len(v)}"
            if "pattern" in s and not re.search(s["pattern"], v):
                return f"{at}: doesn't match the pattern"
        elif _TYPES["number"](v):
            low, high = s.get("minimum"), s.get("maximum")
            if low is not None and v < low or high is not None and v > high:
                return f"{at}: out of range"
            low, high = s.get("exclusiveMinimum"), s.get("exclusiveMaximum")
            if _TYPES["number"](low) and v <= low or _TYPES["number"](high) and v >= high:
                return f"{at}: out of range"
            if "multipleOf" in s and abs(v / s["multipleOf"] - round(v / s["multipleOf"])) > 1e-9:
                return f"{at}: no multiple of {s['multipleOf']}"
        return None

    def _seen(self, s: Any, v: Any, at: str, depth: frozenset) -> set:
        """The members or elements of ``v`` that a schema which it fulfils has looked at."""
        if not isinstance(s, dict):
            return set()
        out: set = set()
        if isinstance(v, dict):
            if "additionalProperties" in s or "unevaluatedProperties" in s:
                return set(v)
            out |= v.keys() & s.get("properties", {}).keys()
            out |= {k for k in v for p in s.get("patternProperties", {}) if re.search(p, k)}
        else:
            items = s.get("items")
            if items is not None and not isinstance(items, list) or "unevaluatedItems" in s or "additionalItems" in s:
                return set(range(len(v)))
            out |= set(range(min(len(v), len(s.get("prefixItems", items or [])))))
            if "contains" in s:
                out |= {i for i, x in enumerate(v) if self._check(s["contains"], x, f"{at}[{i}]", depth) is None}
        parts = [*s.get("allOf", ()), *s.get("anyOf", ()), *s.get("oneOf", ())]
        if "$ref" in s and (s["$ref"], at) not in depth:
            parts.append(self._target(s["$ref"]))
            depth = depth | {(s["$ref"], at)}
        if "if" in s:
            parts += [s["if"], s.get("then", True)] if self._check(s["if"], v, at, depth) is None else [s.get("else", True)]
        for p in parts:
            if self._check(p, v, at, depth) is None:
                out |= self._seen(p, v, at, depth)
        return out

    def _unevaluated(self, s: dict, v: Any, at: str, depth: frozenset) -> str | None:
        """What no other keyword has looked at must fulfil ``unevaluatedProperties`` or ``unevaluatedItems``."""
        word = "unevaluatedProperties" if isinstance(v, dict) else "unevaluatedItems"
        if word not in s:
            return None
        seen = self._seen({k: x for k, x in s.items() if k != word}, v, at, depth)
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            place = f"{at}.{k}" if isinstance(v, dict) else f"{at}[{k}]"
            if k not in seen and (e := self._check(s[word], x, place, frozenset())):
                return e
        return None

    def _object(self, s: dict, v: dict, at: str, depth: frozenset) -> str | None:
        for k in s.get("required", ()):
            if k not in v:
                return f"{at}: {k} is missing"
        if len(v) < s.get("minProperties", 0) or len(v) > s.get("maxProperties", len(v)):
            return f"{at}: {len(v)} members"
        for k, needs in s.get("dependentRequired", {}).items():
            if k in v and any(n not in v for n in needs):
                return f"{at}: {k} needs other members"
        props, patterns, rest = s.get("properties", {}), s.get("patternProperties", {}), s.get("additionalProperties", True)
        for k, x in v.items():
            known = False
            if "propertyNames" in s and (e := self._check(s["propertyNames"], k, f"{at}.{k}", depth)):
                return e
            if k in props:
                known = True
                if e := self._check(props[k], x, f"{at}.{k}", depth):
                    return e
            for p, sub in patterns.items():
                if re.search(p, k):
                    known = True
                    if e := self._check(sub, x, f"{at}.{k}", frozenset()):
                        return e
            if not known and rest is not True and (e := self._check(rest, x, f"{at}.{k}", depth)):
                return e
        return None

    def _array(self, s: dict, v: list, at: str, depth: frozenset) -> str | None:
        if len(v) < s.get("minItems", 0) or len(v) > s.get("maxItems", len(v)):
            return f"{at}: {len(v)} elements"
        if s.get("uniqueItems") and len({_key(x) for x in v}) < len(v):
            return f"{at}: repeated elements"
        first = s.get("prefixItems", s["items"] if isinstance(s.get("items"), list) else [])
        for i, (sub, x) in enumerate(zip(first, v)):
            if e := self._check(sub, x, f"{at}[{i}]", depth):
                return e
        rest = s.get("items") if not isinstance(s.get("items"), list) else s.get("additionalItems")
        if rest is not None:
            for i in range(len(first), len(v)):
                if e := self._check(rest, v[i], f"{at}[{i}]", depth):
                    return e
        if "contains" in s:
            hits = sum(self._check(s["contains"], x, at, depth) is None for x in v)
            if hits < s.get("minContains", 1) or hits > s.get("maxContains", hits):
                return f"{at}: {hits} elements fit contains"
        return None
