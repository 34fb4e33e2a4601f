"""Words of a text, made equal for texts that differ in case, punctuation, spacing, markup or character encoding only."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_JOINERS = ".,'’‘`´*_-‐‑‒–—―"
_UNSEEN = "­​‌‍‎‏⁠﻿"
_MARK_RANGES = ((0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x64B, 0x65F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0x3099, 0x309A), (0xFE20, 0xFE2F))
_MOJIBAKE = re.compile(r"[ÂÃâ][\u0080-¿Œ-Ÿƒˆ˜–-™€]{1,2}")
_INSIDE = re.compile(rf"(?<=\w)[{re.escape(_JOINERS)}]+(?=\w)")
_DROPPED = re.compile("[" + _UNSEEN + "".join(f"{chr(a)}-{chr(z)}" for a, z in _MARK_RANGES) + "]+")


def _mended(m: re.Match[str]) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return m.group().encode(code).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return m.group()


def _decomposed(text: str) -> str:
    """Entities resolved, UTF-8 read as Latin-1 mended, compatibility forms taken apart, lower case; marks still in."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        if "Ã" in text or "Â" in text or "â" in text:
            text = _MOJIBAKE.sub(_mended, text)
        text = unicodedata.normalize("NFKD", text)
    return text.casefold()


def folded(text: str) -> str:
    """Entities resolved, UTF-8 read as Latin-1 mended, compatibility forms and accents dropped, lower case."""
    t = _decomposed(text)
    return t if t.isascii() else _DROPPED.sub("", t)


def words_of(text: str, join: bool = False) -> list[str]:
    """The runs of letters and digits of the folded text; ``join`` closes punctuation inside words first (176.5, o'clock)."""
    t = folded(text)
    return _WORD.findall(_INSIDE.sub("", t) if join else t)


# -- the same words as numbers, for many texts at a time ---------------------------------------------------------------
_BREAK, _PART, _JOINER, _DROP = 0, 1, 2, 3
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point is: part of a word, joiner, dropped or a break."""
    kind = np.fromiter((chr(c).isalnum() for c in range(0x110000)), np.uint8, 0x110000)
    kind[[ord(c) for c in _JOINERS]] = _JOINER
    kind[[ord(c) for c in _UNSEEN]] = _DROP
    for a, z in _MARK_RANGES:
        kind[a : z + 1] = _DROP
    return kind


def _powers(n: int, _made: dict[str, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006, kept between calls
    """The first ``n`` or more powers of the base and of its inverse modulo 2^64."""
    if len(_made.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.empty(size, np.uint64)
            p[0], m = 1, 1
            while m < size:  # the second half is the first times base^m
                with np.errstate(over="ignore"):
                    p[m : 2 * m] = p[:m] * np.uint64(pow(x, m, 1 << 64))
                m *= 2
            _made[name] = p
    return _made["up"], _made["down"]


def word_hashes(texts: list[str], join: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, in their order, and where each text's words start (one more at the end).

    The same words as ``words_of``; no object is made per word.
    """
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    parts = [_decomposed(t) for t in texts]
    chars = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(p) + 1 for p in parts])
    kind = _kinds()[chars]
    text_no = None
    if (kind >= _JOINER).any():
        keep = kind != _DROP
        if join:
            joiner = kind == _JOINER
            # nearest kept code point that is no joiner, before and after, must both be parts of words
            solid = np.flatnonzero(keep & ~joiner)
            at = np.flatnonzero(joiner)
            right = np.searchsorted(solid, at)  # the last code point is a break, so there is one
            before = np.where(right > 0, kind[solid[right - 1]], _BREAK)
            keep[at] = ~((before == _PART) & (kind[solid[right]] == _PART))
        text_no = np.cumsum(keep)[ends - 1]
        chars, kind = chars[keep], kind[keep]
        ends = text_no
    part = kind == _PART
    edge = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).view(np.int8)))
    start, stop = edge[::2], edge[1::2]
    up, down = _powers(len(chars) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(0x51ED270B)) * up[: len(chars)], dtype=np.uint64)])
        h = (total[stop] - total[start]) * down[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h, np.concatenate([[0], np.searchsorted(start, ends)])
