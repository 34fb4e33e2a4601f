"""Problem 9: passages of held-out test items inside training documents.

Wu-Manber over words: the patterns are all windows of three words of the items. A shift table over blocks of two words
says how far the next possible pattern end is; the table is asked for all places of a batch of documents at once, and
only those with shift 0 stay. The suffix bucket gives the windows that end so, and direct comparison of their words
confirms them. From confirmed windows the passage is extended to both sides, across single replaced, missing or
additional words, and its length is compared with the item's.

A passage of s words of which a fifth is replaced keeps at least s - 2 - 3 (s div 5) of its windows. As many within
a narrow band of alignments are asked for before a passage is extended; so a chance window costs no more than its place in
an array, and every passage in which up to a fifth of the words is replaced or missing is met. Five words with the middle one replaced, half of an
item of nine or ten, keep no window and are met by two and two words. Items too short for windows of three have windows of
one or two. The items are a stated set: their tables are built once in every Python process, in blocks of bounded size, and
the corpus streams past them without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.llm.words import word_hashes

_WINDOW, _BLOCK, _GAP = 3, 2, 2
_SHIFT_BITS = 20


def _windows(ids: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """One number for the words at the given places after each position; exact for fewer than 2^21 different words."""
    n = len(ids) - places[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for p in places:
            out = out * np.uint64(1 << 21) + ids[p : p + n].astype(np.uint64) if len(places) <= 3 else (out ^ ids[p : p + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _slot(block: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (block * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SHIFT_BITS)


class _Bucket:
    """Windows of one form: sorted numbers with the items and places that have them."""

    def __init__(self, places: tuple[int, ...], found: list[tuple[int, int, int]]):
        found.sort()
        self.places = places
        number = np.array([f[0] for f in found], np.uint64)
        self.item, self.place = (np.array([f[x] for f in found], np.int64) for x in (1, 2))
        self.number, self.start = np.unique(number, return_index=True)
        self.size = np.diff(np.append(self.start, len(found)))

    def hits(self, numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the item, place in the document) of the ``numbers`` that stand in the bucket."""
        where = np.minimum(np.searchsorted(self.number, numbers), len(self.number) - 1)
        same = self.number[where] == numbers
        where, at = where[same], at[same]
        size = self.size[where]
        first = np.repeat(self.start[where] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return self.item[first], self.place[first], np.repeat(at, size)


class ItemTables:
    """Shift table, suffix buckets and the words of the items."""

    def __init__(self, items: list[tuple[int, str]], share: float = 0.5):
        hashes, ends = word_hashes([t for _, t in items], join=True)
        self.vocabulary = np.unique(hashes)
        numbers = self.number(hashes)
        self.keys, self.words, need, forms = [], [], [], {}
        for (key, _), a, z in zip(items, ends[:-1], ends[1:]):
            if z > a:
                ids = numbers[a:z]
                k, least = len(self.keys), math.ceil(share * len(ids) - 1e-9)
                self.keys.append(key)
                self.words.append(ids.tolist())
                places = [tuple(range(min(_WINDOW, least)))] + ([(0, 1, 3, 4)] if least == 5 else [])
                for p in places:
                    forms.setdefault(p, []).extend((w, k, i) for i, w in enumerate(_windows(ids, p).tolist()))
                sure = min(s - (_WINDOW - 1) - _WINDOW * (s // 5) for s in range(least, least + 6))
                need.append(max(1, sure))
        self.need = np.array(need, np.int64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.buckets = [_Bucket(p, found) for p, found in sorted(forms.items())]
        # distance from the nearest pattern end that a block allows
        self.shift = np.full(1 << _SHIFT_BITS, _WINDOW - _BLOCK + 1, np.int8)
        for p, found in forms.items():
            if p == (0, 1, 2):
                windows = np.array([f[0] for f in found], np.uint64)
                self.shift[_slot(windows >> np.uint64(21))] = 1
                self.shift[_slot(windows & np.uint64((1 << 42) - 1))] = 0

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the words from 1; 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place of the window in the item, place in the text) of all windows that occur."""
        out = [(np.zeros(0, np.int64),) * 3]
        for b in self.buckets:
            numbers = _windows(ids, b.places)
            if b.places == (0, 1, 2):
                at = np.flatnonzero(self.shift[_slot(numbers & np.uint64((1 << 42) - 1))] == 0)
            else:
                at = np.flatnonzero(ids[: len(numbers)])
            out.append(b.hits(numbers[at], at))
        return tuple(np.concatenate(x) for x in zip(*out))

    def seeds(self, ids: np.ndarray, text_no: np.ndarray) -> np.ndarray:
        """Rows (text, item, place in the item, place in the text) of the hits of which enough lie along one alignment."""
        item, i, p = self.hits(ids)
        text, along = text_no[p], p - i
        order = np.argsort(((text * len(self.words) + item) << 28) + along + self.length.max(initial=0))
        item, i, p, text, along = item[order], i[order], p[order], text[order], along[order]
        n = len(item)
        last = np.arange(n) + self.need[item] - 1
        inside = np.minimum(last, n - 1)
        near = (last < n) & (text[inside] == text) & (item[inside] == item)
        near &= along[inside] - along <= 2 * _GAP + self.length[item] // 5
        turn = np.zeros(n + 1, np.int64)
        np.add.at(turn, np.flatnonzero(near), 1)
        np.add.at(turn, last[near] + 1, -1)
        kept = np.cumsum(turn)[:n] > 0
        rows = np.stack([text, item, i, p], axis=1)[kept]
        return rows[np.lexsort((rows[:, 2], rows[:, 3], rows[:, 1], rows[:, 0]))]


#: Words left out of the item and of the document at a mismatch, in the order they are tried.
_JUMPS = ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0), (1, 2), (2, 1), (2, 2))
_SIGNED = {step: tuple((step * x, step * y) for x, y in _JUMPS) for step in (1, -1)}


def _reach(a: list[int], i: int, b: list[int], j: int, step: int) -> tuple[int, int, int]:
    """Extend a common passage from (i, j) in one direction: last matched places and the number of further matches.

    At a mismatch the first jump counts after which two words agree in a row (one at the item's end).
    """
    matches, li, lj = 0, i, j
    na, nb, jumps = len(a), len(b), _SIGNED[step]
    x, y = i + step, j + step
    while 0 <= x < na and 0 <= y < nb:
        if a[x] != b[y]:
            for dx, dy in jumps:
                u, v = x + dx, y + dy
                if 0 <= u < na and 0 <= v < nb and a[u] == b[v]:
                    u2, v2 = u + step, v + step
                    if not 0 <= u2 < na or 0 <= v2 < nb and a[u2] == b[v2]:
                        x, y = u, v
                        break
            else:
                break
        li, lj = x, y
        matches += 1
        x += step
        y += step
    return li, lj, matches


def passages(tables: ItemTables, texts: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """For each text and item it meets the longest passage.

    (text, item, words of the item spanned, words equal, first word in the text, last); texts and items are numbered
    from 0.
    """
    hashes, ends = word_hashes(texts, join=True)
    # one word that no item has between the texts, so that no window spans two
    sizes = np.diff(ends)
    text_no = np.repeat(np.arange(len(texts)), sizes + 1)
    ids = np.zeros(len(text_no), np.int64)
    gap = np.cumsum(sizes + 1) - 1
    real = np.ones(len(ids), bool)
    real[gap] = False
    ids[real] = tables.number(hashes)
    begin = np.concatenate([[0], gap[:-1] + 1]) if len(texts) else gap
    open_text, doc, group, best, done = -1, [], None, (0, 0, 0, 0), []
    for t, k, i, p in tables.seeds(ids, text_no).tolist():
        if (t, k) != group:
            if group is not None:
                yield *group, *best
            group, best, done = (t, k), (0, 0, 0, 0), []
        if t != open_text:
            open_text, doc = t, ids[begin[t] : gap[t]].tolist()
        p -= int(begin[t])
        if any(lo <= p <= hi and abs(p - i - d) <= 2 * _GAP for lo, hi, d in done):
            continue
        item = tables.words[k]
        ri, rj, right = _reach(item, i, doc, p, 1)
        li, lj, left = _reach(item, i, doc, p, -1)
        done.append((lj, rj, p - i))
        found = (ri - li + 1, right + left + 1, lj, rj)
        if found[:2] > best[:2]:
            best = found
    if group is not None:
        yield *group, *best


def _stated_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes`` of text, one block on the driver at a time."""
    items = items.select("item_id", "text").filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = (items if blocks == 1 else items.filter(number == b)).distinct().collect()
        if rows:
            yield [(r.item_id, r.text) for r in sorted(rows)]


def leaked_items(documents: DataFrame, items: DataFrame, share: float = 0.5, block_bytes: int = 8 << 20) -> DataFrame:
    """``doc_id, item_id, share, doc_word_start, doc_word_end``: documents that hold at least ``share`` of an item's words.

    Words count as held if they stand in the passage's order in one stretch; single words in it may be replaced. The
    stretch from its first to its last equal word must span ``share`` of the item and four fifths of it be equal.
    Case, punctuation, line breaks, markup and accents are ignored. Null and empty texts, and items without a word, give no
    row; items of one word on are searched; repeated rows count once; extra columns are ignored. ``items`` is a stated set
    of any size: what the processes load at a time is bounded by ``block_bytes``, and each block is one pass over the
    documents.
    """
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    schema = "doc_id bigint, item_id bigint, share double, doc_word_start int, doc_word_end int"

    def search(stated: list[tuple[int, str]]) -> DataFrame:
        handed = spark.sparkContext.broadcast(stated)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = ItemTables(handed.value, share)
            for whole in batches:
                for at in range(0, whole.num_rows, 256):  # the arrays of a few texts stay in the processor's cache
                    b = whole.slice(at, 256)
                    ids, out = b.column(0).to_pylist(), []
                    for t, k, span, equal, lo, hi in passages(tables, b.column(1).to_pylist()):
                        n = len(tables.words[k])
                        if span >= share * n and equal >= 0.8 * span:
                            out.append((ids[t], tables.keys[k], span / n, lo, hi))
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, x) for c, x in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()))],
                            names=["doc_id", "item_id", "share", "doc_word_start", "doc_word_end"],
                        )

        return texts.mapInArrow(run, schema)

    found = spark.createDataFrame([], schema)
    for stated in _stated_blocks(items, block_bytes):
        found = found.unionByName(search(stated))
    return found.dropDuplicates(["doc_id", "item_id"])


def leaks_by_item(found: DataFrame) -> DataFrame:
    """``item_id, n_docs, max_share``: which test items leaked, and how widely."""
    return found.groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("max_share"))
