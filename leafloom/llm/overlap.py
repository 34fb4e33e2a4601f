"""Problem 7: records that stand, exactly or nearly, both in an evaluation split and in the training split.

The words of a text, numbered where they repeat, are a set; texts that agree in ``least`` of the longer one's words share
as many members. Texts are met in cells: one schema (as a JSON value) and one step of length, with the evaluation texts
of the steps beside it. In a cell an exact prefix filter finds the candidates: of sets of n members, sorted by one order
of all members, the first n - least * n + k then share k members; with the rarest first these are few, and no pair can
be missed. Candidates are verified at once by the number of members shared and of words that agree in order; their exact
Jaccard similarity is given too. So the words of a text are moved once, to its cell, and candidates aren't moved at all;
the words are taken from the texts a second time instead of being written. Large cells are cut into parts that meet each
other. Copies with equal words are one class until the very end, so a group of copies costs no more than one row per
split side and task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions.jsontext import NOTHING, canonical, find_value
from leafloom.llm.words import word_hashes
from leafloom.session import cut_lineage

_SIG = "ft_id bigint, split string, source string, side string, schema_key bigint, class bigint, n int"
_CELL = "cell bigint, in_train boolean, class bigint, words binary"
_EVAL_WORDS = 3_000_000  # words of the evaluation texts that a task holds at a time
_TRAIN_WORDS = 10_000_000  # words of the training texts that pass them in one task
_AT_ONCE = 1_000_000  # words of a slice of training texts, and members it shares, counted at a time
_MORE = 12  # a prefix is longer by one word in so many, and as many more words must be shared


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``k`` words; a shorter text is one run."""
    if len(ids) == 0:
        return ids.astype(np.uint64)
    k = min(k, len(ids))
    with np.errstate(over="ignore"):
        h = np.zeros(len(ids) - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - k + 1 + j].astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def _grouped(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in one array, and which part each is of."""
    return np.concatenate([*parts, np.zeros(0, np.uint32)]), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def all_members(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For many texts at a time 64-bit hashes of their words with the number among equal ones in the text, and the text.

    So each text is a set, and two sets overlap as the texts' words do. The members of a text stand together.
    """
    ids, text = _grouped(parts)
    key = np.sort((text.astype(np.uint64) << np.uint64(32)) + ids)
    place = np.arange(len(key))
    nth = place - np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]][: len(key)], place, 0))
    with np.errstate(over="ignore"):
        h = ((key & np.uint64(0xFFFFFFFF)) + (nth.astype(np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32)), text


def shared_at_least(n: int, least: float) -> int:
    return min(1 + n // _MORE, max(1, math.ceil(least * n - 1e-9)))


def agree_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, 64 or more words at a time in one integer."""
    if len(a) > len(b):
        a, b = b, a
    mask: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        mask[w] = mask.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        u = v & mask.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose arrays stay in the processor's cache."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _worded(schemas: list[str], contents: list[str], keys: dict[str, int]) -> Iterator[tuple[int, int, bytes]]:
    """Of each record the hash of its schema, that of schema and words, and the words as numbers."""
    hashes, ends = word_hashes(contents)
    ids = (hashes >> np.uint64(32)).astype(np.uint32)
    for schema, a, z in zip(schemas, ends[:-1].tolist(), ends[1:].tolist()):
        if schema not in keys:
            if len(keys) > 20_000:  # a cache: keys are found again
                keys.clear()
            v = find_value(schema, container=False)
            keys[schema] = xxhash.xxh3_64_intdigest(re.sub(r"\s+", " ", schema.strip()) if v is NOTHING else canonical(v))
        raw = ids[a:z].tobytes()
        yield _signed(keys[schema]), _signed(xxhash.xxh3_64_intdigest(raw, keys[schema])), raw


def _signatures(rows: DataFrame) -> DataFrame:
    """Each record without its texts, with the hash of its schema, that of schema and words, and the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, int] = {}
        for b in _slices(batches):
            found = list(_worded(b.column(4).to_pylist(), b.column(5).to_pylist(), keys))
            n = [len(raw) // 4 for _, _, raw in found]
            out = pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([x for x, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.int64()), pa.array(n, pa.int32())],
                names=["ft_id", "split", "source", "side", "schema_key", "class", "n"],
            )
            yield out.filter(pa.array([k > 0 for k in n], pa.bool_()))

    return rows.mapInArrow(run, _SIG)


def _step(n: int, least: float) -> int:
    """The logarithm of a length to the base 1 / ``least``, so partners lie at most one step apart."""
    return math.floor(math.log(n) / -math.log(least) + 1e-9) if least < 1 else n


def _large_cells(sig: DataFrame, least: float, eval_words: int, train_words: int) -> dict[tuple[int, int], tuple[int, int]]:
    """Into how many parts the training and the evaluation texts of a cell are cut, for the cells that are cut.

    These are fewer than all words by the words of a part.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / -math.log(least) + 1e-9).cast("int") if least < 1 else F.col("n")
    texts = sig.select("class", "side", "schema_key", "n", step.alias("step")).dropDuplicates(["class", "side"])
    met = F.when(F.col("side") == "train", F.array("step")).otherwise(F.array(*[F.col("step") + x for x in (-1, 0, 1)]))
    words = [F.sum(F.when(F.col("side") == x, F.col("n").cast("bigint")).otherwise(0)).alias(x) for x in ("train", "eval")]
    sums = texts.select("schema_key", "side", "n", F.explode(met).alias("step")).groupBy("schema_key", "step").agg(*words)
    cut = sums.filter(f"train > 0 and eval > 0 and (train > {train_words} or eval > {eval_words})").collect()
    return {(x.schema_key, x.step): (-(-x.train // train_words), -(-x.eval // eval_words)) for x in cut}


def _in_cells(rows: DataFrame, least: float, large: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """The words of each text, by the cells in which it meets others; copies within a task are one."""
    handed = rows.sparkSession.sparkContext.broadcast(large)

    def cells(schema: int, step: int, train: bool, klass: int) -> Iterator[int]:
        a, b = handed.value.get((schema, step), (1, 1))
        for part in ((klass % a, j) for j in range(b)) if train else ((i, klass // 7 % b) for i in range(a)):
            yield _signed(xxhash.xxh3_64_intdigest(np.array([schema, step, *part], np.int64).tobytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: dict[str, int] = {}
        seen: set[tuple[bool, int]] = set()
        for b in _slices(batches):
            out: list[tuple] = []
            for side, (schema, klass, raw) in zip(b.column(3).to_pylist(), _worded(b.column(4).to_pylist(), b.column(5).to_pylist(), keys)):
                train = side == "train"
                if not raw or (train, klass) in seen:
                    continue
                if len(seen) > 200_000:  # a cache: copies that come again are dropped in the cell
                    seen.clear()
                seen.add((train, klass))
                step = _step(len(raw) // 4, least)
                for s in (step,) if train else (step - 1, step, step + 1):
                    out += [(c, train, klass, raw) for c in cells(schema, s, train, klass)]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], names=["cell", "in_train", "class", "words"]
            )

    return rows.mapInArrow(run, _CELL)


class Block:
    """The evaluation texts of a cell, found by the members of their prefixes.

    Members are ordered by the number of these texts that hold them: those in none, which find nothing, come first.
    """

    def __init__(self, texts: list[np.ndarray], least: float):
        self.least = least
        m, text = all_members(texts)
        self.members, at, often = np.unique(m, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(often), np.int64)
        self.rank[np.argsort(often, kind="stable")] = np.arange(len(often))
        self.n = np.array([len(t) for t in texts])
        self.ranks, self.ends = self._sorted(self.rank[at], text, len(texts))
        r, text = self._prefixes(self.ranks, self.ends, self.n)
        order = np.lexsort((text, r))
        self.whose, self.start = text[order], np.searchsorted(r[order], np.arange(len(often) + 1))

    @staticmethod
    def _sorted(ranks: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The ranks of each text ascending, text by text, and where each text's ranks start (one more at the end)."""
        key = np.sort((text.astype(np.int64) << 32) | ranks)
        return key & 0xFFFFFFFF, np.searchsorted(key, np.arange(texts + 1, dtype=np.int64) << 32)

    def _prefixes(self, ranks: np.ndarray, ends: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks in the prefix of each text of n members, and the text; the members without a rank come first.

        Enough for ``shared_at_least`` of them to be shared with every partner.
        """
        size = np.array([k - max(1, math.ceil(self.least * k - 1e-9)) + shared_at_least(k, self.least) for k in n.tolist()], np.int64)
        ranked = np.diff(ends)
        text = np.repeat(np.arange(len(n)), ranked)
        keep = np.arange(len(ranks)) - np.repeat(ends[:-1], ranked) < np.repeat(size - (n - ranked), ranked)
        return ranks[keep], text[keep]

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Numbers of a training and an evaluation text that share as many members as ``least`` asks for."""
        m, text = all_members(texts)
        at = np.minimum(np.searchsorted(self.members, m), len(self.members) - 1)
        there = self.members[at] == m
        n = np.array([len(t) for t in texts])
        ranks, ends = self._sorted(self.rank[at[there]], text[there], len(texts))
        r, text = self._prefixes(ranks, ends, n)
        shares = [np.array([shared_at_least(k, self.least) for k in x.tolist()]) for x in (n, self.n)]
        mark = np.zeros(len(self.members), bool)
        found = self.start[r + 1] - self.start[r]
        places = np.cumsum(np.bincount(text, found, len(texts)).astype(np.int64))
        edges = [0, *(np.flatnonzero(np.diff(places // _AT_ONCE)) + 1).tolist(), len(texts)]
        for first, to in zip(edges[:-1], edges[1:]):
            a, z = np.searchsorted(text, (first, to))
            k = found[a:z]
            at = np.arange(k.sum()) + np.repeat(self.start[r[a:z]] - (np.cumsum(k) - k), k)
            key = self.whose[at] + np.repeat((text[a:z] - first) * len(self.n), k)
            if (to - first) * len(self.n) < 4 * len(key):
                shared = np.bincount(key)
                hit = np.flatnonzero(shared)
                shared = shared[hit]
            else:
                hit, shared = np.unique(key, return_counts=True)
            x, y = hit // len(self.n) + first, hit % len(self.n)
            enough = (shared >= np.minimum(shares[0][x], shares[1][y])) & (np.minimum(n[x], self.n[y]) >= self.least * np.maximum(n[x], self.n[y]) - 1e-9)
            x, y = x[enough], y[enough]
            whole, parts = np.unique(x, return_index=True)
            for p, i, j in zip(whole.tolist(), parts.tolist(), [*parts[1:].tolist(), len(x)]):
                mark[ranks[ends[p] : ends[p + 1]]] = True
                for q in y[i:j].tolist():
                    if np.count_nonzero(mark[self.ranks[self.ends[q] : self.ends[q + 1]]]) >= self.least * max(n[p], self.n[q]) - 1e-9:
                        yield p, q
                mark[ranks[ends[p] : ends[p + 1]]] = False


def _pieces(b: pa.RecordBatch, edges: list[int]) -> Iterator[tuple[int, int]]:
    """Places between the edges, at most so many rows and words at a time."""
    words = np.cumsum(pc.binary_length(b.column(3)).to_numpy() // 4)
    for a, z in zip(edges[:-1], edges[1:]):
        while a < z:
            to = min(z, a + 256, max(a + 1, int(np.searchsorted(words, words[a] + _AT_ONCE))))
            yield a, to
            a = to


def _verified(shingle: int, least: float):
    """Pairs of classes from rows sorted by cell, evaluation texts first, and class."""

    def pair(x: int, y: int, a: np.ndarray, c: np.ndarray) -> tuple | None:
        longer = max(len(a), len(c))
        agree = longer if x == y else agree_in_order(a, c)
        if agree < least * longer:
            return None
        s, t = shingle_hashes(a, shingle), shingle_hashes(c, shingle)
        both = len(np.intersect1d(s, t, assume_unique=True))
        return x, y, agree / longer, both / (len(s) + len(t) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, side, block, last = None, None, None, None
        classes: list[int] = []
        texts: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            cells, train, klass = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
            edges = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (train[1:] != train[:-1])) + 1).tolist(), len(cells)]
            keep: list[tuple] = []
            for a, z in _pieces(b, edges):
                if cells[a] != cell:
                    cell, block, classes, texts = cells[a], None, [], []
                    side = None
                if train[a] != side:
                    side, last = train[a], None
                if side and not classes:
                    continue
                new = [a + i for i, (x, y) in enumerate(zip(klass[a:z].tolist(), [last, *klass[a : z - 1].tolist()])) if x != y]
                last = int(klass[z - 1])
                own, some = klass[new].tolist(), [np.frombuffer(b.column(3)[i].as_py(), np.uint32) for i in new]
                if not side:
                    classes += own
                    texts += some
                elif new:
                    block = block or Block(texts, least)
                    keep += filter(None, (pair(own[p], classes[q], some[p], texts[q]) for p, q in block.candidates(some)))
            cols = list(zip(*keep)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))],
                names=["train_class", "eval_class", "agree", "jaccard"],
            )

    return run


def cross_split_pairs(
    records: DataFrame, train: str = "train", evaluation: tuple[str, ...] = ("test", "human_eval"), least: float = 0.75,
    shingle: int = 3, eval_words: int = _EVAL_WORDS, train_words: int = _TRAIN_WORDS,
) -> DataFrame:
    """``ft_id_a, ft_id_b`` (smaller first), ``eval_split, source, agree, jaccard``: all confirmed pairs.

    A pair has one record of ``train`` and one of ``evaluation`` with the same schema as a JSON value, and at least
    ``least`` of the words of the longer content agree in order. ``jaccard`` is the exact similarity of the shingle
    sets. The search is exact: no pair depends on chance. Cells beyond ``eval_words`` or ``train_words`` are cut; the result
    is the same.
    Null split, schema or content and contents without words give no pair; repeated ids count once; extra columns are
    ignored; ``source`` is the evaluation record's.
    """
    side = F.when(F.col("split") == train, "train").when(F.col("split").isin(*evaluation), "eval")
    rows = (
        records.select("ft_id", "split", "source", side.alias("side"), "schema", "content")
        .filter("ft_id is not null and side is not null and schema is not null and content is not null")
    )
    sig = cut_lineage(_signatures(rows))
    met = _in_cells(rows, least, _large_cells(sig, least, eval_words, train_words))
    met = met.repartition("cell").sortWithinPartitions("cell", "in_train", "class")
    sure = met.mapInArrow(_verified(shingle, least), "train_class bigint, eval_class bigint, agree double, jaccard double")
    t = sig.filter("side = 'train'").select(F.col("class").alias("train_class"), F.col("ft_id").alias("t_id"))
    e = sig.filter("side = 'eval'").select(F.col("class").alias("eval_class"), F.col("ft_id").alias("e_id"), F.col("split").alias("eval_split"), "source")
    return (
        sure.join(t, "train_class").join(e, "eval_class")
        .select(F.least("t_id", "e_id").alias("ft_id_a"), F.greatest("t_id", "e_id").alias("ft_id_b"), "eval_split", "source", "agree", "jaccard")
        .dropDuplicates(["ft_id_a", "ft_id_b"])
    )


def overlap_report(pairs: DataFrame) -> DataFrame:
    """``eval_split, source, n_pairs``: confirmed pairs per evaluation split and source."""
    return pairs.groupBy("eval_split", "source").agg(F.count("*").alias("n_pairs"))
