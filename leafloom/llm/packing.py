"""Problem 8: texts into containers of fixed capacity with little unused space.

The sizes are rounded up to steps of ``grain`` tokens, so the histogram has at most capacity / grain classes however
many texts there are. On it the driver solves the configuration linear program: multiplicative weights keep a price
for each class, the knapsack dynamic program finds the filling of a container that is worth most at these prices, and
every round adds some of it. The fractional fillings are rounded down; what is left (few items for each filling) goes
through the same again and at last best-fit decreasing. The texts themselves stay distributed: their ranks within
their size class, from a global range sort, say which container and position they get.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.operators.ranking import rank_in_groups
from leafloom.session import cut_lineage

Filling = tuple[dict[int, int], int]


class Knapsack:
    """Unbounded knapsack over the classes for one set of prices: the best value and filling of every room."""

    def __init__(self, price: np.ndarray, sizes: np.ndarray, capacity: int):
        self.price, self.sizes, self.capacity = price, sizes, capacity
        self.value = np.zeros(capacity + 1)
        self.last = np.full(capacity + 1, -1)
        order = np.argsort(sizes, kind="stable")
        s, p = sizes[order], price[order]
        width, at = int(s[0]), int(s[0])
        while at <= capacity:  # rooms that differ by less than the smallest size don't depend on each other
            rooms = np.arange(at, min(at + width, capacity + 1))
            n = int(np.searchsorted(s, rooms[-1], side="right"))
            left = rooms[:, None] - s[None, :n]
            v = np.where(left >= 0, self.value[np.maximum(left, 0)] + p[:n], -np.inf)
            k = v.argmax(axis=1)
            self.value[rooms], self.last[rooms] = v[np.arange(len(rooms)), k], order[k]
            at += width

    def filling(self, room: int) -> dict[int, int]:
        """The multiset of classes (index to number) worth most within ``room``."""
        out: dict[int, int] = {}
        while (k := int(self.last[room])) >= 0:
            out[k] = out.get(k, 0) + 1
            room -= int(self.sizes[k])
        return out

    def good(self, slack: float, order: np.ndarray) -> Iterator[dict[int, int]]:
        """The best filling and, for each class in ``order``, one that is near as good and holds as many of it as it can."""
        yield self.filling(self.capacity)
        least = (1 - slack) * self.value[self.capacity]
        for i in order.tolist():
            size = int(self.sizes[i])
            copies = np.arange(self.capacity // size, 0, -1)
            near = np.flatnonzero(copies * self.price[i] + self.value[self.capacity - copies * size] >= least)
            if len(near):
                n = int(copies[near[0]])
                fill = self.filling(self.capacity - n * size)
                fill[i] = fill.get(i, 0) + n
                yield fill


class Solution:
    """Of the configuration program: the columns of each round with their amounts, and the best dual bound met."""

    def __init__(self, columns: list[list[tuple[tuple, float]]], bound: float):
        self.columns, self.bound = columns, bound

    def amounts(self, since: int, sizes: np.ndarray, counts: np.ndarray) -> dict[tuple, float]:
        """The columns from round ``since`` on, scaled to cover the items' total size once."""
        x: dict[tuple, float] = {}
        cover = np.zeros(len(counts))
        for key, amount in (c for taken in self.columns[since:] for c in taken):
            x[key] = x.get(key, 0.0) + amount
            for i, n in key:
                cover[i] += amount * n / counts[i]
        scale = float((cover * sizes * counts).sum() / (sizes * counts).sum())
        return {k: v / scale for k, v in x.items()}


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 0.05, rounds: int = 400, step: float = 0.1, slack: float = 0.02) -> Solution:
    """Fractional fillings that cover the ``counts``, by multiplicative weights.

    The weights start where a class is worth its size, so the first filling is a full container; a class loses worth by
    its cover so far and gains it by what others are ahead. A round takes the best filling and, for the classes covered
    least, fillings worth almost as much, and covers no more than half of a class. At any prices, what all items are
    worth over what one filling is worth at most is a lower bound of the number of containers. It ends when the later
    half of the rounds, scaled to the items' total size, and what it leaves uncovered, in containers half full, lie within
    ``gap`` of the best bound, or after ``rounds``.
    """
    cover, total, bound = np.zeros(len(sizes)), 0.0, 0.0
    columns: list[list[tuple[tuple, float]]] = []
    history = [(cover, total)]
    bulk = sizes * counts / float((sizes * counts).sum())
    while len(columns) < rounds:
        price = sizes * np.exp(-step * (cover - float((cover * bulk).sum())))
        best = Knapsack(price, sizes, capacity)
        bound = max(bound, float((price * counts).sum() / best.value[capacity]))
        now, taken = np.zeros(len(sizes)), []
        for fill in best.good(slack, np.argsort(cover, kind="stable")):
            key = tuple(sorted(fill.items()))
            idx, num = np.array(key).T
            amount = float(((0.5 - now[idx]) * counts[idx] / num).min())
            if amount > 0:
                now[idx] += amount * num / counts[idx]
                taken.append((key, amount))
                total += amount
        cover = cover + now
        columns.append(taken)
        history.append((cover, total))
        before, sum_before = history[len(columns) // 2]
        late = cover - before
        scale = float((late * bulk).sum())
        open_size = float((np.maximum(0, 1 - late / scale) * sizes * counts).sum())
        if (total - sum_before) / scale + 2 * open_size / capacity <= (1 + gap) * bound:
            break
    return Solution(columns, bound)


def best_fit(rest: dict[int, int], capacity: int) -> list[Filling]:
    """Best-fit decreasing of the items that rounding leaves: size to number."""
    rooms: list[tuple[int, int]] = []  # room and container, sorted
    held: list[dict[int, int]] = []
    for size in sorted(rest, reverse=True):
        for _ in range(rest[size]):
            at = bisect.bisect_left(rooms, (size, -1))
            if at == len(rooms):
                room, k = capacity, len(held)
                held.append({})
            else:
                room, k = rooms.pop(at)
            held[k][size] = held[k].get(size, 0) + 1
            bisect.insort(rooms, (room - size, k))
    return [(h, 1) for h in held]


def rounded(histogram: dict[int, int], capacity: int, sizes: np.ndarray, amounts: dict[tuple, float]) -> list[Filling]:
    """Fractional fillings rounded down and best-fit decreasing of the rest.

    The rest is less than one container for each column, whatever the number of items.
    """
    rest = dict(histogram)
    out: list[Filling] = []
    for key, v in sorted(amounts.items(), key=lambda kv: (-kv[1], kv[0])):
        fill = {int(sizes[i]): n for i, n in key}
        copies = min([int(v + 1e-9), *(rest[s] // n for s, n in fill.items())])
        if copies > 0:
            out.append((fill, copies))
            for s, n in fill.items():
                rest[s] -= copies * n
    return out + best_fit(rest, capacity)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Filling], float]:
    """Fillings (size to number, how many containers) that hold every item of the histogram once, and the dual bound.

    The better of two roundings of one solution: of all its rounds, which reach more classes, and of the later half,
    whose prices have settled. The same at every number of items.
    """
    rest = {s: n for s, n in histogram.items() if n > 0}
    if not rest:
        return [], 0.0
    sizes = np.array(sorted(rest))
    counts = np.array([rest[int(s)] for s in sizes], float)
    found = solve(sizes, counts, capacity)
    ways = [rounded(rest, capacity, sizes, found.amounts(since, sizes, counts)) for since in (0, len(found.columns) // 2)]
    return min(ways, key=lambda fillings: sum(copies for _, copies in fillings)), found.bound


def _pieces(texts: DataFrame, capacity: int) -> DataFrame:
    """Texts that alone exceed the capacity, cut at the last blank line, line end, sentence end or space that fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns)):
                at = no = 0
                while at < len(text):
                    part = text[at : at + capacity - 1].encode("utf-8", "replace")[: capacity - 1].decode("utf-8", "ignore")
                    if at + len(part) < len(text):
                        for mark in ("\n\n", "\n", ". ", "。", " "):
                            cut = part.rfind(mark, len(part) // 2)
                            if cut > 0:
                                part = part[: cut + len(mark)]
                                break
                    no += 1
                    rows.append((doc_id, no, at, len(part), len(part.encode("utf-8", "replace")) + 1))
                    at += len(part)
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()))],
                names=["doc_id", "piece_no", "piece_start", "piece_chars", "tokens"],
            )

    return texts.mapInArrow(run, "doc_id bigint, piece_no int, piece_start int, piece_chars int, tokens int")


def fill_containers(documents: DataFrame, capacity: int = 8192, grain: int = 16) -> DataFrame:
    """``doc_id, piece_no, piece_start, piece_chars, tokens, container_no, position``: one row per text or piece.

    The size of a text is one token per UTF-8 byte and one end token, whatever ``n_tokens`` says. A text up to
    ``capacity`` stays whole (piece 1); a longer one is cut into pieces of at most ``capacity`` tokens that join to it.
    Containers count from 1 and hold at most ``capacity`` tokens; positions count from 1. Empty texts have size 1;
    null ids and texts have no row; a repeated id counts once; extra columns are ignored.
    """
    if capacity < 4 * grain:
        raise ValueError("the capacity must be at least four grains")
    docs = documents.select("doc_id", "text").filter("doc_id is not null and text is not null")
    size = (F.octet_length("text") + 1).cast("int")
    whole = docs.filter(size <= capacity).select(
        "doc_id", F.lit(1).alias("piece_no"), F.lit(0).alias("piece_start"), F.length("text").alias("piece_chars"), size.alias("tokens")
    )
    items = whole.unionByName(_pieces(docs.filter(size > capacity), capacity)).dropDuplicates(["doc_id", "piece_no"])
    items = cut_lineage(items.withColumn("step", F.ceil(F.col("tokens") / grain).cast("int")))
    histogram = {r.step: r["count"] for r in items.groupBy("step").count().collect()}  # capacity / grain rows at most
    fillings, _ = plan(histogram, capacity // grain)
    starts: dict[int, int] = {}
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 1
    for fill, copies in fillings:
        before = 0
        for s in sorted(fill, reverse=True):
            first = starts.get(s, 0)
            table.setdefault(s, []).append((first, base, fill[s], before))
            starts[s] = first + copies * fill[s]
            before += fill[s]
        base += copies
    spark = documents.sparkSession
    segments = spark.createDataFrame(
        [(s, [{"first": a, "base": b, "per": n, "before": p} for a, b, n, p in segs]) for s, segs in sorted(table.items())],
        "step int, segs array<struct<first:bigint,base:bigint,per:bigint,before:bigint>>",
    )
    ranked = rank_in_groups(items, "step", [F.col("doc_id"), F.col("piece_no")])
    placed = ranked.join(F.broadcast(segments), "step").withColumn("seg", F.element_at(F.filter("segs", lambda x: x["first"] <= F.col("rank")), -1))
    within = F.col("rank") - F.col("seg.first")
    return placed.select(
        "doc_id", "piece_no", "piece_start", "piece_chars", "tokens",
        (F.col("seg.base") + F.floor(within / F.col("seg.per"))).alias("container_no"),
        (F.col("seg.before") + within % F.col("seg.per") + 1).cast("int").alias("position"),
    )


def fill_report(placed: DataFrame, capacity: int = 8192, grain: int = 16) -> DataFrame:
    """``containers, tokens, least_possible, lp_bound, fill``: how well the containers are used.

    ``least_possible`` is the sum of the sizes over the capacity; ``lp_bound`` is the dual bound of the configuration
    program, for sizes rounded up to the grain: no packing of these needs fewer containers.
    """
    steps = placed.groupBy(F.ceil(F.col("tokens") / grain).cast("int").alias("step")).count().collect()  # capacity / grain rows at most
    _, bound = plan({r.step: r["count"] for r in steps}, capacity // grain)
    return placed.agg(F.count_distinct("container_no").alias("containers"), F.sum("tokens").alias("tokens")).select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_possible"), F.lit(math.ceil(bound - 1e-6)).alias("lp_bound"),
        (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"),
    )
