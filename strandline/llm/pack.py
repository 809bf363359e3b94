"""Filling containers of fixed capacity (problem 7).

Sizes are whole numbers up to the capacity, so the sizes of all items are a histogram of at most ``capacity`` counts however many items
there are. The histogram is packed on the driver by best fit in decreasing order, whole groups of equal containers at a time. When no open
container has room, the permitted size is opened that costs least for each unit that the items still to come can fill of it; at last every
container is downsized to the least permitted capacity that holds its contents. Items then find their container by their number among the
items of their size. All data stay distributed; what is broadcast grows with the capacity, not with the data.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.materialize import cut
from strandline.operators.spread import numbered

#: The largest capacity: a bound of the histogram and so of what the driver holds.
LARGEST_CAPACITY = 1 << 20


@dataclass
class Group:
    """``n`` equal containers: contents are (size, how many) pairs."""

    n: int
    contents: tuple[tuple[int, int], ...]
    capacity: int

    @property
    def used(self) -> int:
        return sum(s * k for s, k in self.contents)


def best_fit(histogram: dict[int, int], opened: Callable[[int, int], tuple[int, int]]) -> list[Group]:
    """Best fit in decreasing order of size. histogram: size to count.

    opened: for a size and how many of it find no room, the capacity that is opened and in how many containers at most before it is asked again.
    """
    room: dict[int, list[Group]] = {}
    free: list[int] = []  # the rooms that exist, in order
    done: list[Group] = []

    def put(g: Group) -> None:
        left = g.capacity - g.used
        if left <= 0:
            done.append(g)
        elif left in room:
            room[left].append(g)
        else:
            room[left] = [g]
            insort(free, left)

    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            at = bisect_left(free, size)
            if at == len(free):
                cap, most = opened(size, n)
                each = cap // size
                full = min(n // each, most)
                rest = n - full * each if full < most else 0
                if full:
                    put(Group(full, ((size, each),), cap))
                if 0 < rest < each:
                    put(Group(1, ((size, rest),), cap))
                    n -= rest
                n -= full * each
                continue
            left = free[at]
            g = room[left].pop()
            if not room[left]:
                del room[left]
                free.pop(at)
            each = left // size
            full = min(g.n, n // each)
            rest = n - full * each if full < g.n else 0
            part = min(rest, each) if full < g.n else 0
            if full:
                put(Group(full, (*g.contents, (size, each)), g.capacity))
            if part:
                put(Group(1, (*g.contents, (size, part)), g.capacity))
            unused = g.n - full - (1 if part else 0)
            if unused:
                put(Group(unused, g.contents, g.capacity))
            n -= full * each + part
    return done + [g for left in free for g in room[left]]


class _Cheapest:
    """Chooses what is opened: the capacity of the least cost for each unit that the items to come fill of it, largest items first."""

    def __init__(self, histogram: dict[int, int], cost: dict[int, float]):
        self.left, self.cost = dict(histogram), cost
        self.sizes = sorted(histogram)

    def _filled(self, size: int, n: int, cap: int) -> tuple[int, list[tuple[int, int]]]:
        """How much of a container is filled that begins with size, of which n are left, and by what."""
        room, at = cap, bisect_right(self.sizes, size) - 1
        content = []
        while room and at >= 0:
            s = self.sizes[at]
            if s <= room and (k := min(room // s, n if s == size else self.left[s])) > 0:
                content.append((s, k))
                room -= s * k
            at = min(at, bisect_right(self.sizes, room)) - 1
        return cap - room, content

    def __call__(self, size: int, n: int) -> tuple[int, int]:
        # larger sizes are all placed; what is left of this one is known
        self.left[size] = n
        options = [(self.cost[cap] / used, -used, cap, content) for cap in self.cost if cap >= size for used, content in [self._filled(size, n, cap)]]
        _, _, cap, content = min(options, key=lambda o: o[:3])
        times = max(1, min(self.left[s] // k for s, k in content))
        for s, k in content:
            self.left[s] = max(0, self.left[s] - k * times)
        return cap, times


def plan(histogram: dict[int, int], capacities: list[int], costs: list[float] | None = None) -> list[Group]:
    """A packing in containers of the permitted capacities, opened as they pay and downsized at last; each in the cheapest capacity that holds it.

    A capacity costs its own size unless costs says otherwise. Where always opening one and the same capacity turns out cheaper, that is taken.
    """
    capacities = sorted(capacities)
    cost = dict(zip(capacities, costs or capacities))
    fitting = lambda used: min((c for c in capacities if c >= used), key=lambda c: (cost[c], c))
    always = lambda cap: lambda size, n: (cap if size <= cap else fitting(size), 1 << 62)
    best: tuple[float, list[Group]] | None = None
    for opened in [*([_Cheapest(histogram, cost)] if len(capacities) > 1 else []), *map(always, capacities)]:
        groups = best_fit(histogram, opened)
        for g in groups:
            g.capacity = fitting(g.used)
        total = sum(g.n * cost[g.capacity] for g in groups)
        if best is None or total < best[0]:
            best = (total, groups)
    return best[1] if best else []


def pack(items: DataFrame, limits: list[tuple[int, list[int]]], id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(limit_id, container, capacity, id, piece, start, size): where every item goes, for each (limit_id, permitted capacities).

    No container is overfull. An item larger than the largest permitted capacity is cut into full pieces of that capacity and a rest, with
    ``piece`` from 1 and ``start`` from 0; no other item is cut. Items of size 0 or NULL are left out. Containers count from 0 within a limit.
    No items give an empty table.
    """
    for _, caps in limits:
        if not caps or min(caps) < 1 or max(caps) > LARGEST_CAPACITY:
            raise ValueError(f"capacities must be between 1 and {LARGEST_CAPACITY}")
    sizes = cut(items.select(F.col(id_col).alias("id"), F.col(size_col).cast("bigint").alias("n")).where("n > 0"), "sizes")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("limit_id"), F.lit(max(c)).cast("bigint").alias("cap")) for i, c in limits)))
    pieces = sizes.select("id", "n", each.alias("l")).select(
        "l.limit_id", "id", "n", "l.cap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / F.col("l.cap")))).alias("k")
    )
    start = F.col("k") * F.col("cap")
    pieces = pieces.select("limit_id", "id", (F.col("k") + 1).alias("piece"), start.alias("start"), F.least(F.col("n") - start, "cap").alias("size"))
    histograms: dict[int, dict[int, int]] = {}
    for r in pieces.groupBy("limit_id", "size").agg(F.count("*").alias("n")).collect():  # at most as many rows as capacities add up to
        histograms.setdefault(r.limit_id, {})[r["size"]] = r.n
    lookup = _Lookup({i: plan(histograms[i], caps) for i, caps in limits if i in histograms}, [i for i, _ in limits])
    # the number of an item among those of its size, which may be any share of all
    placed = numbered(pieces, ["limit_id", "size"], [F.col("id").asc(), F.col("piece").asc()], "i")
    placed = placed.select("limit_id", "id", "piece", "start", "size", (F.col("i") - 1).alias("i"))
    fields = {f.name: f for f in placed.schema.fields}
    schema = T.StructType([fields["limit_id"], T.StructField("container", T.LongType()), T.StructField("capacity", T.LongType()), fields["id"], fields["piece"], fields["start"], fields["size"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            container, capacity = lookup.find(*(col[c].to_numpy(zero_copy_only=False) for c in ("limit_id", "size", "i")))
            yield pa.RecordBatch.from_arrays([col["limit_id"], pa.array(container), pa.array(capacity), col["id"], col["piece"], col["start"], col["size"]], schema.names)

    return placed.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "size": size_col})


class _Lookup:
    """Finds the container of the i-th item of a size: ranges of items, sorted by limit, size and first item."""

    def __init__(self, plans: dict[int, list[Group]], limits: list[int]):
        self.limits = np.array(sorted(limits), np.int64)
        rows = []
        for limit, groups in plans.items():
            used: dict[int, int] = {}
            base = 0
            at = int(np.searchsorted(self.limits, limit))
            for g in groups:
                for size, each in g.contents:
                    first = used.get(size, 0)
                    rows.append((at, size, first, base, each, g.capacity))
                    used[size] = first + g.n * each
                base += g.n
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 6)
        self.at, self.size, self.first, self.base, self.each, self.capacity = table.T
        # sizes are below 2^21 and limits few, so one number orders limit and size; ranges of it are searched by first item
        self.key = (self.at << 21) | self.size
        self.keys, self.begin = np.unique(self.key, return_index=True)
        self.end = np.append(self.begin[1:], len(self.key))

    def find(self, limit: np.ndarray, size: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (np.searchsorted(self.limits, limit) << 21) | size
        k = np.searchsorted(self.keys, key)
        lo, hi = self.begin[k].copy(), self.end[k].copy()
        while (hi - lo > 1).any():  # binary search in all rows' ranges at once
            mid = (lo + hi) // 2
            go = (self.first[np.minimum(mid, len(self.first) - 1)] <= i) & (hi - lo > 1)
            lo, hi = np.where(go, mid, lo), np.where(go | (hi - lo <= 1), hi, mid)
        return self.base[lo] + (i - self.first[lo]) // self.each[lo], self.capacity[lo]
