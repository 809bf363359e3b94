"""Graph algorithms as rounds of joins: components, levels, trimming to cycles, and the cycles themselves in each connected part of what is left."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.materialize import Cut, cut
from strandline.operators.spread import IN_ONE_TASK, in_one_task


#: Layers that are peeled between two tables that are written.
LAYERS = 3


def components(nodes: DataFrame, links: DataFrame, node: str = "node") -> DataFrame:
    """(node, component): the least node that can be reached over the (a, b) links, taken in both directions.

    Least labels spread along links and along labels (pointer jumping), so rounds grow with the logarithm of the diameter on chains. Isolated
    nodes are their own component; links to unknown nodes are ignored; NULL nodes are dropped. Few links are finished by one task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    found = Cut(both, "links", "true")
    both, start = found.df, nodes.select(F.col(node).alias("v")).where("v IS NOT NULL").distinct()
    if found.counted <= IN_ONE_TASK:
        kind = links.schema["a"].dataType.simpleString()
        known = start.withColumnRenamed("v", "a")
        both = both.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
        labels = in_one_task(both, _least_labels, f"v {kind}, c {kind}", ["v", "c"])
        return start.join(labels, "v", "left").select(F.col("v").alias(node), F.coalesce("c", "v").alias("component"))
    state = Cut(start.select("v", F.col("v").alias("c"), F.lit(True).alias("moved")), "labels", "moved")
    while state.counted:
        near = state.df.select(F.col("v").alias("a"), F.col("c").alias("nc")).join(both, "a").groupBy("b").agg(F.min("nc").alias("nc"))
        hooked = state.df.join(near, F.col("v") == F.col("b"), "left").select("v", "c", F.coalesce(F.least("c", "nc"), "c").alias("l"))
        # what a label's own node is labelled with is a better label still
        jump = hooked.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        new = hooked.join(jump, "l").select("v", F.least("l", "ll").alias("c"), (F.least("l", "ll") < F.col("c")).alias("moved"))
        new = Cut(new, "labels", "moved")
        state.drop()
        state = new
    return state.df.select(F.col("v").alias(node), F.col("c").alias("component"))


def _least_labels(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """(v, c): the least node of each node's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        # the least label goes to both ends and to the node that stands for the label so far
        least = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)
        new = new[new]
        if (new == label).all():
            return [ids, ids[label]]
        label = new


def _trimmed(both_ends: bool) -> Callable[..., list[np.ndarray]]:
    def f(source: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        """The links whose target has a way on for ever (and, with both ends, whose source is reached for ever)."""
        ids, at = np.unique(np.concatenate([source, target]), return_inverse=True)
        a, b = at[: len(source)], at[len(source) :]
        keep = np.ones(len(a), bool)
        for ahead, behind in ((a, b), (b, a))[: 2 if both_ends else 1]:
            # nodes from which nothing leads on go, one after the other
            left = np.bincount(ahead[keep], minlength=len(ids))
            order = np.argsort(behind, kind="stable")
            first = np.searchsorted(behind[order], np.arange(len(ids) + 1))
            todo = np.flatnonzero(left == 0).tolist()
            while todo:
                v = todo.pop()
                for i in order[first[v] : first[v + 1]]:
                    if keep[i]:
                        keep[i] = False
                        left[ahead[i]] -= 1
                        if not left[ahead[i]]:
                            todo.append(ahead[i])
        return [source[keep], target[keep]]

    return f


def _topological(parent: np.ndarray, child: np.ndarray) -> list[np.ndarray]:
    """(v, level) of the ends of links."""
    ids, at = np.unique(np.concatenate([parent, child]), return_inverse=True)
    a, b = at[: len(parent)], at[len(parent) :]
    order = np.argsort(a, kind="stable")
    first = np.searchsorted(a[order], np.arange(len(ids) + 1))
    missing = np.bincount(b, minlength=len(ids))
    level = np.where(missing == 0, 0, -1)
    todo = np.flatnonzero(missing == 0)
    while len(todo):
        # all links out of one layer at once
        n = first[todo + 1] - first[todo]
        out = order[np.repeat(first[todo] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
        reached, times = np.unique(b[out], return_counts=True)
        missing[reached] -= times
        depth = level[todo[0]] + 1
        todo = reached[missing[reached] == 0]
        level[todo] = depth
    return [ids, level.astype(np.int32)]


def levels(nodes: DataFrame, links: DataFrame, node: str = "node") -> DataFrame:
    """(node, level): 0 without a parent, else one more than the highest parent's; -1 for nodes on or behind a cycle. links: (parent, child), repeats count once, those to unknown nodes not.

    Chains of nodes with one parent are contracted by pointer doubling, so rounds grow with the logarithm of their length; only nodes with
    several parents are resolved layer by layer. Few links are finished by one task.
    """
    known = nodes.select(F.col(node).alias("v")).where("v IS NOT NULL").distinct()
    for end in ("parent", "child"):
        links = links.join(known.withColumnRenamed("v", end), end, "left_semi")
    found = Cut(links.select("parent", "child").distinct(), "links", "true")
    links = found.df
    if found.counted <= IN_ONE_TASK:
        kind = links.schema["parent"].dataType.simpleString()
        levels_ = in_one_task(links, _topological, f"v {kind}, level int", ["v", "level"])
        return known.join(levels_, "v", "left").select(F.col("v").alias(node), F.coalesce("level", F.lit(0)).alias("level"))
    parents = links.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("p")).withColumnRenamed("child", "v")
    every = known.join(parents, "v", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # each node's anchor r: itself, or the nearest ancestor that has no parent or several; d links away
    start = every.select("v", "n", F.when(F.col("n") == 1, F.col("p")).otherwise(F.col("v")).alias("r"), F.when(F.col("n") == 1, 1).otherwise(0).alias("d"))
    anchors = start.select(F.col("v").alias("r"), (F.col("n") == 1).alias("live"))
    state = Cut(start.join(anchors, "r").select("v", "n", "r", "d", (F.col("live") & (F.col("n") == 1)).alias("live")), "anchors", "live")
    while state.counted:
        ahead = state.df.select(F.col("v").alias("r"), F.col("r").alias("rr"), F.col("d").alias("dd"), F.col("live").alias("ll"))
        moved = state.df.where("live").join(ahead, "r").select("v", "n", F.col("rr").alias("r"), (F.col("d") + F.col("dd")).alias("d"), F.col("ll").alias("live"))
        new = Cut(state.df.where("NOT live").unionByName(moved), "anchors", "live")
        same = new.counted == state.counted
        state.drop()
        state = new
        if same:  # no chain ended, so what is left runs in rings
            break
    # nodes with several parents wait for the anchors of all of them; a round looks only at the anchors that the one before made known
    at = state.df.select(F.col("v").alias("parent"), F.when(~F.col("live"), F.col("r")).alias("r"), F.col("d").alias("d"))
    unknown = F.lit(None).cast("int").alias("level")
    waiting = links.join(every.where("n > 1").select(F.col("v").alias("child")), "child").join(at, "parent").select(F.col("child").alias("m"), "r", (F.col("d") + 1).alias("w"), unknown)
    known = [cut(state.df.where("n = 0").select(F.col("v").alias("r"), F.lit(0).alias("level")), "known")]
    old = None
    while True:
        came = known[-1].withColumnRenamed("level", "new")
        filled = Cut(waiting.join(came, "r", "left").select("m", "r", "w", F.coalesce("level", F.col("new") + F.col("w")).alias("level")), "waiting", "true")
        if old:
            old.drop()
        if not filled.counted:
            break
        reached = filled.df.groupBy("m").agg(F.count("*").alias("n"), F.count("level").alias("k"), F.max("level").alias("level"))
        new = Cut(reached.where("n = k").select(F.col("m").alias("r"), "level"), "known", "true")
        if not new.counted:
            break
        known.append(new.df)
        old = filled
        waiting = filled.df.join(new.df.select(F.col("r").alias("m")), "m", "left_anti")
    so_far = known[0]
    for k in known[1:]:
        so_far = so_far.unionByName(k)
    out = state.df.withColumn("r", F.when(~F.col("live"), F.col("r"))).join(so_far, "r", "left")
    return out.select(F.col("v").alias(node), F.coalesce(F.col("level") + F.col("d"), F.lit(-1)).alias("level"))


def trim(links: DataFrame, both_ends: bool = False) -> DataFrame:
    """The (source, target) links whose target reaches a cycle; with both_ends also only such that a cycle reaches. What can't is dropped layer by layer; few links are finished by one task."""
    state = Cut(links.select("source", "target").distinct(), "trim", "true")
    if state.counted <= IN_ONE_TASK:
        kind = links.schema["source"].dataType.simpleString()
        return cut(in_one_task(state.df, _trimmed(both_ends), f"source {kind}, target {kind}", ["source", "target"]), "trimmed")
    while state.counted:
        left = state.df
        for _ in range(LAYERS):
            onward = left.select(F.col("source").alias("target")).distinct()
            after = left.join(onward, "target", "left_semi")
            if both_ends:
                after = after.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
            left = after.select("source", "target")
        new = Cut(left, "trim", "true")
        same = new.counted == state.counted
        state.drop()
        state = new
        if same:
            break
    return state.df


def cyclic_core(links: DataFrame) -> DataFrame:
    """(node): the nodes between which all links that lead from and to cycles run; the same wherever one starts."""
    core = trim(links, both_ends=True)
    return core.select(F.col("source").alias("node")).union(core.select("target")).distinct()


def canonical_cycle(cycle: list[str]) -> tuple[str, ...]:
    """The least of all rotations of the cycle and of its reversal."""
    if not cycle:
        return ()
    least = min(cycle)
    out = []
    for way in (cycle, cycle[::-1]):
        out += [tuple(way[i:] + way[:i]) for i, v in enumerate(way) if v == least]
    return min(out)


def _closed(links: Iterable[tuple[str, str]]) -> Iterator[tuple[str, tuple[str, ...]]]:
    """(start, canonical cycle) of each back edge of a depth-first search; nodes in order, neighbours in the order of the links. Different links give different cycles: a path of the tree and its last link."""
    after: dict[str, list[str]] = {}
    nodes = set()
    for a, b in links:
        after.setdefault(a, []).append(b)
        nodes |= {a, b}
    done: set[str] = set()
    for start in sorted(nodes):
        if start in done:
            continue
        path, at, todo = [start], {start: 0}, [iter(after.get(start, ()))]
        while todo:
            step = next(todo[-1], None)
            if step is None:
                todo.pop()
                last = path.pop()
                del at[last]
                done.add(last)
            elif step in at:
                yield start, canonical_cycle(path[at[step] :])
            elif step not in done:
                at[step] = len(path)
                path.append(step)
                todo.append(iter(after.get(step, ())))


def back_edge_cycles(links: list[tuple[str, str]]) -> list[tuple[str, ...]]:
    """The cycles that back edges of a depth-first search close, each canonical cycle once."""
    return list(dict.fromkeys(c for _, c in _closed(links)))


#: Cycles and links that a Python worker passes on at once.
CYCLES_AT_ONCE, LINKS_AT_ONCE = 64, 10_000


def found_cycles(edges: DataFrame, by: list[str], order: str = "edge_ord") -> DataFrame:
    """(by, start, i, cycle): the cycles that back edges of a depth-first search of each graph close, in the order (start, i) in which it finds them.

    Dead ends are trimmed and the rest is split into its connected parts, which a search never leaves; each is searched by itself, as a whole,
    by one task. What leads to a cycle stays: it decides where the search enters, and so which cycles it finds.
    """
    links = edges.where("source IS NOT NULL AND target IS NOT NULL").groupBy(*by, "source", "target").agg(F.min(order).alias("o"))
    ends = links.select(*by, F.explode(F.array("source", "target")).alias("node")).distinct()
    # rounds run over numbers, which are short
    ids = cut(ends.withColumn("id", F.monotonically_increasing_id()), "ids")
    for end, name in (("source", "a"), ("target", "b")):
        of = ids.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("node").alias("_node"), F.col("id").alias(name))
        on = F.col(end) == F.col("_node")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        links = links.join(of, on).drop("_node", *(f"_{c}" for c in by))
    links = cut(links, "links")
    left = trim(links.select(F.col("a").alias("source"), F.col("b").alias("target"))).select(F.col("source").alias("a"), F.col("target").alias("b"))
    part = components(left.select(F.col("a").alias("node")).union(left.select("b")), left)
    rows = left.join(part.select(F.col("node").alias("a"), "component"), "a").join(links, ["a", "b"]).select("component", "o", *by, "source", "target")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [*by, "start", "i", "cycle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for k in range(0, b.num_rows, LINKS_AT_ONCE) for r in zip(*(b.column(c).slice(k, LINKS_AT_ONCE).to_pylist() for c in ("component", "source", "target", *by))))
        for _, group in itertools.groupby(each, lambda r: r[0]):
            first = next(group)
            found = _closed((r[1], r[2]) for r in itertools.chain([first], group))
            out = ([*first[3:], start, i, list(c)] for i, (start, c) in enumerate(found))
            while some := list(itertools.islice(out, CYCLES_AT_ONCE)):
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in some], schema=arrow)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "start string, i long, cycle array<string>"])
    arrow = to_arrow_schema(edges.select(*by, F.lit("").alias("start"), F.lit(0).cast("long").alias("i"), F.array(F.lit("")).alias("cycle")).schema)
    return rows.repartition("component").sortWithinPartitions("component", "o", "source", "target").mapInArrow(run, schema)


def cycles(edges: DataFrame, order: str = "edge_ord") -> list[tuple[str, ...]]:
    """The cycles of a graph, as found_cycles gives them, on the driver."""
    return [tuple(r.cycle) for r in found_cycles(edges, [], order).orderBy("start", "i").collect()]
