"""Parent-child links to full hierarchies (problem 4).

Every node has at most one parent. Leaves are peeled to expose rings, 2^k layers in round k: the nodes that j peelings leave are the ancestors
at distance j of something, so doubling the parent pointers peels as many layers as all rounds before, and rows end as their chains do. With
the rings cut open, each tree gets an Euler tour (an arc down and an arc up for each link). The arcs are ranked by contraction: in each round
arcs that drew heads absorb successors that drew tails, a quarter of all, until what is left fits into one task; then the absorbed arcs get
their ranks back from their hosts, so rounds shrink and the work is linear. Entry and exit give depth and the number of descendants; a node's
ancestors are the intervals that its entry lies in. They are found in buckets of entries, into which an interval is carried that spans
the bucket's start: a bucket's rows are bounded however large its tree is, and the carried ones are no more than the ancestors that come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.materialize import Cut, cut
from strandline.operators.spread import IN_ONE_TASK, in_one_task, numbered

#: Entries of a tour that one bucket holds.
BUCKET = 1 << 16
#: Characters of paths that a Python worker passes on at once.
AT_ONCE = 1 << 22


def clean_links(df: DataFrame, relation: str, parent: str, children: str) -> DataFrame:
    """(relation, parent, child) of rows with an id and an array of ids: blanks around ids are cut off, NULL and empty ids dropped, each link once.

    A row without children gives (parent, NULL), so that its id counts as a node.
    """
    blank = r"(?U)^\s+|\s+$"
    kid = F.explode_outer(F.filter(F.transform(children, lambda x: F.regexp_replace(x, blank, "")), lambda x: x.isNotNull() & (x != "")))
    rows = df.select(F.lit(relation).alias("relation"), F.regexp_replace(parent, blank, "").alias("parent"), kid.alias("child"))
    return rows.where("parent IS NOT NULL AND parent <> ''").distinct()


def _numbered_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids of both arrays, and where each of a and of b stands among them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    return ids, at[: len(a)], at[len(a) :]


def _on_rings(v: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """The nodes on rings: what is left if pointers from v to p go on for ever."""
    ids, a, b = _numbered_ends(v, p)
    gone = len(ids)
    ahead = np.full(gone + 1, gone)
    ahead[a] = b
    for _ in range(gone.bit_length()):
        ahead = ahead[ahead]
    left = np.unique(ahead[a])
    return [ids[left[left < gone]]]


def _least_of_rings(v: np.ndarray, p: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    """(v, ring): the id of the node of least name on each node's ring."""
    after, name = dict(zip(v.tolist(), p.tolist())), dict(zip(v.tolist(), node.tolist()))
    ring: dict[int, int] = {}
    for x in after:
        if x not in ring:
            all_ = [x]
            while after[all_[-1]] != x:
                all_.append(after[all_[-1]])
            # code points have the order of their UTF-8 bytes
            ring |= dict.fromkeys(all_, min(all_, key=name.__getitem__))
    return [np.array(list(ring)), np.array(list(ring.values()))]


def _ranked(ahead: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The end of each list, and the weights from each element to its end, that of the end included. An end points to itself."""
    end = ahead == np.arange(len(ahead))
    sums = [np.where(end, 0, w) for w in weights]
    while ((far := ahead[ahead]) != ahead).any():
        sums = [s + s[ahead] for s in sums]
        ahead = far
    return ahead, [s + w[ahead] for s, w in zip(sums, weights)]


def _toured(v: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
    """(v, root, entry, exit, depth) of the nodes of the links, roots included."""
    order = np.lexsort((v, p))
    v, p = v[order], p[order]
    n, at = len(v), np.arange(len(v))
    ids, a, b = _numbered_ends(v, p)
    link, first = np.full(len(ids), -1), np.full(len(ids), -1)
    link[a] = at  # the link above a node
    first[b[::-1]] = at[::-1]  # the link to its first child
    # arcs: down the i-th link is i, up is n + i
    last = np.append(b[1:] != b[:-1], True)
    down = np.where(first[a] >= 0, first[a], n + at)
    up = np.where(~last, at + 1, np.where(link[b] >= 0, n + link[b], n + at))
    end, (left, sunk) = _ranked(np.concatenate([down, up]), np.ones(2 * n, np.int64), np.concatenate([np.ones(n, np.int64), np.full(n, -1)]))
    root = b[end[:n] - n]
    total = np.zeros(len(ids), np.int64)
    np.maximum.at(total, root, left[:n])
    tops = np.flatnonzero(link < 0)
    # what is left of the levels goes down to 0: an arc down with d of them left leads to depth 1 - d
    return [
        np.concatenate([v, ids[tops]]), np.concatenate([ids[root], ids[tops]]),
        np.concatenate([total[root] - left[:n] + 1, np.zeros(len(tops), np.int64)]), np.concatenate([total[root] - left[n:] + 1, total[tops] + 1]),
        np.concatenate([1 - sunk[:n], np.zeros(len(tops), np.int64)]),
    ]


def _arcs_ranked(arc: np.ndarray, after: np.ndarray, n: np.ndarray, d: np.ndarray, root: np.ndarray) -> list[np.ndarray]:
    """(arc, n, d, root) of arcs that have a successor, n and d counted to the end of the tour."""
    order = np.argsort(arc)
    arc, after, n, d, root = (x[order] for x in (arc, after, n, d, root))
    live = after >= 0
    end, (n, d) = _ranked(np.where(live, np.searchsorted(arc, after), np.arange(len(arc))), n, d)
    return [x[live] for x in (arc, n, d, root[end])]


class Forest:
    """The hierarchy of (relation, parent, child) links, in which a NULL child marks a node without links.

    If a node has several parents, which the input should not have, the smallest parent in binary order counts. ``nodes`` has
    (relation, node, nid). Links of different relations don't mix. Empty input gives empty results.
    """

    def __init__(self, links: DataFrame):
        links = cut(links, "links")
        both = links.select("relation", F.col("parent").alias("node")).unionByName(links.where("child IS NOT NULL").select("relation", F.col("child").alias("node")))
        self.nodes = cut(both.distinct().withColumn("nid", F.monotonically_increasing_id()), "nodes")
        one = links.where("child IS NOT NULL").groupBy("relation", "child").agg(F.min("parent").alias("parent"))
        child = self.nodes.select("relation", F.col("node").alias("child"), F.col("nid").alias("v"))
        parent = self.nodes.select("relation", F.col("node").alias("parent"), F.col("nid").alias("p"))
        table = Cut(one.join(child, ["relation", "child"]).join(parent, ["relation", "parent"]).select("v", "p"), "parents", "true")
        #: (v, p): each node with a parent, and the parent
        self.parents, self.n_links = table.df, table.counted
        self._peel()
        self._tour()

    def _peel(self) -> None:
        """ring: (v, ring) of nodes on rings, ring being the nid of the ring's smallest id; tree: the links without those into ring nodes."""
        jump = Cut(self.parents, "jump", "true") if self.n_links > IN_ONE_TASK else None
        # depths leave no gaps: once a round ends no chain, only what rings hold is left
        while jump and jump.counted > IN_ONE_TASK:
            new = self._doubled(jump)
            same = new.counted == jump.counted
            jump.drop()
            jump = new
            if same:
                break
        if jump and jump.counted > IN_ONE_TASK:
            # nor do heights above a node: once a round peels nothing, the nodes that are still reached are on rings
            left = jump.df.select("p").distinct().count()
            while True:
                new = self._doubled(jump)
                jump.drop()
                jump, before, left = new, left, new.df.select("p").distinct().count()
                if left == before:
                    break
            ends = jump.df.select(F.col("p").alias("v")).distinct()
        else:
            ends = in_one_task(jump.df if jump else self.parents, _on_rings, "v long", ["v"])
        on_ring = Cut(ends, "on-ring", "true")
        self.n_ring = on_ring.counted
        if not self.n_ring:
            self.ring, self.tree = None, self.parents
            return
        names = self.nodes.select(F.col("nid").alias("v"), "node")
        around = on_ring.df.join(self.parents, "v").join(names, "v").select("v", "p", "node")
        self.ring = cut(in_one_task(around, _least_of_rings, "v long, ring long", ["v", "ring"]) if self.n_ring <= IN_ONE_TASK else self._around(around), "rings")
        #: links of the trees: rings are cut open, their nodes are roots
        self.tree = cut(self.parents.join(on_ring.df, "v", "left_anti"), "tree")

    @staticmethod
    def _around(rings: DataFrame) -> DataFrame:
        """(v, ring): the smallest id of each ring, by doubling around it."""
        state = Cut(rings.select("v", "p", F.struct("node", F.col("v").alias("nid")).alias("least"), F.lit(True).alias("c")), "around", "c")
        while state.counted:
            other = state.df.select(F.col("v").alias("p"), F.col("p").alias("to"), F.col("least").alias("seen"))
            new = Cut(state.df.join(other, "p").select("v", F.col("to").alias("p"), F.least("least", "seen").alias("least"), (F.col("seen") < F.col("least")).alias("c")), "around", "c")
            state.drop()
            state = new
        return state.df.select("v", F.col("least.nid").alias("ring"))

    @staticmethod
    def _doubled(jump: Cut) -> Cut:
        """Pointers twice as far; those that lead beyond a root are gone."""
        ahead = jump.df.select(F.col("v").alias("p"), F.col("p").alias("to"))
        return Cut(jump.df.join(ahead, "p").select("v", F.col("to").alias("p")), "jump", "true")

    def _tour(self) -> None:
        """tour: (v, root, entry, exit, depth) of every node with a link. entry and exit count the arcs of the root's tour; depth counts from the root of the cut-open tree."""
        if self.n_links <= IN_ONE_TASK:
            columns = ["v", "root", "entry", "exit", "depth"]
            self.tour = cut(in_one_task(self.tree, _toured, ", ".join(f"{c} long" for c in columns), columns), "tour")
            return
        v = F.shiftright("arc", 1).alias("v")
        is_down = F.col("arc") % 2 == 0
        pair = self._ranks(self._arcs()).groupBy(v).agg(
            F.max("root").alias("root"), F.max(F.when(is_down, F.col("n"))).alias("entry_left"), F.max(F.when(~is_down, F.col("n"))).alias("exit_left"), F.max(F.when(is_down, F.col("d"))).alias("d")
        )
        # what is left of the levels goes down to 0: an arc down with d of them left leads to depth 1 - d
        inner = cut(pair.select("v", "root", "entry_left", "exit_left", (1 - F.col("d")).alias("depth")), "left")
        size = inner.groupBy("root").agg(F.max("entry_left").alias("total"))
        rows = inner.join(size, "root").select("v", "root", (F.col("total") - F.col("entry_left") + 1).alias("entry"), (F.col("total") - F.col("exit_left") + 1).alias("exit"), "depth")
        zero = F.lit(0).cast("bigint")
        roots = size.select(F.col("root").alias("v"), "root", zero.alias("entry"), (F.col("total") + 1).alias("exit"), zero.alias("depth"))
        self.tour = cut(rows.unionByName(roots), "tour")

    def _arcs(self) -> DataFrame:
        """(arc, next, n, d, root): the arcs of all tours, each with its successor. Down to v is 2 v, up from it 2 v + 1; the last arc of a tour has no successor but a root."""
        kids = numbered(self.tree, ["p"], [F.col("v").asc()], "i", {"prev": F.col("v")})
        ends = self.tree.groupBy("p").agg(F.min("v").alias("first"), F.max("v").alias("last"))
        inner = self.tree.select("v").join(ends, F.col("v") == F.col("p"), "full")
        down, up = (lambda c: F.col(c) * 2), (lambda c: F.col(c) * 2 + 1)
        nul = F.lit(None).cast("bigint")
        arc = lambda a, to, root=nul: F.struct(a.alias("arc"), to.alias("next"), root.alias("root"))
        within = F.when(F.col("p").isNull(), F.array(arc(down("v"), up("v")))).when(F.col("v").isNull(), F.array(arc(up("last"), nul, F.col("p"))))
        within = within.otherwise(F.array(arc(down("v"), down("first")), arc(up("last"), up("v"))))
        siblings = kids.where("prev IS NOT NULL").select(arc(up("prev"), down("v")).alias("a"))
        arcs = siblings.unionByName(inner.select(F.explode(within).alias("a"))).select("a.arc", "a.next", "a.root")
        one = F.lit(1).cast("bigint")
        return arcs.select("arc", "next", one.alias("n"), F.when(F.col("arc") % 2 == 0, one).otherwise(-one).alias("d"), "root")

    @staticmethod
    def _ranks(arcs: DataFrame) -> DataFrame:
        """(arc, n, d, root): how many arcs and levels there are from each arc to the end of its tour, both counted, and the tour's root."""
        nul = F.lit(None).cast("bigint")
        live = "NOT gone AND next IS NOT NULL"
        state, k = Cut(arcs.select("*", nul.alias("host"), F.lit(False).alias("gone")), "arcs", live), 0
        rounds = []
        cols = ["arc", "next", "n", "d", "root", "host", "gone"]
        while state.counted > IN_ONE_TASK:
            k += 1
            heads = lambda c, k=k: F.xxhash64(c, F.lit(k)).bitwiseAND(F.lit(1)) == 1
            rows = state.df.where("NOT gone")
            absorbs = F.col("next").isNotNull() & heads("arc") & ~heads("next")
            hosts = rows.where(absorbs).select(*(F.col(c).alias(f"h_{c}") for c in ("arc", "next", "n", "d")))
            met = rows.where(~heads("arc")).join(hosts, F.col("arc") == F.col("h_next"), "left")
            struct = lambda *c: F.struct(*(x.alias(name) for x, name in zip(c, cols)))
            c = F.col
            longer = struct(c("h_arc"), c("next"), c("h_n") + c("n"), c("h_d") + c("d"), c("root"), nul, F.lit(False))
            absorbed = struct(c("arc"), nul, c("h_n"), c("h_d"), nul, c("h_arc"), F.lit(True))
            same = struct(*(c(x) for x in cols))
            out = met.select(F.explode(F.when(c("h_arc").isNull(), F.array(same)).otherwise(F.array(longer, absorbed))).alias("r")).select("r.*")
            new = Cut(rows.where(heads("arc") & ~absorbs).select(*cols).unionByName(out), "arcs", live)
            if rounds:
                rounds[-1] = cut(state.df.where("gone").select("arc", "n", "d", "host"), "absorbed")
            state.drop()
            state = new
            rounds.append(state.df)
        left = state.df.where("NOT gone").select("arc", "next", "n", "d", "root")
        done, going = left.where("next IS NULL"), left.where("next IS NOT NULL")
        aims = done.join(going.select(F.col("next").alias("arc")).distinct(), "arc", "left_semi").select(*left.columns)
        found = in_one_task(going.unionByName(aims), _arcs_ranked, "arc long, n long, d long, root long", ["arc", "n", "d", "root"])
        ranks = Cut(done.select("arc", "n", "d", "root").unionByName(found), "ranks")
        for table in reversed(rounds):
            back = table.where("host IS NOT NULL").select("arc", F.col("n").alias("n0"), F.col("d").alias("d0"), "host")
            of = ranks.df.select(F.col("arc").alias("host"), "n", "d", "root")
            more = back.join(of, "host").select("arc", (F.col("n") - F.col("n0")).alias("n"), (F.col("d") - F.col("d0")).alias("d"), "root")
            new = Cut(ranks.df.unionByName(more), "ranks")
            ranks.drop()
            ranks = new
        return ranks.df

    def _intervals(self) -> DataFrame:
        """(relation, node, v, root, entry, exit, depth, title, reach) of every node. title is the smallest id of the ring at or above it, reach what a node of that ring reaches; both are NULL without a ring."""
        own = self.tour.withColumnRenamed("v", "nid")
        rows = self.nodes.join(own, "nid", "left")
        zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
        rows = rows.select("relation", "node", F.col("nid").alias("v"), F.coalesce("root", "nid").alias("root"), F.coalesce("entry", zero).alias("entry"), F.coalesce("exit", one).alias("exit"), F.coalesce("depth", zero).alias("depth"))
        if self.ring is None:
            return rows.withColumn("title", F.lit(None).cast("string")).withColumn("reach", F.lit(None).cast("bigint"))
        # a node on a ring reaches all trees that hang on the ring
        size = self.ring.join(self.tour.select("v", "entry", "exit"), "v", "left").select("ring", F.coalesce((F.col("exit") - F.col("entry") + 1) / 2, one).cast("bigint").alias("size"))
        reach = size.groupBy("ring").agg((F.sum("size") - 1).alias("reach"))
        title = self.nodes.select(F.col("nid").alias("ring"), F.col("node").alias("title"))
        tops = self.ring.join(reach, "ring").join(title, "ring").select(F.col("v").alias("root"), "title", "reach")
        return rows.join(tops, "root", "left").select("relation", "node", "v", "root", "entry", "exit", "depth", "title", "reach")

    @staticmethod
    def _nested(rows: DataFrame, carry: Column, columns: list[str], emit: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
        """What emit makes of each node, in the order of entries, given the names of its ancestors from the root on.

        Rows for which carry holds are carried into all buckets whose start they span, so that each bucket knows the intervals that are open there.
        """
        first, last = F.floor(F.col("entry") / BUCKET), F.floor((F.col("exit") - 1) / BUCKET)
        spread = rows.select("*", F.explode(F.sequence(first, F.when(carry, last).otherwise(first))).alias("bucket")).withColumn("own", F.col("bucket") == first)
        used = ["root", "bucket", "own", "entry", "exit", "node", *columns]
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, open_, ends = None, [], []  # the names of the open intervals, and where they end
            out, size = [], 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

            types = [{"string": pa.string(), "long": pa.int64()}[c.split()[1]] for c in schema.split(", ")]
            for b in batches:
                for root, bucket, own, entry, exit_, node, *more in zip(*(c.to_pylist() for c in b.columns)):
                    if at != (root, bucket):
                        at, open_, ends = (root, bucket), [], []
                    while ends and ends[-1] < entry:
                        ends.pop()
                        open_.pop()
                    if own:
                        for row in emit(open_, node, root, entry, exit_, *more):
                            out.append(row)
                            size += 64 + sum(len(x) for x in row if isinstance(x, str))
                            if size > AT_ONCE:
                                yield flush()
                                out, size = [], 0
                    open_.append(node)
                    ends.append(exit_)
            if out:
                yield flush()

        return spread.select(*used).repartition("root", "bucket").sortWithinPartitions("root", "bucket", "entry").mapInArrow(run, schema)

    def table(self) -> DataFrame:
        """(relation, node, root, depth, path, n_below) of every node.

        On a ring: root is the ring's smallest id, depth -1, path ''; below one: the same root, depth -2, path ''. n_below counts the nodes
        that can be reached, without the node itself.
        """

        def emit(above: list[str], node: str, root: int, entry: int, exit_: int, v: int, relation: str, depth: int, title: str | None, reach: int | None) -> Iterator[tuple]:
            below = (exit_ - entry - 1) // 2
            if title is None:
                yield relation, node, above[0] if above else node, depth, " > ".join([*above, node]), below
            elif v == root:
                yield relation, node, title, -1, "", reach
            else:
                yield relation, node, title, -2, "", below

        schema = "relation string, node string, root string, depth long, path string, n_below long"
        return self._nested(self._intervals(), F.col("title").isNull(), ["v", "relation", "depth", "title", "reach"], emit, schema)

    def descendants(self) -> DataFrame:
        """(relation, ancestor, node, distance): every node of every tree below each of its ancestors in it; rings are cut open.

        The result has as many rows as the depths of all nodes add up to.
        """

        def emit(above: list[str], node: str, root: int, entry: int, exit_: int, relation: str) -> Iterator[tuple]:
            for i, a in enumerate(above):
                yield relation, a, node, len(above) - i

        return self._nested(self._intervals(), F.lit(True), ["relation"], emit, "relation string, ancestor string, node string, distance long")
