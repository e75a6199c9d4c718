"""Leiden in rounds that all nodes take together.

A round finds the best community of half of the nodes, whoever holds them: the
links lie in a table with one row a node, read in Arrow batches, and only node
vectors (label, strength, size) and the moves travel between the driver and the
executors. No task holds a component's links. Aggregated graphs of at most
``LOCAL`` links go on in the driver's memory, by the same functions and with
the same result; the limit says where a round runs, not what it does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.order import with_position
from graphloom.session import forget, materialize

#: Links (both directions) that the driver may hold.
LOCAL = 500_000

#: Links that one step of numpy sees.
STEP = 1_000_000

_LEAST = 1e-12


@dataclass
class _State:
    """Vectors over the nodes of one graph: what a round needs to know."""

    strength: np.ndarray
    size: np.ndarray
    total: np.ndarray  # weight of the node's component
    label: np.ndarray
    sums: np.ndarray  # strength of each label
    counts: np.ndarray  # size of each label
    cap: float | None = None
    group: np.ndarray | None = None  # moves stay inside
    movers: np.ndarray | None = None
    takers: np.ndarray | None = None  # labels that may be joined
    moved: np.ndarray | None = None  # round of a node's last move, and of the last look at it
    seen: np.ndarray | None = None

    def sent(self) -> _State:
        return self if self.cap else replace(self, size=None, counts=None)


def _best(node: np.ndarray, ptr: np.ndarray, nbr: np.ndarray, w: np.ndarray, st: _State) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """``(node, target, gain)`` of the rows that gain by moving, and whether the size limit held any back."""
    deg = np.diff(ptr)
    go = st.movers[node] & (deg > 0)
    if st.moved is not None and len(nbr):
        some = deg > 0
        last = np.zeros(len(node), np.int32)
        last[some] = np.maximum.reduceat(st.moved[nbr], ptr[:-1][some])
        go &= last >= st.seen[node]
    keep = np.repeat(go, deg)
    nbr, w, node, deg = nbr[keep], w[keep], node[go], deg[go]
    row = np.repeat(np.arange(len(node)), deg)
    if st.group is not None:
        same = st.group[nbr] == st.group[node[row]]
        nbr, w, row = nbr[same], w[same], row[same]
    if not len(nbr):
        return node[:0], node[:0], np.zeros(0), False
    n = len(st.label)
    key = row * n + st.label[nbr]
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    link = np.add.reduceat(w[order], first)
    row, c = key[first] // n, key[first] % n
    s, twice, at = st.strength[node], 2 * st.total[node], st.label[node]
    own = c == at[row]
    stay = np.zeros(len(node))
    stay[row[own]] = link[own]
    stay -= s * (st.sums[at] - s) / twice
    gain = link - s[row] * st.sums[c] / twice[row] - stay[row]
    ok = ~own & (gain > _LEAST)
    if st.takers is not None:
        ok &= st.takers[c]
    blocked = False
    if st.cap:
        fits = st.counts[c] + st.size[node[row]] <= st.cap
        blocked = bool((ok & ~fits).any())
        ok &= fits
    row, c, gain = row[ok], c[ok], gain[ok]
    order = np.lexsort((c, -gain, row))
    row, c, gain = row[order], c[order], gain[order]
    first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    return node[row[first]], c[first], gain[first], blocked


def _merged(s: np.ndarray, d: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the same two nodes added up, loops left out, in order of the nodes."""
    keep = s != d
    key, at = np.unique(s[keep].astype(np.int64) * n + d[keep], return_inverse=True)
    return key // n, key % n, np.bincount(at, weights=w[keep], minlength=len(key))


class _Local:
    """Links in memory."""

    def __init__(self, s: np.ndarray, d: np.ndarray, w: np.ndarray, n: int):
        self.n, self.nbr, self.w = n, d.astype(np.int32), w
        self.ptr = np.r_[0, np.cumsum(np.bincount(s, minlength=n))].astype(np.int64)

    def best(self, st: _State) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        cuts = np.unique(np.searchsorted(self.ptr, np.arange(0, self.ptr[-1] + STEP, STEP)).clip(0, self.n))
        found = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = slice(self.ptr[a], self.ptr[b])
            found.append(_best(np.arange(a, b), self.ptr[a : b + 1] - self.ptr[a], self.nbr[at], self.w[at], st))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), False
        return *(np.concatenate([f[i] for f in found]) for i in range(3)), any(f[3] for f in found)

    def strength(self) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(self.n), np.diff(self.ptr)), weights=self.w, minlength=self.n)

    def components(self) -> np.ndarray:
        s, d = np.repeat(np.arange(self.n), np.diff(self.ptr)), self.nbr
        c = np.arange(self.n)
        while True:
            low = c.copy()
            np.minimum.at(low, s, c[d])
            low = np.minimum(low, low[low])
            if (low == c).all():
                return c
            c = low

    def merge(self, fine: np.ndarray, k: int) -> _Local:
        s = np.repeat(np.arange(self.n), np.diff(self.ptr))
        return _Local(*_merged(fine[s], fine[self.nbr], self.w, k), k)

    def drop(self) -> None:
        pass


def link_rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, where their links start, the links' ends and weights."""
    nbrs = b.column("nbrs")
    ptr = nbrs.offsets.to_numpy().astype(np.int64)
    return b.column("node").to_numpy(), ptr - ptr[0], nbrs.flatten().to_numpy(), b.column("ws").flatten().to_numpy()


class _Spread:
    """Links as a table ``(node, nbrs, ws)`` in the shared folder."""

    def __init__(self, links: DataFrame, n: int, parallel=F.sum):
        """``links(s, d, w)`` in both directions, loops left out."""
        spark = links.sparkSession
        self.n, self.spark = n, spark
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        one = links.repartition(parts, "s").groupBy("s", "d").agg(parallel("w").alias("w"))
        pairs = F.array_sort(F.collect_list(F.struct("d", "w")))
        rows = one.groupBy(F.col("s").alias("node")).agg(pairs.alias("p")).select("node", F.col("p.d").alias("nbrs"), F.col("p.w").alias("ws"))
        self.rows = materialize(rows, "leiden-rows")
        self.links = self.rows.agg(F.sum(F.size("nbrs"))).first()[0] or 0

    def _each(self, run, schema: str, **vectors) -> pa.Table:
        held = self.spark.sparkContext.broadcast(vectors)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield run(b, **held.value)

        try:
            return self.rows.mapInArrow(part, schema).toArrow()
        finally:
            held.destroy()

    def best(self, st: _State) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        def run(b: pa.RecordBatch, st: _State) -> pa.RecordBatch:
            node, target, gain, blocked = _best(*link_rows(b), st)
            node, target, gain = (np.r_[node, -1], np.r_[target, -1], np.r_[gain, 0.0]) if blocked else (node, target, gain)
            return pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(target.astype(np.int32)), pa.array(gain)], names=["node", "target", "gain"])

        t = self._each(run, "node int, target int, gain double", st=st.sent())
        node, target, gain = (t[c].to_numpy() for c in ("node", "target", "gain"))
        real = node >= 0
        return node[real], target[real], gain[real], not real.all()

    def strength(self) -> np.ndarray:
        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            node, ptr, _, w = link_rows(b)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.add.reduceat(w, ptr[:-1]))], names=["node", "w"])

        t = self._each(run, "node int, w double")
        return np.bincount(t["node"].to_numpy(), weights=t["w"].to_numpy(), minlength=self.n)

    def components(self) -> np.ndarray:
        """The smallest node of each one's component: rows send the smaller labels they see, the driver hooks roots and shortens paths."""

        def run(b: pa.RecordBatch, label: np.ndarray) -> pa.RecordBatch:
            node, ptr, nbr, _ = link_rows(b)
            low = np.minimum.reduceat(label[nbr], ptr[:-1])
            less = low < label[node]
            return pa.RecordBatch.from_arrays([pa.array(node[less]), pa.array(low[less])], names=["node", "low"])

        label = np.arange(self.n, dtype=np.int32)
        while True:
            t = self._each(run, "node int, low int", label=label)
            if not t.num_rows:
                return label
            node, low = t["node"].to_numpy(), t["low"].to_numpy()
            np.minimum.at(label, label[node], low)
            while (label[label] != label).any():
                label = label[label]

    def gather(self, values: np.ndarray, wanted: np.ndarray | None = None, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(node, column, sum)``: the columns of ``values`` added up over each node's links, where not 0 and ``wanted``."""

        def run(b: pa.RecordBatch, values: np.ndarray, wanted: np.ndarray | None) -> pa.RecordBatch:
            node, ptr, nbr, w = link_rows(b)
            out = []
            cuts = np.unique(np.searchsorted(ptr, np.arange(0, ptr[-1] + STEP // 5, STEP // 5)).clip(0, len(node)))
            for a, z in zip(cuts, cuts[1:], strict=False):
                at = slice(ptr[a], ptr[z])
                x = values[nbr[at]] * w[at, None] if weighted else values[nbr[at]]
                x = np.add.reduceat(x, ptr[a:z] - ptr[a])
                r, c = np.nonzero(x if wanted is None else np.where(wanted[node[a:z]], x, 0))
                out.append((node[a:z][r], c.astype(np.int16), x[r, c]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], names=["node", "c", "x"])

        t = self._each(run, "node int, c smallint, x double", values=values, wanted=wanted)
        return t["node"].to_numpy(), t["c"].to_numpy(), t["x"].to_numpy()

    def merge(self, fine: np.ndarray, k: int) -> _Local | _Spread:
        held = self.spark.sparkContext.broadcast(fine.astype(np.int32))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node, ptr, nbr, w = link_rows(b)
                s, d, w = _merged(held.value[np.repeat(node, np.diff(ptr))], held.value[nbr], w, k)
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(d.astype(np.int32)), pa.array(w)], names=["s", "d", "w"])

        out = _Spread(self.rows.mapInArrow(part, "s int, d int, w double"), k).settled()
        held.destroy()
        return out

    def settled(self) -> _Local | _Spread:
        """In memory where that is allowed."""
        if self.links > LOCAL:
            return self
        t = self.rows.select("node", F.explode(F.arrays_zip("nbrs", "ws")).alias("x")).select("node", "x.nbrs", "x.ws").toArrow()
        self.drop()
        s, d, w = (t[c].to_numpy() for c in ("node", "nbrs", "ws"))
        order = np.lexsort((d, s))
        return _Local(s[order], d[order], w[order], self.n)

    def drop(self) -> None:
        forget(self.rows)


def _bit(n: int, turn: int) -> np.ndarray:
    """Half of the nodes, another half for each turn (splitmix64)."""
    x = np.arange(n, dtype=np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & np.uint64(1) == 1


def _accept(node: np.ndarray, target: np.ndarray, gain: np.ndarray, st: _State) -> tuple[np.ndarray, np.ndarray, bool]:
    """The moves that still gain, and fit, after those into the same label that gain more."""
    order = np.lexsort((node, -gain, target))
    node, target, gain = node[order], target[order], gain[order]
    first = np.r_[True, target[1:] != target[:-1]] if len(target) else np.zeros(0, bool)

    def ahead(x: np.ndarray) -> np.ndarray:
        before = np.cumsum(x) - x
        return before - np.maximum.accumulate(np.where(first, before, 0))

    s = st.strength[node]
    ok, blocked = gain - s * ahead(s) / (2 * st.total[node]) > _LEAST, False
    if st.cap:
        fits = st.counts[target] + ahead(st.size[node]) + st.size[node] <= st.cap
        ok, blocked = ok & fits, bool((ok & ~fits).any())
    return node[ok], target[ok], blocked


def _apply(node: np.ndarray, target: np.ndarray, st: _State) -> None:
    n, old = len(st.label), st.label[node]
    for v, by in ((st.sums, st.strength), (st.counts, st.size)):
        v += np.bincount(target, weights=by[node], minlength=n) - np.bincount(old, weights=by[node], minlength=n)
    st.label[node] = target


def _move(graph, st: _State, sweeps: int = 30) -> tuple[int, bool]:
    """Local moves until a sweep of two rounds moves under one node in a thousand."""
    n, moves, blocked = len(st.label), 0, False
    st.moved, st.seen = np.zeros(n, np.int32), np.zeros(n, np.int32)
    for turn in range(2 * sweeps):
        half = _bit(n, turn // 2)
        st.movers = half if turn % 2 == 0 else ~half
        node, target, gain, held = graph.best(st)
        mine, to, late = _accept(node, target, gain, st)
        blocked |= held | late
        st.seen[st.movers] = turn + 1
        st.seen[np.setdiff1d(node, mine)] = 0  # those that were sent back are looked at again
        st.moved[mine] = turn + 1
        _apply(mine, to, st)
        now = len(mine) if turn % 2 == 0 else now + len(mine)
        moves += len(mine)
        if turn % 2 and now <= n // 1000:
            break
    return moves, blocked


def _refine(graph, st: _State, sweeps: int = 12) -> tuple[np.ndarray, bool]:
    """Within each community, nodes that are alone join a part that gains most by it.

    In a round half of the lone nodes may join and the others be joined: a part
    loses no node, so it stays connected.
    """
    n, blocked = len(st.label), False
    f = replace(st, label=np.arange(n), sums=st.strength.copy(), counts=st.size.copy(), group=st.label, moved=None, seen=None)
    alone = np.ones(n, bool)
    for turn in range(2 * sweeps):
        half = _bit(n, 1000 + turn // 2)
        half = half if turn % 2 == 0 else ~half
        f.movers, f.takers = alone & half, ~alone | ~half
        node, target, gain, held = graph.best(f)
        mine, to, late = _accept(node, target, gain, f)
        blocked |= held | late
        _apply(mine, to, f)
        alone[mine] = alone[to] = False
        now = len(mine) if turn % 2 == 0 else now + len(mine)
        if turn % 2 and turn >= 5 and now <= n // 1000:
            break
    return f.label, blocked


@dataclass
class Prepared:
    """A graph whose nodes are numbered in their order; ``ids(node, id)``."""

    ids: DataFrame
    links: _Local | _Spread
    strength: np.ndarray
    total: np.ndarray


def spread(edges: DataFrame, vertices: DataFrame, weighted: bool = True, parallel=F.sum) -> tuple[DataFrame, _Spread]:
    """``ids(node, id)`` and the links of edges both of whose ends are in ``vertices(node)``; loops have no part, ``parallel`` joins those of the same ends."""
    ids = materialize(with_position(vertices.select("node").distinct(), ["node"], "id").select("node", F.col("id").cast("int").alias("id")), "leiden-ids")
    ends = edges.where("src <> dst").select("src", "dst", F.col("weight").cast("double").alias("w") if weighted else F.lit(1.0).alias("w"))
    e = ends.join(ids.select(F.col("node").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("node").alias("dst"), F.col("id").alias("d")), "dst").select("s", "d", "w")
    e = materialize(e, "leiden-edges")
    both = e.select("s", "d", "w", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    s, d = F.when(F.col("back"), F.col("d")).otherwise(F.col("s")), F.when(F.col("back"), F.col("s")).otherwise(F.col("d"))
    links = _Spread(both.select(s.alias("s"), d.alias("d"), "w"), ids.count(), parallel)
    forget(e)
    return ids, links


def prepare(edges: DataFrame, vertices: DataFrame) -> Prepared:
    ids, links = spread(edges, vertices)
    links = links.settled()
    strength, part = links.strength(), links.components()
    return Prepared(ids, links, strength, (np.bincount(part, weights=strength, minlength=len(strength)) / 2)[part])


def partition(g: Prepared, max_size: int | None = None, rounds: int = 20) -> tuple[np.ndarray, bool]:
    """A label for each node by moves, refinement and aggregation, and whether ``max_size`` ever held a move back."""
    strength, total = g.strength, np.where(g.total > 0, g.total, 1.0)
    size, links, blocked = np.ones(len(strength)), g.links, False
    node_of, start = np.arange(len(strength)), np.arange(len(strength))
    found = node_of
    for level in range(rounds):
        n = len(strength)
        st = _State(strength, size, total, start.copy(), np.bincount(start, weights=strength, minlength=n), np.bincount(start, weights=size, minlength=n), max_size)
        moves, held = _move(links, st)
        blocked |= held
        found = st.label[node_of]
        if level and not moves or len(np.unique(st.label)) == n:
            break
        fine, held = _refine(links, st)
        blocked |= held
        _, fine = np.unique(fine, return_inverse=True)
        k = int(fine.max()) + 1
        if k == n:
            break
        start = np.zeros(k, int)
        start[fine] = st.label
        _, start = np.unique(start, return_inverse=True)
        coarse = links.merge(fine, k)
        if links is not g.links:
            links.drop()
        links, node_of = coarse, fine[node_of]
        strength, size = np.bincount(fine, weights=strength, minlength=k), np.bincount(fine, weights=size, minlength=k)
        of = np.zeros(k)
        of[fine] = total
        total = of
    if links is not g.links:
        links.drop()
    return found, blocked


def named(ids: DataFrame, values: np.ndarray, name: str = "name") -> DataFrame:
    """``(node, name)`` from a vector over the numbered nodes."""
    t = pa.table({"id": pa.array(np.arange(len(values), dtype=np.int32)), name: pa.array(values)})
    return ids.join(ids.sparkSession.createDataFrame(t), "id").select("node", name)
