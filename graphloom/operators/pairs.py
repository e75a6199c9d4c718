"""Similarity of all pairs of a group: square cells of two blocks of vectors, one matrix product each.

A task holds two blocks of ``BLOCK`` vectors and ``ROWS`` rows of their
products at a time, however large a group is; results leave in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.operators.order import with_position
from graphloom.session import materialize

BLOCK, ROWS = 2048, 256

#: The bits of a squared distance that the first pass of the median leaves open.
_LOW = 42


def cells(vectors_: DataFrame, key: str, group: str) -> DataFrame:
    """``(i, j, b, grp, id, vector)``: each vector in the cells ``i <= j`` of its block ``b`` and the blocks of its group."""
    v = vectors_.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("grp"), F.col(key).alias("id"), "vector")
    v = materialize(with_position(v, ["grp", "id"], "b").withColumn("b", F.floor(F.col("b") / BLOCK).cast("int")), "pair-blocks")
    held = v.groupBy("grp").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    span = F.col("hi") - F.col("lo") + 1
    n = int(held.agg(F.sum(span * (span + 1) / 2)).first()[0] or 1)
    out = v.join(held, "grp").select("b", "grp", "id", "vector", F.explode(F.sequence("lo", "hi")).alias("o"))
    return out.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "grp", "id", "vector").repartition(min(max(n, vectors_.sparkSession.sparkContext.defaultParallelism), 4000), "i", "j")


class _Part:
    """Pairs ``a < b`` of a group: rows ``r`` and ``c`` of the cell, dot products, squared distances and norms."""

    def __init__(self, cell: _Cell, r: np.ndarray, c: np.ndarray, dot: np.ndarray):
        self.cell, self.r, self.c, self.dot = cell, r, c, dot
        self.na, self.nb = cell.norm[r], cell.norm[c]
        self.group = cell.group[r]
        self.known = cell.known[r] & cell.known[c]

    def cosine(self) -> np.ndarray:
        """NaN where a vector is null or has no length."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.known, np.clip(self.dot / np.sqrt(self.na * self.nb), -1, 1), np.nan)

    def squared(self) -> np.ndarray:
        """From the products, or by difference where that would lose digits: copies are at 0."""
        d = self.na + self.nb - 2 * self.dot
        close = np.flatnonzero(d < 1e-4 * (self.na + self.nb))
        for at in range(0, len(close), 20_000):
            k = close[at : at + 20_000]
            e = self.cell.x[self.r[k]] - self.cell.x[self.c[k]]
            d[k] = np.einsum("ij,ij->i", e, e)
        return d


class _Cell:
    def __init__(self, batches: Iterator[pa.RecordBatch]):
        t = pa.Table.from_batches(batches)
        names, self.group = np.unique(t["grp"].to_numpy(), return_inverse=True)
        self.names = names.tolist()
        self.id = t["id"].to_numpy()
        v = t["vector"].combine_chunks()
        self.known = v.is_valid().to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        self.x = np.zeros((len(v), len(flat) // max(int(self.known.sum()), 1)))
        self.x[self.known] = flat.reshape(int(self.known.sum()), self.x.shape[1])
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        b = t["b"].to_numpy()
        self.left, self.right = np.flatnonzero(b == t["i"][0].as_py()), np.flatnonzero(b == t["j"][0].as_py())

    def parts(self) -> Iterator[_Part]:
        for at in range(0, len(self.left), ROWS):
            left = self.left[at : at + ROWS]
            ok = (self.group[left][:, None] == self.group[self.right]) & (self.id[left][:, None] < self.id[self.right])
            r, c = np.nonzero(ok)
            if len(r):
                yield _Part(self, left[r], self.right[c], (self.x[left] @ self.x[self.right].T)[ok])


def each_cell(dealt: DataFrame, run: Callable[[_Part], pa.RecordBatch], schema: str) -> DataFrame:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _Cell(batches).parts():
            out = run(part)
            if out.num_rows:
                yield out

    return dealt.groupBy("i", "j").applyInArrow(whole, schema)


def _round(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Half away from 0."""
    return x if digits is None else np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x)


def _result(part: _Part, keep, values: np.ndarray, name: str, null: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part.cell.id[part.r[keep]]), pa.array(part.cell.id[part.c[keep]]), pa.array(values, mask=null)], names=["a", "b", name])


def _schema(dealt: DataFrame, name: str) -> str:
    kind = dealt.schema["id"].dataType.simpleString()
    return f"a {kind}, b {kind}, {name} double"


def cosine_pairs(vectors_: DataFrame, key: str, group: str, at_least: float, digits: int | None = None) -> DataFrame:
    """Pairs a < b of a group whose cosine isn't below ``at_least``; that of a vector without length is NaN, the largest value."""

    def run(p: _Part) -> pa.RecordBatch:
        cosine = p.cosine()
        keep = np.flatnonzero(p.known & ~(cosine < at_least))
        return _result(p, keep, _round(cosine[keep], digits), "cosine")

    dealt = cells(vectors_, key, group)
    return each_cell(dealt, run, _schema(dealt, "cosine"))


def _middle(counts: DataFrame, value: str, rank: str = "rank") -> DataFrame:
    """The row of ``counts(grp, end, value, n, rank)`` that holds the ``rank``-th of its group, with the rank inside it."""
    before = F.sum("n").over(Window.partitionBy("grp", "end").orderBy(value)) - F.col("n")
    at = counts.withColumn("before", before).where((F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("before") + F.col("n")))
    return at.select("grp", "end", value, (F.col(rank) - F.col("before")).alias("rank"))


def median_squares(dealt: DataFrame) -> dict:
    """The median of each group's distances above 0: the leading bits of both middle ones by a histogram, then the rest among the pairs that share those bits.

    Counts are added up in each part of a cell before they are sent.
    """
    kind = dealt.schema["grp"].dataType.simpleString()
    arrow = to_arrow_type(dealt.schema["grp"].dataType)

    def heads(p: _Part) -> pa.RecordBatch:
        d = p.squared()
        k = p.known & (d > 0)
        bins = d[k].view(np.int64) >> _LOW
        low = int(bins.min()) if len(bins) else 0
        width = (int(bins.max()) - low + 1) if len(bins) else 1
        g, at = np.unique(p.group[k], return_inverse=True)
        n = np.bincount(at * width + bins - low) if len(g) * width <= 1 << 22 else None
        if n is None:
            key, n = np.unique(at * width + bins - low, return_counts=True)
        else:
            key = np.flatnonzero(n)
            n = n[key]
        names = [p.cell.names[x] for x in g[key // width].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(names, arrow), pa.array(key % width + low), pa.array(n)], names=["grp", "head", "n"])

    found = each_cell(dealt, heads, f"grp {kind}, head bigint, n bigint").groupBy("grp", "head").agg(F.sum("n").alias("n"))
    found = materialize(found, "pair-heads")
    total = found.groupBy("grp").agg(F.sum("n").alias("total")).select("grp", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor((F.col("total") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("end"), F.floor(F.col("total") / 2).alias("rank")))).alias("e")).select("grp", "e.end", "e.rank")
    want = _middle(found.join(total, "grp"), "head").collect()
    heads_of: dict = {}
    for row in want:
        heads_of.setdefault(row.grp, set()).add(row["head"])

    def tails(p: _Part) -> pa.RecordBatch:
        d = p.squared()
        g, v, n = [], [], []
        for code in np.unique(p.group):
            name = p.cell.names[code]
            if name in heads_of:
                mine = d[p.known & (d > 0) & (p.group == code)].view(np.int64)
                mine, count = np.unique(mine[np.isin(mine >> _LOW, list(heads_of[name]))], return_counts=True)
                g.extend([name] * len(mine))
                v.extend(mine.tolist())
                n.extend(count.tolist())
        return pa.RecordBatch.from_arrays([pa.array(g, arrow), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["grp", "bits", "n"])

    inside = each_cell(dealt, tails, f"grp {kind}, bits bigint, n bigint").groupBy("grp", "bits").agg(F.sum("n").alias("n"))
    asked = dealt.sparkSession.createDataFrame([(r.grp, r["head"], r.end, r.rank) for r in want], f"grp {kind}, head bigint, end int, rank bigint")
    inside = inside.withColumn("head", F.shiftright("bits", _LOW)).join(asked, ["grp", "head"])
    ends: dict = {}
    for r in _middle(inside, "bits").collect():
        ends.setdefault(r.grp, []).append(float(np.sqrt(np.int64(r.bits).view(np.float64))))
    return {g: sum(x) / len(x) for g, x in ends.items()}


def rbf_pairs(vectors_: DataFrame, key: str, group: str, digits: int | None = None) -> DataFrame:
    """exp(-gamma d^2) with gamma = 1 / (2 median(d > 0)^2), the median by group; groups where no d is above 0 have no rows."""
    return _with_medians(vectors_, key, group, "rbf", lambda p, rbf: _round(rbf, digits), null_at=lambda p: ~p.known)


def similarity_pairs(vectors_: DataFrame, key: str, group: str, digits: int | None = None) -> DataFrame:
    """max(0, 0.5 (0.7 cosine + 0.3 rbf)); 0 where a vector is null."""

    def blend(p: _Part, rbf: np.ndarray) -> np.ndarray:
        w = np.maximum(0.0, 0.5 * (0.7 * p.cosine() + 0.3 * rbf))
        return _round(np.where(p.known, w, 0.0), digits) + 0.0

    return _with_medians(vectors_, key, group, "w", blend, null_at=None)


def _with_medians(vectors_: DataFrame, key: str, group: str, name: str, value, null_at) -> DataFrame:
    dealt = cells(vectors_, key, group)
    medians = median_squares(dealt)

    def run(p: _Part) -> pa.RecordBatch:
        med = np.array([medians.get(g, np.nan) for g in p.cell.names])[p.group]
        rbf = np.exp(-p.squared() / (2 * (med * med + 1e-8)))
        keep = np.flatnonzero(np.array([g in medians for g in p.cell.names])[p.group])
        null = null_at(p)[keep] if null_at else None
        return _result(p, keep, value(p, rbf)[keep], name, null)

    return each_cell(dealt, run, _schema(dealt, name))
