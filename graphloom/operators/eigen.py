"""Leading eigenvectors of a sparse symmetric matrix that no single task can hold.

Vectors are a table ``(node, c0, c1, ...)``; a product with the matrix deals
them to blocks of its rows. Only Gram matrices, of a size set by the number of
vectors, and the node strengths reach the driver.

Subspace iteration with a filter: a round multiplies by ``degree`` factors
``A - r``, the roots ``r`` being the Chebyshev points of the part of the
spectrum that is not wanted, then takes the best vectors of the space reached
(Rayleigh-Ritz). It stops when all wanted vectors are eigenvectors up to
``tol``, or after ``rounds``; where eigenvalues lie closer than that resolves,
the vectors of the last round span the space that was found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.leiden import _Spread, link_rows, spread
from graphloom.session import forget, materialize

#: Blocks of rows of a matrix, and the links that one step of numpy sees.
BLOCKS, STEP = 8, 200_000


def adjacency(edges: DataFrame, nodes: DataFrame, normalised: bool) -> DataFrame:
    """Entries ``(src, dst, w, loop)`` of A + 1e-6 I, scaled by node strengths or by the largest of them.

    ``edges`` count in both directions; of parallel ones the heaviest stays.
    Every eigenvalue of the result lies in [-1, 1].
    """
    w = F.col("weight").cast("double").alias("w")
    both = edges.select("src", "dst", w).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w))
    rows = both.groupBy("src", "dst").agg(F.max("w").alias("w")).withColumn("loop", F.lit(False))
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1e-6).alias("w"), F.lit(True).alias("loop"))
    rows = materialize(rows.unionByName(loops), "matrix-raw")
    d = rows.groupBy("src").agg(F.sum("w").alias("ds"))
    if normalised:
        ends = d.select(F.col("src").alias("dst"), F.col("ds").alias("dd"))
        scaled = rows.join(d, "src").join(ends, "dst").withColumn("w", F.col("w") / F.sqrt(F.col("ds") * F.col("dd")))
    else:
        scaled = rows.withColumn("w", F.col("w") / F.lit(d.agg(F.max("ds")).first()[0] or 1.0))
    out = materialize(scaled.select("src", "dst", "w", "loop"), "matrix")
    forget(rows)
    return out


@dataclass
class _Matrix:
    """diag(scale) W diag(scale) + diag(diagonal), W the links between the nodes ``ids(node, id)``."""

    ids: DataFrame
    links: _Spread
    scale: np.ndarray
    diagonal: np.ndarray

    def rows(self) -> DataFrame:
        return self.links.rows.withColumn("block", F.col("node") % BLOCKS)


def _times(a: _Matrix, held, x: DataFrame, names: list[str], root: float, images: list[str] | None = None, single: bool = False) -> DataFrame:
    """(A - root) X; with ``images`` for its names, X beside it.

    A block of rows meets a copy of X, so that a vector is sent ``BLOCKS``
    times, whatever the number of links; ``single`` sends it with 24 bits.
    """
    kind = "float" if single else "double"
    dealt = x.select("node", *[F.col(c).cast(kind).alias(c) for c in names], F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    out = [*names, *images] if images else names

    def run(rows: pa.Table, vectors: pa.Table) -> pa.Table:
        scale, diagonal = held.value
        full = np.zeros((len(scale), len(names)), np.float32 if single else np.float64)
        at = vectors["node"].to_numpy()
        for j, c in enumerate(names):
            full[at, j] = vectors[c].to_numpy()
        mine = at[at % BLOCKS == vectors["block"][0].as_py()]  # a node without links has no row
        y = (diagonal[mine] - root)[:, None] * full[mine]
        where = np.full(len(scale), -1, np.int32)
        where[mine] = np.arange(len(mine))
        for b in rows.to_batches():
            if b.num_rows:
                node, ptr, nbr, w = link_rows(b)
                w = w * scale[nbr]
                cuts = np.unique(np.searchsorted(ptr, np.arange(0, ptr[-1] + STEP, STEP)).clip(0, len(node)))
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    part = slice(ptr[lo], ptr[hi])
                    y[where[node[lo:hi]]] += scale[node[lo:hi], None] * np.add.reduceat(full[nbr[part]] * w[part, None], ptr[lo:hi] - ptr[lo])
        columns = [full[mine, j].astype(float) for j in range(len(names))] if images else []
        return pa.table([mine, *columns, *[np.ascontiguousarray(y[:, j]) for j in range(len(names))]], names=["node", *out])

    return a.rows().groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(run, ", ".join(["node int", *[f"{c} double" for c in out]]))


def _gram(x: DataFrame, names: list[str]) -> np.ndarray:
    """X^T X, summed in each partition before anything is sent."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(names), len(names)))
        for p in parts:
            z = p.to_numpy(dtype=float)
            total += z.T @ z
        yield pd.DataFrame({"i": np.arange(total.size), "v": total.ravel()})

    found = x.select(*names).mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(len(names) ** 2)
    out[found["i"]] = found["v"]
    return out.reshape(len(names), -1)


def _rotate(x: DataFrame, names: list[str], u: np.ndarray) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = pd.DataFrame(p[names].to_numpy(dtype=float) @ u, columns=names)
            out.insert(0, "node", p["node"].to_numpy())
            yield out

    return x.select("node", *names).mapInPandas(run, x.select("node", *names).schema)


def _roots(theta: np.ndarray, degree: int, by_size: bool) -> list[float]:
    """Chebyshev points of [-1, c], or those of [-c, c] in pairs; c is the least value in the space."""
    points = np.cos((2 * np.arange(degree) + 1) * np.pi / (2 * degree))
    if by_size:
        return (np.abs(theta).min() * points).tolist()
    c = min(float(theta.min()), 0.999)
    return ((c - 1) / 2 + (c + 1) / 2 * points).tolist()


def leading(a: DataFrame, nodes: DataFrame, k: int, by_size: bool = False, **how) -> tuple[DataFrame, list[str], np.ndarray]:
    """``_leading`` for the matrix ``a`` of ``adjacency``."""
    ids, links = spread(a.where("NOT loop").select("src", "dst", F.col("w").alias("weight")).where("src < dst"), nodes)
    loops = a.where("loop").select(F.col("src").alias("node"), "w").join(ids, "node").select("id", "w").toArrow()
    diagonal = np.bincount(loops["id"].to_numpy(), weights=loops["w"].to_numpy(), minlength=links.n)
    return _leading(_Matrix(ids, links, np.ones(links.n), diagonal), k, by_size, **how)


def leading_of(edges: DataFrame, nodes: DataFrame, k: int, normalised: bool, by_size: bool = False) -> tuple[DataFrame, list[str], np.ndarray]:
    """The same from the edges: node strengths, one number a node, scale the vectors, and the links stay as they are."""
    ids, links = spread(edges, nodes, parallel=F.max)
    d = links.strength() + 1e-6
    d = d if normalised else np.full(links.n, d.max())
    return _leading(_Matrix(ids, links, 1 / np.sqrt(d), 1e-6 / d), k, by_size)


def _leading(a: _Matrix, k: int, by_size: bool = False, spare: int = 8, degree: int = 8, rounds: int = 30, tol: float = 1e-3) -> tuple[DataFrame, list[str], np.ndarray]:
    """Vectors ``(node, c0..)``, the names of the first ``k`` and their values.

    They are sorted by value, or by its size where ``by_size`` says so. The
    first vectors are hashes of the nodes, so reruns start alike.
    """
    names = [f"c{j}" for j in range(k + spare)]
    start = [(F.xxhash64("node", F.lit(j)) / F.lit(2.0**63)).alias(c) for j, c in enumerate(names)]
    x = materialize(a.ids.select(F.col("id").alias("name"), *start).withColumnRenamed("name", "node"), "vectors")
    held = x.sparkSession.sparkContext.broadcast((a.scale, a.diagonal))
    images = [f"y{j}" for j in range(len(names))]
    for step in range(rounds + 1):
        gram = _gram(_times(a, held, x, names, 0.0, images), names + images)
        m = len(names)
        scale = 1 / np.sqrt(np.maximum(np.diag(gram)[:m], 1e-300))
        values, q = np.linalg.eigh(scale[:, None] * gram[:m, :m] * scale)
        basis = scale[:, None] * (q / np.sqrt(np.maximum(values, values[-1] * 1e-13)))
        inner = basis.T @ gram[:m, m:] @ basis
        theta, u = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-np.abs(theta) if by_size else -theta, kind="stable")
        theta, u = theta[order], basis @ u[:, order]
        square = np.einsum("ij,ik,kj->j", u, gram[m:, m:], u) - theta**2
        rest = np.sqrt(np.maximum(square[:k], 0))
        turned = materialize(_rotate(x, names, u), "vectors")
        forget(x)
        x = turned
        if step == rounds or rest.max() <= tol * max(abs(theta[0]), 1e-12):
            break
        for root in _roots(theta, degree, by_size):
            x = _times(a, held, x, names, root, single=True)
        x, old = materialize(x, "vectors"), turned
        forget(old)
    held.destroy()
    a.links.drop()
    named = a.ids.join(x.withColumnRenamed("node", "id"), "id")
    return named.select("node", *names[:k]), names[:k], theta[:k]
