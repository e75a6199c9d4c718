"""Toxicity: a factorization machine over hashed terms.

``fit`` learns from a bounded sample of labelled rows (``sample``, a documented
parameter: the rows with the lowest keyed hash, so reruns agree); ``score``
then reads every whole text once, without a shuffle. A score is

    sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>)

over the distinct hashed terms of the text that the model knows: the linear
part knows single insults, the factors know pairs such as an insult next to a
group mention that no single weight explains. Known are the ``TERMS`` terms that
tell the classes apart best by themselves, and the terms of pairs that tell them
apart together, though neither may do so alone (``strong_pairs``).

Null and empty texts have no terms and get sigmoid(b). With no usable labels
(none, or one class) every score is the share of label 1 or 0. Rows whose
label is null teach nothing; ids of any type, null ones match no label. Repeated
rows count as often as they occur. A text of any length is read whole and needs
memory for its distinct words only. An empty table stays empty. Other columns,
of any name, pass through and are never inputs; the score wins over one of its
own name.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_arrow, quoted, schema_of, trim

HASH_BITS = 22
SAMPLE = 12_000
STEM = 4
CACHE = 300_000
TERMS = 512
FACTORS = 4
MIN_DF = 3
#: A term is kept if its chi-square against the label is at least this: about one in 100,000 terms by chance.
STRENGTH = 20.0
#: Pairs are sought among this many of the most frequent terms of the sample.
PAIR_TERMS = 1024
#: A pair's terms are kept if having both is at least so strong: by chance in one of a billion pairs.
PAIR_STRENGTH = 38.0
STEPS = 400
_TERM = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Model:
    """``terms`` (sorted hashes), ``w``, ``v`` (terms x factors) and ``b``; its size is bounded by TERMS."""

    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray
    b: float

    def __call__(self, text: str | None) -> float:
        mine = np.fromiter(known_terms(text or "", self.lookup(), self.__dict__.setdefault("_seen", {})), dtype=np.int64)
        v = self.v[mine]
        total = v.sum(axis=0)
        z = self.b + self.w[mine].sum() + 0.5 * float((total * total).sum() - (v * v).sum())
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))

    def lookup(self) -> dict[int, int]:
        found = self.__dict__.get("_lookup")
        if found is None:
            found = {int(t): i for i, t in enumerate(self.terms)}
            object.__setattr__(self, "_lookup", found)
        return found


def term_hash(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


def word_terms(word: str) -> tuple[int, int]:
    """A word's two terms: itself, and its first ``STEM`` letters, which its inflections and compounds share."""
    return term_hash(word), term_hash("^" + word[:STEM])


def text_terms(text: str) -> set[int]:
    found: set[int] = set()
    for word in set(_TERM.findall(text.lower())):
        found.update(word_terms(word))
    return found


def known_terms(text: str, lookup: dict[int, int], seen: dict[str, tuple[int, ...]]) -> list[int]:
    """Places of a text's terms that the model knows; ``seen`` remembers words and starts over when full."""
    found: set[int] = set()
    for word in set(_TERM.findall(text.lower())):
        mine = seen.get(word)
        if mine is None:
            if len(seen) >= CACHE:
                seen.clear()
            mine = seen[word] = tuple(lookup[h] for h in word_terms(word) if h in lookup)
        if mine:
            found.update(mine)
    return sorted(found)


def chi_square(hits, df, pos: float, n: int):
    """Of having a term (in ``df`` of n rows, ``hits`` of them positive) against the label."""
    expect = df * pos / n
    return (hits - expect) ** 2 / np.maximum(expect * (1 - pos / n) * (1 - df / (n + 1)), 1e-9)


def presence(rows: list[np.ndarray], terms: np.ndarray) -> np.ndarray:
    """rows x terms: 1 where a row has a term."""
    place = np.full(1 << HASH_BITS, -1, np.int32)
    place[terms] = np.arange(len(terms))
    x = np.zeros((len(rows), len(terms)), dtype=np.float32)
    for i, r in enumerate(rows):
        mine = place[r]
        x[i, mine[mine >= 0]] = 1.0
    return x


def strong_pairs(x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Columns of at most ``limit`` pairs of columns of ``x`` whose joint presence tells more than either alone."""
    n, pos = len(y), float(y.sum())
    toxic = x[y > 0]
    both, hits = x.T @ x, toxic.T @ toxic
    alone = chi_square(hits.diagonal(), both.diagonal(), pos, n)
    joint = chi_square(hits, both, pos, n)
    joint[(joint < PAIR_STRENGTH) | (both < MIN_DF) | (joint <= 1.5 * np.maximum(alone[:, None], alone))] = 0
    joint = np.triu(joint, 1)
    found = np.argsort(-joint, axis=None, kind="stable")[:limit]
    i, j = np.unravel_index(found[joint.ravel()[found] > 0], joint.shape)
    return np.unique(np.concatenate([i, j]))


def train(rows: list[np.ndarray], labels: np.ndarray, terms: int = TERMS, factors: int = FACTORS, steps: int = STEPS, l2: float = 2e-3, seed: int = 7) -> Model:
    """Full-batch Adam on the logistic loss; the terms kept are those that tell the classes apart best."""
    y = np.asarray(labels, dtype=np.float32)
    empty = Model(np.empty(0, np.int64), np.empty(0), np.empty((0, factors)), 0.0)
    if len(y) == 0 or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Model(empty.terms, empty.w, empty.v, 40.0 if p > 0.5 else -40.0)
    # Counts over the whole hash space are of fixed size, unlike the terms of all rows side by side.
    df, hits = np.zeros(1 << HASH_BITS, np.float32), np.zeros(1 << HASH_BITS, np.float32)
    for r, label in zip(rows, y, strict=True):
        df[r] += 1
        hits[r] += label
    values = np.flatnonzero(df >= MIN_DF)
    df, hits = df[values].astype(float), hits[values].astype(float)
    n, pos = len(y), float(y.sum())
    strength = chi_square(hits, df, pos, n)
    best = np.argsort(-strength, kind="stable")[: min(terms, int((strength >= STRENGTH).sum()))]
    frequent = np.argsort(-df, kind="stable")[:PAIR_TERMS]
    pairs = strong_pairs(presence(rows, values[frequent]), y, terms)
    best = np.union1d(best, frequent[pairs]).astype(np.int64)
    x = presence(rows, values[best])
    rng = np.random.default_rng(seed)
    params = [np.zeros(len(best), np.float32), (rng.standard_normal((len(best), factors)) * 0.1).astype(np.float32), np.array([math.log(pos / (n - pos))], np.float32)]
    m = [np.zeros_like(p) for p in params]
    s = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w, v, b = params
        xv = x @ v
        z = b[0] + x @ w + 0.5 * ((xv * xv).sum(axis=1) - x @ (v * v).sum(axis=1))
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        gx = x.T @ g
        grads = [gx + l2 * w / 100, x.T @ (g[:, None] * xv) - gx[:, None] * v + l2 * v, np.array([g.sum()], np.float32)]
        for p, d, a, q in zip(params, grads, m, s, strict=True):
            a += 0.1 * (d - a)
            q += 0.01 * (d * d - q)
            p -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.99**step)) + 1e-8)
    return Model(values[best].astype(np.int64), params[0].astype(float), params[1].astype(float), float(params[2][0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``sample`` rows of ``labels`` for which ``learn`` holds.

    The sample is at most ``sample`` ids and labels, so it is broadcast to the
    scan of the texts; what comes back is the hashed terms of those documents.
    """
    spark = docs.sparkSession
    chosen = labels.where(learn & F.col(label_col).isNotNull()).select(F.col(quoted(id_col)).cast("string").alias("id"), F.col(quoted(label_col)).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit("toxicity")), "id", "y").limit(sample).toPandas()
    chosen = spark.createDataFrame(chosen, "id string, y double")
    texts = docs.select(F.col(quoted(id_col)).cast("string").alias("id"), F.col(quoted(text_col)).alias("text")).join(F.broadcast(chosen), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            terms = [np.array(sorted(text_terms(t or "")), dtype="<i4").tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(terms, pa.binary())], names=["id", "y", "terms"])

    got = map_arrow(texts, run, "id string, y double, terms binary").toPandas().sort_values(["id", "y", "terms"], ignore_index=True)
    model = train([np.frombuffer(t, dtype="<i4") for t in got["terms"]], got["y"].to_numpy())
    trim()  # the driver has other things to do
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` without its text but with its score; the row-wise pass keeps the other columns.

    Pass a copy of the text under another name to keep it.
    """
    kept = [c for c in docs.columns if c not in (text_col, out_col)]
    src = docs.select(*map(quoted, kept), F.col(quoted(text_col)).alias("scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns - 1)] + [pa.array(got, pa.float64())], names=[*kept, out_col])

    return map_arrow(src, run, schema_of(src, kept, {out_col: "double"}))
