"""SimHash near-duplicates by covering locality-sensitive hashing.

``fingerprints`` gives each text 64 bits: bit i is set if it is set in over
half of the XXH64 values of its word shingles. ``link`` finds every pair of
fingerprints within ``radius`` bits, up to connectivity, and ``near_duplicates``
labels each document with the smallest doc_id it is linked to.

Covering: each bit position i gets a vector m(i) in GF(2)^(radius + 1); table v
(every nonzero vector, 31 of them for radius 4) compares the positions where
<m(i), v> = 1. The at most ``radius`` positions in which a pair differs span a
proper subspace, so some v is orthogonal to all of them, and in that table the
pair collides: no pair within the radius is missed.

Skew: exact copies share a fingerprint and enter once. Inside a bucket a
breadth-first search over the members not reached yet emits one link for each
member, never all pairs. A bucket of over ``bucket`` members, as a large group
of near copies makes, is not searched: its members go to an exact way that is
linear in them. Each emits all its variants within radius/2 bits (2081 for
radius 4); two fingerprints within the radius share a variant, and fingerprints
that share one are within the radius, so linking each to the first of its
variant keeps exactly the same components.

Nulls: a null text has no words and the zero fingerprint, linked like any
other; a row with a null doc_id takes the component of its fingerprint. Rows
repeated under one doc_id are one document. A text of any length is one row for
one task. An empty table gives an empty one. Other columns, whatever their
names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_arrow, quoted
from graphloom.operators.components import connected_components
from graphloom.session import materialize

SHINGLE = 4
SEED = 42
RADIUS = 4
BUCKET = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits of a text; words are split at ASCII white space and A-Z is lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        h = [digest(joined, SEED)]
    else:
        h = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    votes = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    src = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return map_arrow(src, run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64, seed: int = 1) -> list[int]:
    """The compared positions of every table, as signed longs."""
    size = 1 << (radius + 1)
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % (size - 1) + 1)
    masks = []
    for v in range(1, size):
        mask = sum(1 << i for i, m in enumerate(vectors.tolist()) if (m & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def _search(fp: np.ndarray, doc: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that keep the components of a bucket: one for each member reached."""
    links, rest = [], np.arange(1, len(fp))
    queue = [0]
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
            continue
        i = queue.pop()
        near = np.bitwise_count(fp[rest] ^ fp[i]) <= radius
        if near.any():
            found = rest[near]
            links += [(int(doc[i]), int(doc[j])) for j in found]
            queue += found.tolist()
            rest = rest[~near]
    return links


def _bucket_links(radius: int, bucket: int):
    """Reads rows ``(t, key, fp, doc)`` sorted by (t, key); memory holds a batch and one bucket."""

    def emit(kind: int, a: list, b: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 4), np.int64)
        full = None  # the bucket that is known to be too large, while its rows pass

        def groups(rows: np.ndarray, last: bool):
            nonlocal held, full
            if not len(rows):
                return
            new = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(rows)]])
            held = rows[:0]
            if not last:  # the last bucket may go on
                held, starts, ends = rows[starts[-1] :], starts[:-1], ends[:-1]
            sizes = ends - starts
            two = starts[sizes == 2]
            if len(two):
                near = np.bitwise_count((rows[two, 2] ^ rows[two + 1, 2]).view(np.uint64)) <= radius
                if near.any():
                    yield emit(0, rows[two[near], 3].tolist(), rows[two[near] + 1, 3].tolist())
            for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                if e - s > bucket or full == (int(rows[s, 0]), int(rows[s, 1])):
                    yield emit(1, rows[s:e, 2].tolist(), rows[s:e, 3].tolist())
                elif links := _search(rows[s:e, 2].view(np.uint64), rows[s:e, 3], radius):
                    yield emit(0, [x[0] for x in links], [x[1] for x in links])
            if full is not None:  # one or two rows left of a bucket that passed
                for s, e in zip(starts[sizes <= 2].tolist(), ends[sizes <= 2].tolist(), strict=True):
                    if full == (int(rows[s, 0]), int(rows[s, 1])):
                        yield emit(1, rows[s:e, 2].tolist(), rows[s:e, 3].tolist())
            if len(held) > bucket or (len(held) and full == (int(held[0, 0]), int(held[0, 1]))):
                full = (int(held[0, 0]), int(held[0, 1]))
                yield emit(1, held[:, 2].tolist(), held[:, 3].tolist())
                held = held[:0]
            elif len(held):
                full = None

        for b in batches:
            rows = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            yield from groups(np.concatenate([held, rows]), False)
        yield from groups(held, True)

    return run


def _variant_links(radius: int):
    flips = [0] + [sum(1 << i for i in c) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k)]
    flips = np.array(flips, dtype=np.uint64)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, doc = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for at in range(0, len(fp), 32):
                v = (fp[at : at + 32, None] ^ flips[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(np.repeat(doc[at : at + 32], len(flips)))], names=["variant", "doc"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        variant, first = None, None
        for b in batches:
            v, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.concatenate([[variant is None or v[0] != variant], v[1:] != v[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(v)), -1))
            heads = np.where(at >= 0, doc[np.maximum(at, 0)], first if first is not None else doc[0])
            variant, first = v[-1], heads[-1]
            pairs = np.unique(np.column_stack([heads, doc])[heads != doc], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return expand, link


def link(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges ``(u, v)`` between ``doc`` values that keep the components of all pairs within ``radius``.

    ``nodes`` is ``(fp, doc)`` with distinct fingerprints.
    """
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("long").alias("mask")) for t, m in enumerate(covering_masks(radius))])
    rows = nodes.select("fp", "doc", F.explode(tables).alias("x")).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"), "fp", "doc")
    rows = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    found = materialize(map_arrow(rows, _bucket_links(radius, bucket), "kind int, a long, b long"), "simhash-links")
    edges = found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    hot = found.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("doc")).distinct()
    if hot.isEmpty():
        return edges
    expand, join = _variant_links(radius)
    variants = map_arrow(hot.repartition("fp"), expand, "variant long, doc long").repartition("variant").sortWithinPartitions("variant", "doc")
    return edges.unionByName(map_arrow(variants, join, "u long, v long").distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col), "simhash-fps")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("doc")), "simhash-nodes")
    # Rows of one doc_id with different texts hold their fingerprints together.
    own = fps.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    edges = link(nodes.where("doc IS NOT NULL"), radius, bucket)
    if not own.isEmpty():
        held = fps.join(own, "doc_id").join(nodes, "fp").select(F.col("doc_id").alias("u"), F.col("doc").alias("v"))
        edges = edges.unionByName(held)
    comps = connected_components(edges)
    labels = nodes.join(comps, nodes["doc"] == comps["node"], "left").select("fp", F.coalesce("component", "doc").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """``(nameless, doc_id, body)``, one row for each component of rows ``(nameless, doc_id, body, text)``.

    A row is named by all three: whether it has no id, its id (0 where it has
    none) and a hash of its text. It is the smallest of its component, those
    with an id before those without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(3).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fp)], names=["nameless", "doc_id", "body", "fp"])

    rows = map_arrow(docs.select("nameless", "doc_id", "body", "text"), run, "nameless boolean, doc_id long, body long, fp long")
    # Copies and near copies that share a fingerprint are one node from here on.
    nodes = materialize(rows.groupBy("fp").agg(F.min(F.struct("nameless", "doc_id", "body")).alias("first")), "simhash-nodes")
    comps = connected_components(link(nodes.select("fp", F.col("fp").alias("doc")), radius, bucket))
    labels = nodes.join(comps, nodes["fp"] == comps["node"], "left").select("first", F.coalesce("component", "fp").alias("component"))
    return labels.groupBy("component").agg(F.min("first").alias("first")).select("first.*")


def hex16(fp):
    """A fingerprint's 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
