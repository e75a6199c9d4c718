"""Which windows of a corpus repeat: distributed resolution of the anchors in ``windows``.

1. ``runs``: each task sorts the anchors of its documents by (gram, context)
   into an immutable run, tells what repeats inside it, and sends one entry
   for each class of equal contexts, packed by range of gram hash.
2. ``merge``: runs of one range are merged and neighbours compared. An anchor
   whose class a smaller id has is told as a whole; a gram with two or more
   different contexts stays open, as its windows may agree in part; any other
   is unique. A gram that is hot in some run is not merged in one task: its
   entries are passed on and settled by a partially aggregated group-by and a
   join that Spark can split.
3. ``open_anchors``: only open anchors are looked at window by window.

A window repeats if a document of a smaller id has it. Runs of earlier batches
take part as what is smaller: only grams that a fresh run has are looked at, and
nothing is told of the earlier rows. Nothing is sampled or capped: an anchor is
dropped only when no other anchor has its gram.

Rows are told apart by ``(doc, body)``: their id, ``NO_ID`` where it is null,
and the XXH64 of their text. Rows equal in both share all verdicts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_arrow
from graphloom.llm.windows import Hashes, anchors, covered, mix, spread
from graphloom.session import materialize

#: Anchors after which a task closes a run.
RUN_ANCHORS = 500_000
#: Different contexts of one gram in one run from which the gram is hot.
HOT = 256
NO_ID = (1 << 63) - 1
REPEATED, OPEN = 1, 2  # bits of a verdict
_ENTRY = np.dtype([("g", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("body", "<i8"), ("ord", "<u4"), ("flag", "u1")])
#: Flags of an entry: it marks a hot gram, it belongs to one, it is told, it is of a fresh run.
_MARK, _PASS, _TOLD, _FRESH = 2, 4, 8, 16


def _pack(e: np.ndarray) -> bytes:
    """Columns apart, small differences, then zstd."""
    g = np.diff(e["g"], prepend=np.uint64(0))
    lo = int(e["doc"].min())
    doc = e["doc"] - lo
    doc = doc.astype("<u4") if int(doc.max()) < 1 << 32 else doc
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in (g, e["c"], doc, e["body"], e["ord"], e["flag"]))
    # Bytes of equal significance together compress better.
    parts = [np.ascontiguousarray(x).view(np.uint8).reshape(len(e), -1).T.tobytes() for x in (g, e["c"], doc, e["body"], e["ord"], e["flag"])]
    packed = pa.compress(b"".join(parts), codec="zstd", asbytes=True)
    return b"".join([len(e).to_bytes(4, "little"), bytes([doc.itemsize]), lo.to_bytes(8, "little", signed=True), len(raw).to_bytes(4, "little"), packed])


def _unpack(data: bytes) -> np.ndarray:
    n, width, lo = int.from_bytes(data[:4], "little"), data[4], int.from_bytes(data[5:13], "little", signed=True)
    raw = pa.decompress(data[17:], decompressed_size=int.from_bytes(data[13:17], "little"), codec="zstd", asbytes=True)
    out, at = np.empty(n, _ENTRY), 0
    for name, kind in (("g", "<u8"), ("c", "<u8"), ("doc", "<u4" if width == 4 else "<i8"), ("body", "<i8"), ("ord", "<u4"), ("flag", "u1")):
        size = np.dtype(kind).itemsize
        column = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
        out[name] = np.cumsum(column) if name == "g" else column.astype(np.int64) + lo if name == "doc" else column
        at += n * size
    return out


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row starts a run of rows equal in all columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class Rule:
    """How tokens are made and how many of them a window and a gram have."""

    def __init__(self, tokens: Callable[[bytes], np.ndarray], width: int, gram: int):
        self.tokens, self.width, self.gram = tokens, width, gram

    def of(self, text: bytes):
        return anchors(Hashes(self.tokens(text)), self.width, self.gram)


_OUT_SCHEMA = "doc long, body long, ord long, verdict tinyint, g long, c long"


def _rows(doc, body, ord_, verdict, g=None, c=None) -> pa.RecordBatch:
    none = pa.nulls(len(doc), pa.int64())
    cols = [pa.array(doc, pa.int64()), pa.array(body, pa.int64()), pa.array(ord_.astype(np.int64)), pa.array(verdict.astype(np.int8)), none if g is None else pa.array(g.view(np.int64)), none if c is None else pa.array(c.view(np.int64))]
    return pa.RecordBatch.from_arrays(cols, names=["doc", "body", "ord", "verdict", "g", "c"])


def _close_run(e: np.ndarray, buckets: int, hot: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Payloads by bucket: 0.. by range of gram, ``buckets``.. for entries of hot grams, ``2 * buckets``.. for what is told."""
    e = e[np.lexsort((e["ord"], e["body"], e["doc"], e["c"], e["g"]))]
    at = np.flatnonzero(_starts(e["g"], e["c"]))
    head = np.repeat(at, np.diff(np.append(at, len(e))))  # the class's first entry: the smallest id
    own = _starts(e["g"], e["c"], e["doc"], e["body"])  # a text's anchors of one class share a verdict, see ``picked``
    larger = e["doc"] > e["doc"][head]
    told = e[larger & own].copy()
    told["flag"] = _TOLD
    chunks = [told[at : at + 100_000] for at in range(0, len(told), 100_000)]
    yield _payloads([2 * buckets + (salt + i) % buckets for i in range(len(chunks))], chunks)
    e = e[~larger & own]  # each text of the smallest id is still in doubt
    if not len(e):
        return
    group = np.cumsum(_starts(e["g"])) - 1
    many = np.bincount(group) >= hot
    passed = many[group]
    bucket = (e["g"] >> np.uint64(32)).astype(np.int64) * buckets >> 32
    if passed.any():
        marks = e[passed & _starts(e["g"])].copy()
        marks["flag"] = _MARK
        e["flag"][passed] |= _PASS
        bucket[passed] = buckets + (np.arange(int(passed.sum())) + salt) % buckets
        bucket = np.concatenate([bucket, (marks["g"] >> np.uint64(32)).astype(np.int64) * buckets >> 32])
        e = np.concatenate([e, marks])
    order = np.lexsort((e["g"], bucket))
    e, bucket = e[order], bucket[order]
    cuts = np.flatnonzero(_starts(bucket))
    yield _payloads(bucket[cuts].tolist(), [e[a:b] for a, b in zip(cuts, np.append(cuts[1:], len(e)), strict=True)])


def _payloads(buckets: list[int], entries: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array([_pack(e) for e in entries], pa.binary())], names=["bucket", "payload"])


def runs(docs: DataFrame, rule: Rule, buckets: int, hot: int = HOT, run_anchors: int = RUN_ANCHORS) -> DataFrame:
    """From ``(doc, body, text)``: ``(bucket, payload)``, what each run has for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = salt = 0
        for b in batches:
            for doc, body, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                g, c, first, _ = rule.of(data)
                if not len(g):
                    continue
                e = np.empty(len(g), _ENTRY)
                e["g"], e["c"], e["doc"], e["body"], e["flag"] = g, c, doc, body, 0
                e["ord"] = np.arange(len(g), dtype=np.uint32)
                held.append(e)
                n += len(e)
                if n >= run_anchors:
                    yield from _close_run(np.concatenate(held), buckets, hot, salt)
                    held, n, salt = [], 0, salt + 1
        if held:
            yield from _close_run(np.concatenate(held), buckets, hot, salt)

    return map_arrow(docs.select("doc", "body", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")), run, "bucket int, payload binary")


def _merge_bucket(payloads: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    e = np.concatenate(payloads)
    told = (e["flag"] & _TOLD) > 0
    if told.any():
        x = e[told & ((e["flag"] & _FRESH) > 0)]
        yield _rows(x["doc"], x["body"], x["ord"], np.full(len(x), REPEATED))
        e = e[~told]
    marked = np.unique(e["g"][(e["flag"] & _MARK) > 0])
    e = e[(e["flag"] & _MARK) == 0]
    away = (e["flag"] & _PASS) > 0
    if len(marked):
        away |= np.isin(e["g"], marked)
    if away.any():
        x = e[away]
        yield _rows(x["doc"], x["body"], x["ord"], (x["flag"] & _FRESH > 0).astype(np.int8), x["g"], x["c"])
        e = e[~away]
    if not len(e):
        return
    e = e[np.lexsort((e["ord"], e["body"], e["doc"], e["c"], e["g"]))]
    group = np.cumsum(_starts(e["g"])) - 1
    e = e[(np.bincount(group, weights=(e["flag"] & _FRESH) > 0) > 0)[group]]
    if not len(e):
        return
    group = np.cumsum(_starts(e["g"])) - 1
    at = np.flatnonzero(_starts(e["g"], e["c"]))
    smallest = e["doc"][np.repeat(at, np.diff(np.append(at, len(e))))]
    fresh = (e["flag"] & _FRESH) > 0
    repeated = e["doc"] > smallest
    # Of a class only the texts of the smallest id are still in doubt, and they stand for the others.
    open_ = (np.bincount(group[at]) > 1)[group] & ~repeated
    told = repeated & fresh | open_
    if told.any():
        yield _rows(e["doc"][told], e["body"][told], e["ord"][told], (repeated * REPEATED + open_ * OPEN)[told])


def merge(payloads: DataFrame) -> DataFrame:
    """Merges the runs ``(bucket, payload, fresh)`` of each bucket; a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for bucket, payload, fresh in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                if bucket != at and held:
                    yield from _merge_bucket(held)
                    held = []
                at = bucket
                held.append(_unpack(payload))
                held[-1]["flag"] |= fresh * _FRESH
        if held:
            yield from _merge_bucket(held)

    return map_arrow(payloads.select("bucket", "payload", F.col("fresh").cast("int")).repartition("bucket").sortWithinPartitions("bucket"), run, _OUT_SCHEMA)


def settle_hot(hot: DataFrame) -> DataFrame:
    """Verdicts of entries of hot grams ``(doc, body, ord, verdict, g, c)``, where ``verdict`` is 1 for a fresh one.

    These grams have many contexts, so the texts of each class's smallest id stay open.
    """
    low = materialize(hot.groupBy("g", "c").agg(F.min("doc").alias("low")), "repeats-classes")
    both = hot.select("doc", "body", "ord", F.col("verdict").alias("fresh"), "g", "c").join(low, ["g", "c"])
    told = F.when(F.col("doc") == F.col("low"), F.lit(OPEN)).when(F.col("fresh") > 0, F.lit(REPEATED)).otherwise(0)
    return both.select("doc", "body", "ord", told.cast("tinyint").alias("verdict")).where("verdict > 0")


def by_document(verdicts: DataFrame) -> DataFrame:
    """``(doc, body, verdicts array<long>)``: ordinal and bits of each verdict as one number, once for equal rows."""
    return verdicts.groupBy("doc", "body").agg(F.collect_set(F.col("ord") * 8 + F.col("verdict")).alias("verdicts"))


def picked(rule: Rule, data: bytes, verdicts: np.ndarray, bit: int):
    """The anchors of a text whose verdict has ``bit``: ``(hashes, gram, first, last)``."""
    mine = verdicts[(verdicts & bit) > 0] >> 3
    if not len(mine):
        none = np.empty(0, np.int64)
        return None, none.view(np.uint64), none, none
    h = Hashes(rule.tokens(data))
    g, c, first, last = anchors(h, rule.width, rule.gram)
    classes = mix(g) ^ c
    mine = np.flatnonzero(np.isin(classes, classes[mine]))
    return h, g[mine], first[mine], last[mine]


def open_anchors(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows ``(g, h, doc, body, at)`` for each window of the open anchors of ``(doc, body, text, verdicts)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, body, text, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                data = text.as_buffer().to_pybytes()
                hashes, g, first, last = picked(rule, data, v.values.to_numpy(), OPEN)
                if len(g):
                    at = spread(first, last)
                    h = hashes.some(at, at + rule.width)
                    cols = [np.repeat(g, last - first + 1).view(np.int64), h.view(np.int64), np.full(len(at), doc), np.full(len(at), body), at]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], names=["g", "h", "doc", "body", "at"])

    return map_arrow(docs, run, "g long, h long, doc long, body long, at long")


def settle_windows(rows: DataFrame) -> DataFrame:
    """``(doc, body, at, n)``: the windows among ``(g, h, doc, body, at)`` that repeat, as stretches of n = 1."""
    same = rows.groupBy("g", "h").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("g", "h", "low")
    same = materialize(same, "repeats-windows")  # so that Spark can split a hot window's other side
    return rows.join(same, ["g", "h"]).where("doc > low").select("doc", "body", "at", F.lit(1).cast("long").alias("n"))


def marked_tokens(rule: Rule, data: bytes, n: int, verdicts: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of a text's ``n`` tokens a repeated window covers."""
    _, _, first, last = picked(rule, data, verdicts, REPEATED)
    return covered(n, np.concatenate([first, at]), np.concatenate([last, at + length - 1]), rule.width)


def resolve(docs: DataFrame, rule: Rule, payloads: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(verdicts by key, stretches by key)`` for ``marked_tokens``.

    ``docs`` is ``(doc, body, text)``, ``payloads`` its runs and those of
    ``history``, the rows of earlier batches: only rows of it that share a gram
    with an open one of ``docs`` are read beyond their key.
    """
    told = materialize(merge(payloads), "repeats-told")
    verdicts = told.where("g IS NULL").select("doc", "body", "ord", "verdict").unionByName(settle_hot(told.where("g IS NOT NULL")))
    verdicts = materialize(by_document(verdicts), "repeats-verdicts")
    doubtful = verdicts.where(F.exists("verdicts", lambda v: v.bitwiseAND(OPEN) > 0))
    both = docs if history is None else docs.unionByName(history)
    text = both.select("doc", "body", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    rows = materialize(open_anchors(text.join(doubtful, ["doc", "body"]), rule), "repeats-open")
    stretches = settle_windows(rows).groupBy("doc", "body").agg(F.collect_set(F.struct("at", "n")).alias("stretches"))
    return verdicts, stretches


def lists_of(verdicts, stretches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arrow scalars of one row as arrays."""
    none = np.empty(0, np.int64)
    v = verdicts.values.to_numpy() if verdicts.is_valid else none
    if not stretches.is_valid:
        return v, none, none
    s = stretches.values
    return v, s.field(0).to_numpy(), s.field(1).to_numpy()
