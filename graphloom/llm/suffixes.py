"""Suffix-array dedup: remove what a 400-byte string that starts elsewhere too covers.

1. Entries. All suffixes of all texts would be some hundred times the input, so
   the suffix array is sparse: a suffix is entered where an anchor of
   ``windows`` lies (one for about 170 bytes), at a place that its surroundings
   alone decide, so that equal 400-byte strings hold equal anchors. Of these,
   only suffixes whose leading 64 bytes occur at another anchor too, by a count
   of their hashes, are entered: with their bytes to the right, as far as a
   400-byte string through the anchor reaches, and those to the left.
2. Ranges. The entries are range-partitioned by their leading bytes, with
   splitters sampled from them (Spark's range partitioning, at most a million
   samples whatever the input). A range holds about ``range_bytes``: equal
   entries are told before they are sent, and a group of equal leading bytes
   that is hot is spread over ranges by a hash of the whole entry.
3. Sorting. Each range is sorted by multikey quicksort and neighbours are
   compared. Suffixes with the same leading 64 bytes form a group; its 400-byte
   strings, one for each place around the anchors, are sorted in the same way,
   and strings that are equal to the last byte are repeats.
4. Boundaries. The first and the last group of a range may go on in the next
   one. Their 400-byte strings are compared across ranges, by two 64-bit hashes,
   counted within a task before they are sent. This also takes a passage that a
   third of all documents share, whose group spans many ranges.

Equal texts need none of this: a text that occurs twice goes as a whole.

Rows are documents: rows repeated under one doc_id are copies of each other and
both lose what they share. Null texts are empty and lose nothing, like any text
of under 400 bytes. A null doc_id is an id like any other; ids are never
compared. A text of any length is held by one task at a time, at some 20 bytes
for each of its own. An empty table gives an empty one. Columns made here win
over others of the same name. Nothing is sampled or capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_arrow, quoted, schema_of
from graphloom.llm.multikey import multikey_quicksort, spread
from graphloom.llm.windows import BYTE_VALUES, Hashes, anchor_places, as_runs, covered
from graphloom.session import materialize

WIDTH = 400
GRAM = 64
#: Bytes of entries in a range, on average.
RANGE_BYTES = 12 << 20
#: Bytes of entries that a task tells apart before it sends them.
RUN_BYTES = 16 << 20
#: Windows that are sorted or sent at once.
CHUNK = 400_000
_OTHER_VALUES = np.random.default_rng(77).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_ENTRY = "suffix binary, left binary, k1 long, k2 long, first long, n long, size long"
_WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("at", "<i8")])


def places(data: bytes, width: int, gram: int) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray]:
    h = Hashes(BYTE_VALUES[np.frombuffer(data, np.uint8)])
    return h, *anchor_places(h, width, gram)


def _told(k1, k2, first, n) -> pa.RecordBatch:
    """Stretches of repeated windows: n of them from ``first``."""
    m = len(k1)
    cols = [pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), *(pa.array(x, pa.int64()) for x in (k1, k2, first, n)), pa.array([0] * m, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["suffix", "left", "k1", "k2", "first", "n", "size"])


class _Classes:
    """Equal entries met so far: the first of each is kept, the others are told at once."""

    def __init__(self):
        self.seen: dict[tuple[bytes, bytes], list] = {}
        self.out: list[tuple] = []
        self.bytes = 0

    def add(self, suffix: bytes, left: bytes, k1: int, k2: int, first: int, n: int) -> None:
        met = self.seen.get((suffix, left))
        if met is None:
            self.seen[suffix, left] = [k1, k2, first, n, False]
            self.bytes += len(suffix) + len(left)
            return
        if tuple(met[:3]) == (k1, k2, first):  # the same place of an equal text
            return
        if not met[4]:
            met[4] = True
            self._tell(*met[:4])
        self._tell(k1, k2, first, n)

    def _tell(self, k1: int, k2: int, first: int, n: int) -> None:
        last = self.out[-1] if self.out else None
        if last and last[:2] == (k1, k2) and last[2] + last[3] == first:
            self.out[-1] = (k1, k2, last[2], last[3] + n)
        else:
            self.out.append((k1, k2, first, n))

    def told(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            yield _told(*zip(*self.out, strict=True))
        self.out = []

    def entries(self) -> Iterator[pa.RecordBatch]:
        yield from self.told()
        if self.seen:
            yield _entries([(s, x, *m[:4]) for (s, x), m in self.seen.items()])
        self.seen, self.bytes = {}, 0


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*cols, pa.array([len(r[0]) + len(r[1]) for r in rows], pa.int64())], names=["suffix", "left", "k1", "k2", "first", "n", "size"])


def _anchors(src: DataFrame, width: int, gram: int) -> DataFrame:
    """``(g, k1, ord)`` of each anchor; ``ord`` -1 and ``k2`` as ``g`` for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, k, o = [], [], []
            for data, k1, k2 in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, at, _, _ = places(data.as_buffer(), width, gram)
                g += [h.some(at, at + gram).view(np.int64), np.array([k2])]
                k.append(np.full(len(at) + 1, k1))
                o += [np.arange(len(at), dtype=np.int32), np.array([-1], np.int32)]
            if g:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (g, k, o)], names=["g", "k1", "ord"])

    return map_arrow(src, run, "g long, k1 long, ord int")


def _enter(texts: DataFrame, width: int, gram: int, run_bytes: int) -> DataFrame:
    """Entries, and stretches told already, of ``(data, k1, k2, ords)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, before = _Classes(), None
        for b in batches:
            for data, k1, k2, ords in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if (k1, k2) == before:
                    continue
                before = (k1, k2)
                data = data.as_buffer().to_pybytes()
                _, at, first, last = places(data, width, gram)
                mine = np.sort(ords.values.to_numpy())
                mine = mine[mine < len(at)]
                for a, f, x in zip(at[mine].tolist(), first[mine].tolist(), last[mine].tolist(), strict=True):
                    classes.add(data[a : x + width], data[f:a][::-1], k1, k2, f, x - f + 1)
                if classes.bytes >= run_bytes:
                    yield from classes.entries()
            yield from classes.told()
        yield from classes.entries()

    return map_arrow(texts, run, _ENTRY)


class _Range:
    """Distinct entries of one range, side by side."""

    def __init__(self, rows: list[tuple], width: int, gram: int):
        self.rows, self.width, self.gram = rows, width, gram
        self.data = np.frombuffer(b"".join([*(left[::-1] + suffix for suffix, left, *_ in rows), bytes(16)]), np.uint8)
        # The eight bytes from any place as one number that orders as they do.
        self.words = np.ndarray(len(self.data) - 7, ">u8", self.data, strides=(1,))
        left = np.array([len(r[1]) for r in rows], np.int64)
        self.left, self.right = left, np.array([len(r[0]) for r in rows], np.int64)
        size = self.left + self.right
        self.at = np.cumsum(size) - size + left  # where suffixes start
        self.n = np.array([r[5] for r in rows], np.int64)
        self.first = np.array([r[4] for r in rows], np.int64)

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order, and where in it groups of equal leading bytes start."""
        keep = np.array([0] + [(1 << 64) - (1 << (64 - 8 * k)) for k in range(1, 9)], dtype=np.uint64)

        def fetch(items: np.ndarray, depth: np.ndarray) -> np.ndarray:
            rest = self.right[items] - 8 * depth
            return self.words[self.at[items] + np.minimum(8 * depth, self.right[items])].astype(np.uint64) & keep[np.clip(rest, 0, 8)]

        order, _ = multikey_quicksort(fetch, len(self.rows), -(-int(self.right.max()) // 8))
        lead = self.data[self.at[order][:, None] + np.arange(self.gram)]
        return order, np.concatenate([[0], np.flatnonzero((lead[1:] != lead[:-1]).any(axis=1)) + 1])

    def repeated(self, entries: np.ndarray, group: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(entry, first, n)``: stretches of windows of ``entries`` that are equal to another one of their group."""
        n, base = self.n[entries], np.cumsum(self.n[entries]) - self.n[entries]
        hit = np.zeros(int(n.sum()), bool)
        # Equal windows have their anchor at the same place, so they are compared by that place, some at a time.
        most, least = self.left[entries], self.left[entries] - n + 1
        lo = int(least.min())
        while lo <= int(most.max()):
            hi, total = lo, 0
            while hi <= int(most.max()) and (hi == lo or total < chunk):
                total += int(((least <= hi) & (most >= hi)).sum())
                hi += 1
            a, z = np.maximum(least, lo), np.minimum(most, hi - 1)
            some = np.flatnonzero(z >= a)
            size = (z - a + 1)[some]
            owner, place = np.repeat(some, size), spread(a[some], size)  # place: bytes from the window's start to its anchor
            start = self.at[entries][owner] - place
            order, begin = multikey_quicksort(lambda i, d: self.words[start[i] + np.minimum(8 * d, self.width - 8)], len(start), -(-self.width // 8), group[owner] * (self.width + 1) + place)
            times = np.diff(np.append(begin, len(order)))
            same = order[np.repeat(times > 1, times)]
            hit[base[owner[same]] + most[owner[same]] - place[same]] = True
            lo = hi
        at = np.flatnonzero(hit)
        owner = np.searchsorted(base, at, side="right") - 1
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner) != 0)]) if len(at) else np.empty(0, bool)
        begin = np.flatnonzero(new)
        return entries[owner[begin]], self.first[entries[owner[begin]]] + at[begin] - base[owner[begin]], np.diff(np.append(begin, len(at)))


def _settle(entries: DataFrame, width: int, gram: int, chunk: int) -> DataFrame:
    """Each range sorted and compared: stretches told, and the entries of its first and last group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes()
        for b in batches:
            for row in zip(*[b.column(i).to_pylist() for i in range(6)], strict=True):
                classes.add(*row)
            yield from classes.told()
        rows = [(s, x, *m[:4]) for (s, x), m in classes.seen.items()]
        if not rows:
            return
        part = _Range(rows, width, gram)
        order, begin = part.sort()
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        edge = (group == 0) | (group == group[-1])
        inner = ~edge & (np.bincount(group)[group] > 1)
        if inner.any():
            who, first, n = part.repeated(order[inner], group[inner], chunk)
            if len(who):
                keys = [np.array([rows[i][k] for i in who.tolist()], np.int64) for k in (2, 3)]
                yield _told(*keys, first, n)
        ends = [rows[i] for i in order[edge].tolist()]
        for i in range(0, len(ends), 5000):
            yield _entries(ends[i : i + 5000])

    return map_arrow(entries.select("suffix", "left", "k1", "k2", "first", "n"), run, _ENTRY)


def _across(edges: DataFrame, width: int, gram: int, buckets: int, chunk: int) -> DataFrame:
    """Stretches told of entries whose group may lie in several ranges, by the hashes of their windows."""

    def equal(e: np.ndarray) -> tuple[np.ndarray, list[pa.RecordBatch]]:
        """Sorted windows, the first of each class, and what is told of classes of several places."""
        e = np.unique(e)  # a text's own place counts once
        new = np.concatenate([[True], (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])])
        times = np.diff(np.append(np.flatnonzero(new), len(e)))
        told = np.sort(e[np.repeat(times > 1, times)], order=["k1", "k2", "at"])
        out = []
        if len(told):
            cut = np.concatenate([[True], (told["k1"][1:] != told["k1"][:-1]) | (told["k2"][1:] != told["k2"][:-1]) | (told["at"][1:] != told["at"][:-1] + 1)])
            t, n = told[cut], np.diff(np.append(np.flatnonzero(cut), len(told)))
            out.append(_told(t["k1"], t["k2"], t["at"], n))
        return e[new], out

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            first, told = equal(np.concatenate(held))
            for t in told:
                yield pa.RecordBatch.from_arrays([pa.nulls(t.num_rows, pa.int32()), pa.nulls(t.num_rows, pa.binary()), *(t.column(i) for i in (2, 3, 4, 5))], names=["bucket", "payload", "k1", "k2", "first", "n"])
            bucket = (first["h1"] >> np.uint64(32)).astype(np.int64) * buckets >> 32
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1])
            packed = [first[a:z].tobytes() for a, z in zip(cuts, np.append(cuts[1:], len(first)), strict=True)]
            none = pa.nulls(len(packed), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(packed, pa.binary()), none, none, none, none], names=["bucket", "payload", "k1", "k2", "first", "n"])

        held, n = [], 0
        for b in batches:
            for suffix, left, k1, k2, first in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                x = np.frombuffer(left[::-1] + suffix, np.uint8)
                e = np.empty(len(x) - width + 1, _WINDOW)
                # The place of the anchor is part of the key: windows of one gram only meet where it is the same.
                lead = np.uint64(len(left)) - np.arange(len(e), dtype=np.uint64)
                e["h1"] = Hashes(BYTE_VALUES[x]).every(width)
                e["h2"] = Hashes(_OTHER_VALUES[x]).every(width) ^ lead
                e["k1"], e["k2"], e["at"] = k1, k2, first + np.arange(len(e))
                held.append(e)
                n += len(e)
                if n >= chunk:
                    yield from close(held)
                    held, n = [], 0
        if held:
            yield from close(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != at and held:
                    yield from equal(np.concatenate(held))[1]
                    held = []
                at = bucket
                held.append(np.frombuffer(payload, _WINDOW))
        if held:
            yield from equal(np.concatenate(held))[1]

    rows = materialize(map_arrow(edges.select("suffix", "left", "k1", "k2", "first"), hashed, "bucket int, payload binary, k1 long, k2 long, first long, n long"), "suffix-edges")
    sent = rows.where("bucket IS NOT NULL").select("bucket", "payload").repartition("bucket").sortWithinPartitions("bucket")
    return rows.where("bucket IS NULL").select("k1", "k2", "first", "n").unionByName(map_arrow(sent, merge, _ENTRY).select("k1", "k2", "first", "n"))


def repeats(texts: DataFrame, width: int = WIDTH, gram: int | None = None, range_bytes: int = RANGE_BYTES, run_bytes: int = RUN_BYTES, chunk: int = CHUNK) -> DataFrame:
    """``(k1, k2, spans)`` of texts ``(data, k1, k2)``: stretches ``(first, n)`` of windows that start elsewhere too.

    A text that occurs more than once has the stretch (0, -1): all of it.
    """
    gram = gram or max(1, min(GRAM, width // 2))
    if width < 8:
        raise ValueError("a repeat has at least 8 bytes")
    spark = texts.sparkSession
    texts = texts.where(F.octet_length("data") >= width)
    anchors = materialize(_anchors(texts, width, gram), "suffix-anchors")
    copies = anchors.where("ord < 0").groupBy("k1", "g").count().where("count > 1").select("k1", F.col("g").alias("k2"), F.lit(0).cast("long").alias("first"), F.lit(-1).cast("long").alias("n"))
    anchors = anchors.where("ord >= 0")
    place = F.xxhash64("k1", "ord")
    # Written, so that both sides of the join are shuffled for it and Spark can split a gram that is everywhere.
    again = materialize(anchors.groupBy("g").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("g"), "suffix-again")
    lists = anchors.join(again, "g", "left_semi").groupBy("k1").agg(F.collect_set("ord").alias("ords"))
    rows = materialize(_enter(texts.join(lists, "k1").select("data", "k1", "k2", "ords"), width, gram, run_bytes), "suffix-entries")
    entries = rows.where("suffix IS NOT NULL")
    held = rows.agg(F.sum("size")).first()[0] or 0
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(few, held // (range_bytes // 8)), -(-held // range_bytes))
    # Splitters are sampled leading bytes; a group that is hot is cut by a hash of the entry, so equal entries still meet.
    ranges = entries.repartitionByRange(int(parts), F.substring("suffix", 1, gram), F.xxhash64("suffix", "left"))
    settled = materialize(_settle(ranges, width, gram, chunk), "suffix-ranges")
    across = _across(settled.where("suffix IS NOT NULL"), width, gram, 4 * few, chunk)
    told = [x.where("suffix IS NULL").select("k1", "k2", "first", "n") for x in (rows, settled)]
    spans = copies.unionByName(told[0]).unionByName(told[1]).unionByName(across)
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, text_col: str = "text", as_text: bool = False, **tuning) -> DataFrame:
    """``docs`` without its text, with ``n_bytes, n_removed, n_spans, kept, spans array<struct<start, end>>``.

    ``kept`` is the bytes that stay, concatenated; a cut may fall inside a
    character. With ``as_text`` it is a string, and characters cut in part go.
    """
    out = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "string" if as_text else "binary", "spans": "array<struct<start:long,end:long>>"}
    kept_cols = [c for c in docs.columns if c != text_col and c not in out]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    # Two independent hashes are a text's key: XXH64 with two seeds.
    src = docs.select(F.struct(F.lit(0).alias("0"), *[F.col(quoted(c)) for c in kept_cols]).alias("row"), F.encode(text, "UTF-8").alias("data"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    rows = src.join(repeats(src.select("data", "k1", "k2"), width, **tuning), ["k1", "k2"], "left").select("row", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, spans, kept, where = [], [], [], [], []
            for data, s in zip(b.column(1), b.column(2), strict=True):
                data = data.as_buffer().to_pybytes()
                size.append(len(data))
                if not s.is_valid:
                    gone.append(0)
                    spans.append(0)
                    kept.append(data)
                    where.append([])
                    continue
                first, n = (s.values.field(i).to_numpy() for i in (0, 1))
                whole = (n < 0).any() and len(data) >= width
                mark = np.ones(len(data), bool) if whole else covered(len(data), first, first + n - 1, width)
                a, z = as_runs(np.flatnonzero(mark))
                gone.append(int(mark.sum()))
                spans.append(len(a))
                where.append([{"start": int(x), "end": int(y) + 1} for x, y in zip(a, z, strict=True)])
                raw = np.frombuffer(data, np.uint8)
                if as_text:
                    character = np.cumsum((raw & 0xC0) != 0x80) - 1
                    mark = np.bincount(character[mark], minlength=int(character[-1]) + 1)[character] > 0
                kept.append(raw[~mark].tobytes())
            cols = [pa.array(x, pa.int64()) for x in (size, gone, spans)]
            cols.append(pa.array(kept, pa.binary()).cast(pa.string()) if as_text else pa.array(kept, pa.binary()))
            cols.append(pa.array(where, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(b.column(0).flatten()[1:] + cols, names=[*kept_cols, *out])

    return map_arrow(rows, run, schema_of(docs.select(*map(quoted, kept_cols)), kept_cols, out))


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
