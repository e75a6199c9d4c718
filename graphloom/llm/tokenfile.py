"""Token-id files with Elias-Fano document boundaries.

A table of documents becomes files of segments. A segment is one binary value
that stands alone: a header, the ids of its documents concatenated in ascending
doc_id order, and their boundaries as an Elias-Fano sequence: the low bits of
each offset packed, the high bits in unary, and the rank of every 64th set bit
so that one offset is found by a short scan (``select``). That takes about
2 + log2(ids per document) bits a document instead of a 64-bit table.

The doc_ids are kept in the segment in the same form.

Segments are rows ``(part, seq, n_docs, n_ids, before, segment)`` of Parquet
files: Spark's writer commits them on any store and a lost executor only
repeats its own. Parts are ranges of doc_id, so (part, seq) is file order.

Null texts are empty documents: only the end id. Null doc_ids come first,
repeated ones are kept, ordered by their ids. A text of any length is one
document of one segment; a task holds a segment and the next document. An empty
table gives no segments. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Recent, map_arrow, worker_state
from graphloom.session import materialize

MAGIC = b"GLTOKEF2"
#: magic, id width, low bits of ends, low bits of doc_ids, select step, documents, documents without an id, ids, bytes of high bits of both, first doc_id
HEAD = struct.Struct("<8sBBBHIIQQQq")
STEP = 64
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
CACHE = 250_000
#: Bytes of ids that a part of the file holds at most on average.
PART_BYTES = 32 << 20


# --- Elias-Fano -------------------------------------------------------------


def ef_encode(ends: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """``(low bit width, low bits, high bits, select samples)`` of an ascending sequence within 0..universe."""
    n = len(ends)
    low = max(0, int(universe // max(n, 1)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    lows = ((ends[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.empty((n, 0), np.uint8)
    places = (ends >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
    high[places] = 1
    return low, np.packbits(lows.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), places[::STEP].astype("<u4").tobytes()


class EliasFano:
    """Reads a sequence back: all of it, or one element by select."""

    def __init__(self, n: int, low: int, lows: bytes, high: bytes, samples: bytes):
        self.n, self.low = n, low
        self._lows = np.frombuffer(lows, np.uint8)
        self._high = np.frombuffer(high, np.uint8)
        self._samples = np.frombuffer(samples, "<u4")

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self._high, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self._lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low).astype(np.uint64)
            out |= (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out.view(np.int64)

    def select(self, i: int) -> int:
        """Element ``i``: from the sample before it, over at most the bits of STEP elements."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self._samples[i // STEP]), i % STEP
        byte = at >> 3
        bits = int(self._high[byte]) >> (at & 7) << (at & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self._high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + ((bits & -bits).bit_length() - 1)
        value = (place - i) << self.low
        for k in range(self.low):
            bit = i * self.low + k
            value |= ((int(self._lows[bit >> 3]) >> (bit & 7)) & 1) << k
        return value


# --- segments ---------------------------------------------------------------


def write_segment(ids: list[np.ndarray], doc_ids: list[int | None] = ()) -> bytes:
    """``doc_ids`` ascend, those that are null first; they are an Elias-Fano sequence too."""
    ends = np.cumsum([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    low, *bounds = ef_encode(ends, int(ends[-1]) if len(ends) else 0)
    named = [x for x in doc_ids if x is not None]
    first = named[0] if named else 0
    name_low, *names = ef_encode(np.array([x - first for x in named], dtype=np.uint64), named[-1] - first if named else 0)
    head = HEAD.pack(MAGIC, width, low, name_low, STEP, len(ids), len(ids) - len(named), len(flat), len(bounds[1]), len(names[1]), first)
    return b"".join([head, *bounds, *names, flat.astype(f"<u{width}").tobytes()])


def _parts(data: bytes) -> tuple[EliasFano, EliasFano, int, np.ndarray]:
    magic, width, low, name_low, step, n, nameless, n_ids, high, name_high, first = HEAD.unpack_from(data)
    if magic != MAGIC or step != STEP:
        raise ValueError("not a token segment")
    at, found = HEAD.size, []
    for k, bits, size in ((n, low, high), (n - nameless, name_low, name_high)):
        parts = []
        for length in (-(-k * bits // 8), size, 4 * -(-k // STEP)):
            parts.append(data[at : at + length])
            at += length
        found.append(EliasFano(k, bits, *parts))
    return found[0], found[1], first, np.frombuffer(data, f"<u{width}", n_ids, at)


def read_segment(data: bytes) -> tuple[EliasFano, np.ndarray]:
    """The ends of its documents and all their ids."""
    bounds, _, _, ids = _parts(data)
    return bounds, ids


def doc_ids_of(data: bytes) -> list[int | None]:
    bounds, names, first, _ = _parts(data)
    return [None] * (bounds.n - names.n) + [first + names.select(i) for i in range(names.n)]


# --- encoding ---------------------------------------------------------------


def _stand_ins() -> list[str]:
    """Byte-level vocabularies write a byte as its Latin-1 character, or, where that is blank or a control, as the next one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


_STAND_INS = _stand_ins()


def _bounds(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)


def spread_runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class WordEncoder:
    """The tokenizers library, asked once for each distinct word.

    Valid for tokenizers that drop white space and never join across it. Latin
    text (up to U+017F) is also lower-cased and split between letters and other
    characters, where the tokenizer does both: ``split_letters``. A run of
    letters then goes to the model as its bytes' printable stand-ins.
    """

    _other = "[^\x00-\u017f]|\u0130|'|<[|]"
    _letters = re.compile("[a-zªµºß-öø-ſ]+")

    def __init__(self, path: str, split_letters: bool = True):
        # A worker has one core; threads of the library would each keep memory.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.split_letters = split_letters
        self.width = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self._known = Recent(CACHE)

    def _runs(self, words: pa.Array) -> pa.Array:
        """What the model is asked for: a word's runs of letters and of others, lower-cased, where the tokenizer splits so."""
        if not self.split_letters:
            return pc.ascii_split_whitespace(words)
        cut = pc.replace_substring_regex(pc.utf8_lower(words), f"({self._letters.pattern})", r" \1 ")
        return pc.ascii_split_whitespace(pc.utf8_trim(pc.if_else(pc.match_substring_regex(words, self._other), words, cut), " "))

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words: letters go to the model at once, others joined by spaces and told apart by their offsets."""
        known: dict[str, bytes] = {}
        rest, kind, tokenize = [], "H" if self.width == "<u2" else "I", self.tok.model.tokenize
        for w in words:
            if self.split_letters and self._letters.fullmatch(w) and w == w.lower():
                seen = w if w.isascii() else "".join([_STAND_INS[b] for b in w.encode()])
                known[w] = array(kind, [t.id for t in tokenize(seen)]).tobytes()
            elif w.isascii() or len(w.lower()) == len(w) and is_normalized("NFC", w):
                rest.append(w)
            else:  # normalising changes its length, and offsets with it
                known[w] = np.array(self.tok.encode(w, add_special_tokens=False).ids, dtype=self.width).tobytes()
        for at in range(0, len(rest), 400):
            some = rest[at : at + 400]
            got = self.tok.encode(" ".join(some), add_special_tokens=False)
            begins = np.cumsum([0] + [len(w) + 1 for w in some[:-1]])
            owner = np.searchsorted(begins, np.array([o[0] for o in got.offsets], dtype=np.int64), side="right") - 1
            cuts = np.searchsorted(owner, np.arange(len(some) + 1))
            ids = np.array(got.ids, dtype=self.width)
            known.update((w, ids[a:b].tobytes()) for w, a, b in zip(some, cuts, cuts[1:], strict=False))
        return known

    def encode_many(self, texts: pa.Array, end_id: int | None = None) -> Iterator[np.ndarray]:
        """Ids of each text. Arrow splits texts and tells words apart; each distinct run of a word is looked up once a batch."""
        words = pc.ascii_split_whitespace(texts)
        seen = words.values.dictionary_encode()
        runs = self._runs(seen.dictionary)
        coded = runs.values.dictionary_encode()
        asked = coded.dictionary.to_pylist()
        ids = self._known.get_all(asked)
        new = self._learn([r for r, x in zip(asked, ids, strict=True) if x is None])
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = new[asked[i]]
                if len(asked[i]) <= 64:
                    self._known.put(asked[i], ids[i])
        ids.append(b"" if end_id is None else np.array([end_id], dtype=self.width).tobytes())
        # Occurrences of words, then of runs, then ids; after each text the end.
        cuts = words.offsets.to_numpy().astype(np.int64)
        begin, size = _bounds(runs.offsets.to_numpy())
        word = np.insert(seen.indices.to_numpy().astype(np.int64), cuts[1:], len(begin))
        begin, size = np.append(begin, len(coded)), np.append(size, 1)
        run = np.append(coded.indices.to_numpy().astype(np.int64), len(ids) - 1)[spread_runs(begin[word], size[word])]
        text_ends = np.cumsum(size[word])[cuts[1:] + np.arange(len(texts))]  # in runs
        pool = np.frombuffer(b"".join(ids), dtype=self.width)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // pool.itemsize
        begin, size = (np.cumsum(size) - size)[run], size[run]
        out = pool[spread_runs(begin, size)]
        ends = np.cumsum(size)[text_ends - 1].tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            yield out[a:b]

    def encode(self, text: str, end_id: int | None = None) -> np.ndarray:
        return next(self.encode_many(pa.array([text], pa.string()), end_id))


def _encoder(tokenizer: str) -> WordEncoder:
    return worker_state("tokens", tokenizer, make=lambda: WordEncoder(tokenizer))


def token_segments(docs: DataFrame, tokenizer: str, end_id: int | None = 1, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the files, for ``df.write.parquet``; ``part`` is a range of doc_id.

    Texts are encoded where they lie; only their ids, two bytes each, are sent to the part they belong to.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            ids = [x.tobytes() for x in enc.encode_many(b.column(1), end_id)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "size", "ids"])

    coded = materialize(map_arrow(src, encode, "doc_id long, size long, ids binary"), "token-ids")
    if parts is None:
        held = coded.agg(F.sum("size")).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // PART_BYTES))
    rows = coded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids").select(F.spark_partition_id().alias("part"), "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _encoder(tokenizer).width
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        held = seq = part = before = 0

        def close() -> pa.RecordBatch:
            cols = [(part, pa.int32()), (seq, pa.int32()), (len(ids), pa.int64()), (held, pa.int64()), (before, pa.int64()), (write_segment(ids, names), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cols], names=["part", "seq", "n_docs", "n_ids", "before", "segment"])

        for b in batches:
            part = b.column(0)[0].as_py() if b.num_rows else part
            for doc_id, got in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                ids.append(np.frombuffer(got.as_buffer(), dtype=width))
                names.append(doc_id)
                held += len(ids[-1])
                if held >= SEGMENT_IDS:
                    yield close()
                    before += held
                    ids, names, held, seq = [], [], 0, seq + 1
        if ids:
            yield close()

    return map_arrow(rows, run, "part int, seq int, n_docs long, n_ids long, before long, segment binary")


def read_documents(segments: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in written segments.

    A segment knows what its part holds before it; the sums of the parts, one row
    for each, are added up by the driver. The segments themselves aren't shuffled.
    """
    sums = sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    ahead = np.concatenate([[0], np.cumsum([r.n for r in sums], dtype=np.int64)]).tolist()
    starts = segments.sparkSession.createDataFrame([(r.part, a) for r, a in zip(sums, ahead, strict=False)], "part int, ahead long")
    src = segments.join(F.broadcast(starts), "part").select((F.col("ahead") + F.col("before")).alias("start"), "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bounds, ids = read_segment(data)
                ends = [bounds.select(i) for i in range(bounds.n)]
                begins = [0, *ends[:-1]]
                raw = ids.astype("<u4")
                crc = [zlib.crc32(raw[a:e]) for a, e in zip(begins, ends, strict=True)]
                size = [e - a for a, e in zip(begins, ends, strict=True)]
                cols = [pa.array(x, pa.int64()) for x in (doc_ids_of(data), [start + a for a in begins], size, crc)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(src, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(data: bytes, i: int) -> np.ndarray:
    """Ids of document ``i`` of a segment, found by two selects."""
    bounds, ids = read_segment(data)
    return ids[bounds.select(i - 1) if i else 0 : bounds.select(i)]
