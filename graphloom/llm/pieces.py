"""SentencePiece merge-type (BPE) encoding by backtracking, and decoding.

An encoding is the one token sequence in which every two neighbours would stay
apart if their joined text were merged from scratch. So a text is encoded left
to right: Aho-Corasick gives the vocabulary entries that start at a position,
the longest is tried first, a candidate must be compatible with its left
neighbour (checked by re-merging the two, remembered per pair), and a position
from which no continuation exists is set in a bitfield and never tried again.

Pieces hold the space mark only at their start, and characters of no piece fall
back to bytes, so a text falls into independent segments at those places. Runs
of space marks all have one score, where only the leftmost merge decides: such
a segment is merged directly.

Null texts are empty. Texts of any length take memory in proportion. Repeated
rows give equal rows, an empty table an empty one; other columns pass through,
and those made here win over others of the same name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import Recent, map_arrow, quoted, schema_of, worker_state

SPACE = "▁"
#: Segments and pairs that a worker remembers before it starts over.
CACHE = 200_000


def utf8(text: str) -> str:
    """Its UTF-8 bytes as characters: an automaton over them has at most 256 edges at a node."""
    return text if text.isascii() else text.encode().decode("latin-1")


class PieceEncoder:
    def __init__(self, model_file: str):
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.piece = {i: p for p, i in self.ids.items()}
        self.alphabet = set("".join(self.ids))
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:  # others never come out of merging
                self.automaton.add_word(utf8(piece), (len(utf8(piece)), i))
        self.automaton.make_automaton()
        self.segment = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self._pairs: dict[int, bool] = {}
        self._segments, self._words = Recent(CACHE), Recent(CACHE)

    def merge(self, text: str) -> list[str]:
        """The pieces of ``text`` by merging: best score first, then leftmost."""
        score, parts = self.score, list(text)
        if len(parts) <= 24:
            while True:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    return parts
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (s := score.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (s := score.get(joined + parts[after[i]])) is not None:
                    heapq.heappush(heap, (-s, i, joined + parts[after[i]]))
            if before[i] >= 0 and (s := score.get(parts[before[i]] + joined)) is not None:
                heapq.heappush(heap, (-s, before[i], parts[before[i]] + joined))
        return [p for p in parts if p]

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces ``a`` and ``b`` stay as they are when their joined text is merged anew."""
        key = a << 20 | b
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            x, y = self.piece[a], self.piece[b]
            known = self._pairs[key] = self.merge(x + y) == [x, y]
        return known

    def backtrack(self, text: str) -> list[int]:
        """Ids of ``text``, all of whose characters are in the alphabet."""
        text = utf8(text)
        n = len(text)
        starts: list[list | None] = [None] * n
        for end, token in self.automaton.iter(text):
            at = end + 1 - token[0]
            if starts[at] is None:
                starts[at] = [token]
            else:
                starts[at].append(token)  # ends ascend, so the longest is last
        ids: list[int] = []
        steps: list[tuple[int, int]] = []
        pairs, failed, pos, prev = self._pairs, 0, 0, -1
        options = starts[0] or ()
        left = len(options)
        while pos < n:
            found = None
            while left:
                left -= 1
                size, i = options[left]
                if failed and (failed >> (pos + size)) & 1:
                    continue
                if prev < 0 or (ok if (ok := pairs.get(prev << 20 | i)) is not None else self.compatible(prev, i)):
                    found = i
                    break
            if found is not None:
                ids.append(found)
                steps.append((pos, left))
                prev = found
                pos += size
                if pos < n:
                    options = starts[pos] or ()
                    left = len(options)
            else:
                if not ids:
                    raise ValueError(f"no encoding of {text!r}")
                failed |= 1 << pos
                ids.pop()
                pos, left = steps.pop()
                options = starts[pos]
                prev = ids[-1] if ids else -1
        return ids

    def encode_segment(self, seg: str) -> list[int]:
        if self.alphabet.issuperset(seg):
            return self._run(seg)
        out: list[int] = []
        run = ""
        for c in seg:
            if c in self.alphabet:
                run += c
                continue
            out += self._run(run)
            run = ""
            out += self._bytes(c)
        return out + self._run(run)

    def _run(self, run: str) -> list[int]:
        return [] if not run else self._by_merging(run) if run.startswith(SPACE + SPACE) else self._known(run)

    def _known(self, run: str) -> list[int]:
        try:
            return self.backtrack(run)
        except ValueError:  # a character that only longer pieces hold
            return list(self._by_merging(run))

    def _by_merging(self, run: str) -> list[int]:
        out: list[int] = []
        for p in self.merge(run):
            out += [self.ids[p]] if p in self.ids else self._bytes(p)
        return out

    def _bytes(self, text: str) -> list[int]:
        return [self.byte_ids[x] for x in text.encode("utf-8", "replace")]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, with the mark that this model puts before it."""
        return self._spell(SPACE + text.replace(" ", SPACE)) if text else []

    def _spell(self, text: str) -> list[int]:
        if "\n" not in text and SPACE not in text[1:]:
            return self.encode_segment(text)
        segs = self.segment.findall(text)
        ids = self._segments.get_all(segs)
        for k, x in enumerate(ids):
            if x is None:
                ids[k] = tuple(self.encode_segment(segs[k]))
                if len(segs[k]) <= 64:
                    self._segments.put(segs[k], ids[k])
        return list(chain.from_iterable(ids))

    def encode_many(self, texts: pa.Array, digest: bool = False) -> Iterator[tuple[np.ndarray, bytes]]:
        """Ids of each text and, with ``digest``, their decimals joined by commas.

        A word after a single space is the same segments wherever it stands, so
        Arrow splits the texts and each distinct word is encoded once a batch.
        Texts with runs of spaces are encoded as a whole.
        """
        words = pc.split_pattern(texts, " ")
        cuts = words.offsets.to_numpy()
        coded = words.values.dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self._words.get_all(distinct)
        for i, (w, x) in enumerate(zip(distinct, known, strict=True)):
            if x is None:
                ids = self._spell(SPACE + w)
                x = known[i] = (array("i", ids).tobytes(), ",".join(map(str, ids)).encode())
                if len(w) <= 64:
                    self._words.put(w, x)
        gaps = np.flatnonzero(which == distinct.index("")) if "" in distinct else np.empty(0, np.int64)
        apart = set((np.searchsorted(cuts, gaps, side="right") - 1).tolist())
        for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
            if k in apart:
                ids = self.encode(texts[k].as_py())
                yield np.array(ids, dtype=np.int32), ",".join(map(str, ids)).encode() if digest else b""
                continue
            mine = [known[i] for i in which[a:b].tolist()]
            yield np.frombuffer(b"".join([x[0] for x in mine]), dtype=np.int32), b",".join([x[1] for x in mine]) if digest else b""

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


def encoder(model_file: str) -> PieceEncoder:
    """One for each Python worker and model."""
    return worker_state("pieces", model_file, make=lambda: PieceEncoder(model_file))


def decoder(model_file: str) -> sentencepiece.SentencePieceProcessor:
    """The library alone, for workers that only decode."""
    return worker_state("decode", model_file, make=lambda: sentencepiece.SentencePieceProcessor(model_file=model_file))


def encode_column(docs: DataFrame, model_file: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``out_col array<int>`` in place of the text."""

    def run(texts: pa.Array) -> list[pa.Array]:
        return [_lists([x for x, _ in encoder(model_file).encode_many(texts)])]

    return _map(docs, text_col, {out_col: "array<int>"}, run)


def decode_column(table: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The other way round; null ids give an empty text."""

    def run(lists: pa.Array) -> list[pa.Array]:
        decode = decoder(model_file).decode
        return [pa.array([decode(x) if x else "" for x in lists.to_pylist()], pa.string())]

    return _map(table, ids_col, {out_col: "string"}, run)


def encode_checked(docs: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids, n_tokens`` and whether decoding gives the text back, in place of the text: one pass, one worker."""

    def run(texts: pa.Array) -> list[pa.Array]:
        e = encoder(model_file)
        ids = [x for x, _ in e.encode_many(texts)]
        same = [(e.decode(x.tolist()) if len(x) else "") == t.as_py() for x, t in zip(ids, texts, strict=True)]
        return [_lists(ids), pa.array(map(len, ids), pa.int64()), pa.array(same, pa.bool_())]

    return _map(docs, text_col, {"ids": "array<int>", "n_tokens": "long", "round_trip": "boolean"}, run)


def round_trip(docs: DataFrame, model_file: str, text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding in one pass: ``n_tokens, ids_sha256, decoded_sha256`` in place of the text."""

    def run(texts: pa.Array) -> list[pa.Array]:
        e, rows = encoder(model_file), []
        for ids, named in e.encode_many(texts, digest=True):
            back = e.decode(ids.tolist()) if len(ids) else ""
            rows.append((len(ids), hashlib.sha256(named).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]

    return _map(docs, text_col, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, run)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    cuts = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def _map(df: DataFrame, col: str, out: dict[str, str], f) -> DataFrame:
    """``df`` with the columns ``out`` that ``f`` makes of a batch of ``col``, in its place; they win over others of the same name."""
    kept = [c for c in df.columns if c != col and c not in out]
    value = F.col(quoted(col)) if dict(df.dtypes)[col] != "string" else F.coalesce(F.col(quoted(col)), F.lit(""))
    src = df.select(*map(quoted, kept), value.alias("in"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.num_columns - 1
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(k)] + f(b.column(k)), names=[*kept, *out])

    return map_arrow(src, run, schema_of(src, kept, out))
