"""Media columns: WAV bytes, short-time spectra and spectral-peak pair fingerprints.

``write_wav`` turns a text column into a binary column that holds a complete
8-bit mono WAV file; ``read_wav`` reads such a column with the wave module and
returns the samples and their landmarks. Both are row-wise over Arrow batches:
no shuffle, memory bounded by one batch.

The end is filled with silence to a whole number of hops, so every sample is in
a frame. A payload of one frame has no later one: its peaks are paired within.

Nulls and empty texts are 64 zero bytes. Equal texts, and so repeated rows, give
equal files and landmarks; a null doc_id is of no account. A text of any length
is one file, transformed some frames at a time. An empty table gives an empty
one. Extra columns pass through untouched, whatever their names; those made here
win over others of the same name.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_arrow, quoted, schema_of

BLOCK = 64
RATE = 8000
FRAME = 256
HOP = 128
#: Each frame's strongest bin in each of these ranges of rfft bins is a peak.
BANDS = ((1, 10), (10, 20), (20, 40), (40, 80), (80, 129))
#: A peak is paired with the peaks of so many later frames.
FAN_OUT = 3


def pad(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b"\0")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getsampwidth(), r.getnchannels()) != (1, 1):
            raise ValueError("expected 8-bit mono samples")
        return r.readframes(r.getnframes()), r.getframerate()


_window = np.hanning(FRAME + 2)[1:-1].astype(np.float32)  # no weight is 0
_CHUNK = 2048  # frames of one transform


def spectrum_peaks(samples: np.ndarray) -> np.ndarray:
    """frames x bands: each band's strongest bin, -1 where the frame is silent there."""
    x = samples.astype(np.float32) - 128.0
    x = np.pad(x, (0, FRAME + max(0, -(-(len(x) - FRAME) // HOP)) * HOP - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    peaks = np.empty((len(frames), len(BANDS)), dtype=np.int64)
    for at in range(0, len(frames), _CHUNK):
        power = np.abs(np.fft.rfft(frames[at : at + _CHUNK] * _window, axis=1)) ** 2
        for b, (lo, hi) in enumerate(BANDS):
            part = power[:, lo:hi]
            best = part.argmax(axis=1)
            loud = part[np.arange(len(part)), best] > 1e-6
            peaks[at : at + len(part), b] = np.where(loud, best + lo, -1)
    return peaks


def landmarks(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs of peaks as int64: frame << 24 | bin << 16 | later bin << 8 | frames between.

    In a lone frame a peak is paired with those of higher bands, 0 frames on.
    """
    peaks = spectrum_peaks(samples)
    found = []
    if len(peaks) == 1:
        lo, hi = np.triu_indices(len(BANDS), 1)
        a, b = peaks[0, lo], peaks[0, hi]
        found.append(((a << 16) | (b << 8))[(a >= 0) & (b >= 0)])
    for dt in range(1, FAN_OUT + 1):
        if len(peaks) > dt:
            a, b = peaks[:-dt], peaks[dt:]
            t = np.arange(len(a), dtype=np.int64)[:, None]
            code = (t << 24) | (a << 16) | (b << 8) | dt
            found.append(code[(a >= 0) & (b >= 0)])
    return np.sort(np.concatenate(found)) if found else np.empty(0, dtype=np.int64)


def write_wav(docs: DataFrame, text_col: str = "text", out_col: str = "media", rate: int = RATE) -> DataFrame:
    """``docs`` without its text, with a WAV file of the text's UTF-8 bytes and ``n_bytes``."""
    out = {"n_bytes": "long", out_col: "binary"}
    kept = [c for c in docs.columns if c != text_col and c not in out]
    src = docs.select(*map(quoted, kept), F.encode(F.coalesce(F.col(quoted(text_col)), F.lit("")), "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column(b.num_columns - 1).to_pylist()
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols += [pa.array([len(x) for x in data], pa.int64()), pa.array([to_wav(pad(x), rate) for x in data], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *out])

    return map_arrow(src, run, schema_of(src, kept, out))


def read_wav(table: DataFrame, media_col: str = "media") -> DataFrame:
    """What the stored files say: payload, digests and ``landmarks array<long>``; the media column itself goes."""
    out = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "landmarks": "array<long>"}
    kept = [c for c in table.columns if c != media_col and c not in out]
    src = table.select(*map(quoted, kept), F.col(quoted(media_col)).alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, sha, tail, msize, msha, marks = [], [], [], [], [], []
            for media in b.column(len(kept)):
                media = media.as_py()
                payload, _ = from_wav(media)
                size.append(len(payload))
                sha.append(hashlib.sha256(payload).hexdigest())
                tail.append(zlib.crc32(payload[-BLOCK:]))
                msize.append(len(media))
                msha.append(hashlib.sha256(media).hexdigest())
                marks.append(landmarks(np.frombuffer(payload, dtype=np.uint8)))
            ends = np.cumsum([0, *map(len, marks)])
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(marks) if marks else np.empty(0, np.int64)))
            cols = [b.column(i) for i in range(len(kept))]
            cols += [pa.array(size, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), pa.array(msize, pa.int64()), pa.array(msha), arrays]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, *out])

    return map_arrow(src, run, schema_of(src, kept, out))
