"""Repeated windows of token sequences: the part that suffix and substring dedup share.

A window is ``width`` consecutive tokens of one document. Every window holds at
least one gram of ``gram`` tokens; its anchor is the leftmost gram with the
lowest hash. Equal windows have their anchor at the same place, so a window
can only repeat where its anchor's gram repeats. Each anchor owns a run of
consecutive windows ``first..last``; with hashes pseudo-random there is one
anchor for about (width - gram) / 2 tokens, and only anchors are compared
between documents.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20  # windows whose anchors are found at once; places in it fit 24 bits
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
#: One 64-bit value for each byte.
BYTE_VALUES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        out = np.full(max(n, 1 << 12) * 2, _BASE if kind == "up" else _INV, dtype=np.uint64)
        out[0] = 1
        _powers[kind] = np.multiply.accumulate(out)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits (fixed values: the multipliers of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of any stretch of ``tokens`` (uint64 values) modulo 2^64."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        self.n = n
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(tokens * _power("up", n), out=self.sums[1:])

    def every(self, width: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Of the stretches of one width that start at ``lo..hi-1``."""
        hi = self.n - width + 1 if hi is None else hi
        if hi <= lo:
            return np.empty(0, np.uint64)
        return mix((self.sums[lo + width : hi + width] - self.sums[lo:hi]) * _power("down", hi)[lo:])

    def some(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * _power("down", self.n + 1)[begin] + (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchor_places(h: Hashes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(at, first, last)`` of each anchor of a document: where its gram starts, and its windows."""
    total = h.n - width + 1
    if total <= 0:
        none = np.empty(0, np.int64)
        return none, none, none
    w, place = width - gram + 1, np.uint64(0xFFFFFF)
    firsts, at = [], []
    for lo in range(0, total, _CHUNK):
        hi = min(total, lo + _CHUNK)
        g = h.every(gram, lo, hi + w - 1)
        best = (sliding_min((g & ~place) | np.arange(len(g), dtype=np.uint64), w) & place).astype(np.int64)
        new = np.concatenate([[0], np.flatnonzero(np.diff(best)) + 1])
        firsts.append(new + lo)
        at.append(best[new] + lo)
    first, at = np.concatenate(firsts), np.concatenate(at)
    return at, first, np.concatenate([first[1:], [total]]) - 1


def anchors(h: Hashes, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(gram hash, context hash, first, last)`` of each anchor of a document.

    The context is all that the anchor's windows cover: two anchors with equal
    grams and contexts own equal windows.
    """
    at, first, last = anchor_places(h, width, gram)
    if not len(at):
        return at.view(np.uint64), at.view(np.uint64), at, at
    return h.some(at, at + gram), h.some(first, last + width) ^ mix((at - first).astype(np.uint64)), first, last


def spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places first..last of each run, in order."""
    size = last - first + 1
    return np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def covered(n: int, first: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` tokens a window that starts in one of the runs covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.minimum(last + width, n), -1)
    return np.cumsum(edge[:n]) > 0


def as_runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct places as runs ``(first, last)``."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) > 1)
    return places[np.concatenate([[0], cut + 1])], places[np.concatenate([cut, [len(places) - 1]])]
