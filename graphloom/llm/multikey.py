"""Multikey quicksort of fixed or variable strings, eight bytes at a time, for all open segments at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one run after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def multikey_quicksort(fetch: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, depths: int, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(order, starts)`` of ``n`` strings: their sorted order, and where in it each class of equal strings starts.

    ``fetch(items, depth)`` gives the word of each string at a depth, as
    unsigned numbers that order as their bytes do; strings are compared up to
    ``depths`` words, within one ``group`` only. A segment of strings that agree
    so far is split three ways around the word of its middle string: the smaller
    and the larger part are compared at the same depth again, the equal part at
    the next. Segments of one string, and those that agree to the end, are done.
    """
    order = np.arange(n) if group is None else np.argsort(group, kind="stable")
    if not n:
        return order, np.empty(0, np.int64)
    cut = np.empty(0, np.int64) if group is None else np.flatnonzero(np.diff(group[order])) + 1
    begin = np.concatenate([[0], cut])
    size = np.diff(np.append(begin, n))
    done = [begin[size == 1]]
    begin, size = begin[size > 1], size[size > 1]
    depth = np.zeros(len(begin), np.int64)
    while len(begin):
        seg, at = np.repeat(np.arange(len(begin)), size), spread(begin, size)
        items = order[at]
        word = fetch(items, depth[seg])
        first = np.cumsum(size) - size
        pivot = word[first + size // 2][seg]
        side = (word > pivot).astype(np.int64) - (word < pivot) + 1
        key = seg * 3 + side
        mixed = np.logical_or.reduceat(side != 1, first)[seg]
        if mixed.any():
            to = np.argsort(key[mixed], kind="stable")
            order[at[mixed]] = items[mixed][to]
            key[mixed] = key[mixed][to]
        new = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        size = np.diff(np.append(new, len(key)))
        begin, kind = at[new], key[new]
        depth = depth[kind // 3] + (kind % 3 == 1)
        end = (size == 1) | (depth == depths)
        done.append(begin[end])
        begin, size, depth = begin[~end], size[~end], depth[~end]
    return order, np.sort(np.concatenate(done))
