"""Two-stage suffix sorting of byte strings, and the prefixes that neighbours have in common."""

from __future__ import annotations

import numpy as np


def _chunk(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as big-endian numbers; ``data`` is padded by eight zeros at least."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)


def _sort_directly(padded: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the ``depth`` bytes from them; of places that tie, only these are compared further."""
    key = _chunk(padded, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    for k in range(8, depth, 8):
        tied = np.concatenate([[False], group[1:] == group[:-1]])
        tied[:-1] |= tied[1:]
        some = np.flatnonzero(tied)
        if not len(some):
            break
        key = _chunk(padded, np.minimum(at[some] + k, len(padded) - 8))
        order = np.lexsort((key, group[some]))
        at[some], key, own = at[some][order], key[order], group[some]
        new = np.zeros(len(group), np.int64)
        new[some[1:]] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        first = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (new[1:] > 0))])
        group = first
    return at


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of ``data`` in the order of their first ``depth`` bytes.

    Only suffixes smaller than their successor (the suffix one place on) are sorted directly. The others follow by a
    scan over the buckets of first bytes, in ascending order: a suffix that stands in its place gives the place of its
    predecessor, if that is larger than it. Within a bucket the larger-than-successor suffixes come first; those that
    the bucket itself gives it are taken in further waves.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    differs = np.flatnonzero(np.concatenate([data[:-1] != data[1:], [True]]))
    last = differs[np.searchsorted(differs, np.arange(n))]  # the end of the run of equal bytes
    smaller = padded[last] < np.where(last + 1 < n, padded[last + 1], 0)  # the empty suffix at the end is least of all
    smaller[last == n - 1] = False
    direct = _sort_directly(padded, np.flatnonzero(smaller), depth)
    first = data[direct]
    bounds = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def give(suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[~smaller[before]]
        byte = data[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(byte) else []
        for a, b in zip(cuts, [*cuts[1:], len(byte)]):
            induced[int(byte[a])].append(before[a:b])

    give(np.array([n]))
    out: list[np.ndarray] = []
    for c in range(256):
        k = 0
        while k < len(induced[c]):  # grows while it is read
            wave = induced[c][k] if len(induced[c]) == k + 1 else np.concatenate(induced[c][k:])
            induced[c][k:] = [wave]
            k += 1
            give(wave)
        own = direct[bounds[c] : bounds[c + 1]]
        out += [*induced[c], own]
        induced[c] = []
        give(own)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes each suffix in order has in common with the one before it, up to ``depth``; 0 for the first."""
    padded = np.concatenate([data, np.zeros(depth + 16, np.uint8)])
    out = np.zeros(len(order), np.int64)
    some = np.arange(1, len(order))
    for k in range(0, depth, 8):
        apart = _chunk(padded, order[some] + k) ^ _chunk(padded, order[some - 1] + k)
        equal = apart == 0
        zero = np.zeros(len(some), np.int64)  # leading zero bytes of the difference
        for n in range(1, 9):
            zero += (apart >> np.uint64(64 - 8 * n) if n < 8 else apart) == 0
        out[some] += zero
        some = some[equal]
    if len(order):
        out = np.minimum(np.minimum(out, depth), len(data) - order)
        out[1:] = np.minimum(out[1:], len(data) - order[:-1])
    return out
