"""Hashes of words and word shingles for whole Arrow columns at once."""

from __future__ import annotations

import numpy as np

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xBF58476D1CE4E5B9)
_WORD = np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}
#: Bytes of words that are hashed at once; longer data is taken in blocks that end between words, so memory stays bounded.
BLOCK_BYTES = 1 << 19
#: Powers that a worker keeps of a base, 10 MB.
KEPT_POWERS = 5 << 18

#: Bytes that end words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII marks.
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept for later calls up to KEPT_POWERS."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if len(held) <= KEPT_POWERS:
            _powers[base] = held
    return held[:n]


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread polynomial hashes over all 64 bits."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _WORD
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[e] - h[s] = sum of (data[j] + 1) * BASE**j for s <= j < e."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(int(_BASE), len(data)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of data[start:stop] that is the same wherever the slice stands."""
    back = powers(pow(int(_BASE), -1, 1 << 64), len(prefix))
    return scramble((prefix[stop] - prefix[start]) * back[start] + (stop - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, drop_marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document (its place among the offsets) of each word, A-Z lower-cased.

    Words are runs of bytes other than white space; with ``drop_marks``, ASCII marks are taken out first.
    """
    if len(data) > BLOCK_BYTES:
        hashes, docs, low = [], [], 0
        while low < len(data):
            high = min(low + BLOCK_BYTES, len(data))
            while high < len(data) and not SPACE[data[high]]:  # up to white space, or the end of a text
                ahead = data[high : high + 4096]
                stop = int(SPACE[ahead].argmax()) if SPACE[ahead].any() else len(ahead)
                bound = offsets[min(int(np.searchsorted(offsets, high)), len(offsets) - 1)]
                high = min(high + stop, int(bound))
                if high == bound:
                    break
            h, d = _block_words(data[low:high], np.clip(offsets, low, high) - low, drop_marks)
            hashes.append(h)
            docs.append(d)
            low = high
        return np.concatenate(hashes), np.concatenate(docs)
    return _block_words(data, offsets, drop_marks)


def _block_words(data: np.ndarray, offsets: np.ndarray, drop_marks: bool) -> tuple[np.ndarray, np.ndarray]:
    if drop_marks:
        held = ~MARK[data]
        offsets = np.concatenate([[0], np.cumsum(held)])[offsets]
        data = data[held]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    stop = np.flatnonzero(inside & (~after | edge[1:])) + 1
    h = slice_hash(prefix_hash(LOWER[data]), start, stop)
    return h, np.searchsorted(offsets, start, side="right") - 1


def shingle_hashes(word: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of n words inside a document."""
    m = len(word) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * _BASE + word[k : k + m]
    own = doc[:m] == doc[n - 1 :]
    return scramble(h[own]), doc[:m][own]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of the distinct n-word shingles of each text, A-Z lower-cased, in order of document and hash.

    A text of 1 to n-1 words has its whole sequence as its one shingle; one without words has none.
    """
    word, doc = words(data, offsets, False)
    h, d = shingle_hashes(word, doc, n)
    ends = np.searchsorted(doc, np.arange(len(offsets)))
    few = np.flatnonzero((np.diff(ends) > 0) & (np.diff(ends) < n))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            own = ends[few] + k < ends[few + 1]
            short[own] = short[own] * _BASE + word[ends[few[own]] + k] + np.uint64(k + 1)
        h, d = np.concatenate([h, scramble(short)]), np.concatenate([d, few])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]
