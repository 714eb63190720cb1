"""Words and shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from quillmesh.llm.common import CHUNK, mixed, ranges
from quillmesh.llm.hashing import PrefixHash

SIZE = 5
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD], np.uint64)


def word_bounds(raw: np.ndarray, at: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words end at blanks and at the ends of texts."""
    solid = ~blank[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = np.zeros(len(raw) + 1, bool)
    ends[1:] = solid
    ends[1:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends)


def word_hashes(raw: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK, lower: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, with A-Z lowered, and the number of words of each text."""
    if len(raw) > 2 * CHUNK:
        return _in_slices(raw, at, blank, lower)
    starts, ends = word_bounds(raw, at, blank)
    hashes = PrefixHash(lower[raw])
    length = ends - starts
    words = mixed(hashes.of(starts, length) + length.astype(np.uint64) * _STEPS[1])
    return words, np.diff(np.searchsorted(starts, at))


def _in_slices(raw, at, blank, lower):
    """As above for much text: slices that end behind a blank or a text."""
    cut = blank[raw]
    cut[at[1:-1][at[1:-1] < len(raw)] - 1] = True
    begin, words, starts = 0, [], [0]
    counts = np.zeros(len(at) - 1, np.int64)
    while begin < len(raw):
        end = min(begin + CHUNK, len(raw))
        if end < len(raw):
            later = end
            while later < len(raw):  # a word may be longer than a slice
                found = np.flatnonzero(cut[later - 1 : later - 1 + CHUNK])
                if len(found):
                    end = later + int(found[0])
                    break
                later += CHUNK
            else:
                end = len(raw)
        inner = np.clip(at, begin, end) - begin
        piece = raw[begin:end]
        s, e = word_bounds(piece, inner, blank)
        hashes = PrefixHash(lower[piece])
        words.append(mixed(hashes.of(s, e - s) + (e - s).astype(np.uint64) * _STEPS[1]))
        counts += np.diff(np.searchsorted(s, inner))
        begin = end
    return np.concatenate(words) if words else np.empty(0, np.uint64), counts


def shingle_sets(words: np.ndarray, counts: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and their number.

    A text with fewer than `size` words, but not none, has one shingle.
    """
    text_of = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(counts)), n)
    start = ranges(first, n)
    padded = np.r_[words, np.zeros(size, np.uint64)]
    own = np.r_[text_of, np.full(size, -1)]
    total = np.zeros(len(start), np.uint64)
    for i in range(size):
        # A word behind the end of a short text counts as none.
        total += np.where(own[start + i] == owner, padded[start + i] * _STEPS[i], np.uint64(i + 1))
    h = mixed(total)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(counts))


def set_fingerprints(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit number for each set of hashes."""
    full = n > 0
    starts = (np.cumsum(n) - n)[full]
    found = np.zeros(len(n), np.uint64)
    if len(starts):
        both = np.bitwise_xor.reduceat(h, starts) ^ (np.add.reduceat(mixed(h ^ _STEPS[0]), starts) * _STEPS[2])
        found[full] = mixed(both + n[full].astype(np.uint64) * _STEPS[3])
    return found


