"""Words of whole batches of texts as 64-bit hashes, in numpy, without an object for each word.

Words: runs without ASCII white space, A-Z lower-cased.  A word's hash is a polynomial over random values of its bytes
modulo 2^64, mixed; prefix sums give it for all words of a slice at once.  A hash stands for its word: among V distinct
words the chance that any two share one is about V^2 / 2^65 (three in a million for ten million words).
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa

from .common import LOWER

SLICE = 1 << 16  # bytes hashed at once, so that the arrays stay in a core's cache
_BYTE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.array([b in b" \t\n\x0b\x0c\r" for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
END = int(_BYTE[10])  # the end token's hash; no word holds a line feed


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _slices(raw: np.ndarray):
    """(first, end) of slices that end at white space."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + SLICE)
        while end < n:
            gaps = np.flatnonzero(_SPACE[raw[end : end + SLICE]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(n, end + SLICE)
        yield at, end
        at = end


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, their last two bytes (256 * last but one + last; 0 for none) and words a text."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    raw = text.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    # A text's end parts words as white space does; a byte that is none stands for it.
    raw = np.frombuffer(raw.tobytes().translate(LOWER), np.uint8)
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[offsets] = True
    hashes, last, starts = [], [], []
    for a, b in _slices(raw):
        part, cut = raw[a:b], cuts[a : b + 1]
        space = _SPACE[part]
        word = ~space
        begin = word & (np.r_[True, space[:-1]] | cut[:-1])
        end = word & (np.r_[space[1:], True] | cut[1:])
        s, e = np.flatnonzero(begin), np.flatnonzero(end)
        if not len(s):
            continue
        up, down = _powers(1 << max(16, (b - a).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
        h = (sums[e + 1] - sums[s]) * down[s]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
        hashes.append(h)
        last.append(np.where(e > s, part[e - 1], 0).astype(np.int32) * 256 + part[e])
        starts.append(s + a)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.zeros(len(text), np.int64)
    at = np.concatenate(starts)
    return np.concatenate(hashes), np.concatenate(last), np.diff(np.searchsorted(at, offsets))
