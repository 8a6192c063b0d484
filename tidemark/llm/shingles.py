"""Word shingles of whole texts as sorted arrays of 64-bit hashes, computed on bytes with numpy.

Edge cases: null, empty and blank texts have no words and the empty set; a text with fewer words than a
shingle has one shingle, of all its words; words and texts of any length are hashed whole, in slices of
bounded size; repeated shingles count once. Shingles have at most MOST_WORDS words."""

from __future__ import annotations

import numpy as np

#: Odd multipliers, one per place in a shingle (fixed values; any odd numbers do).
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
#: Bytes of a text that are hashed at once; bounds the memory for very long texts.
SLICE = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Spread bits; one to one on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * PLACES[3]
    x = (x ^ (x >> np.uint64(29))) * PLACES[0]
    return x ^ (x >> np.uint64(32))


MOST_WORDS = 64
PLACES = np.concatenate([PLACES, mix(np.arange(len(PLACES), MOST_WORDS, dtype=np.uint64)) | np.uint64(1)])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * PLACES[1])[_LOWER]
_BASE = 0x9E3779B97F4A7C13  # fixed value: any odd number that is 3 modulo 8
_POWER = np.full(SLICE, _BASE, np.uint64)
_POWER[0] = 1
_POWER = np.multiply.accumulate(_POWER)
_BACK = np.full(SLICE, pow(_BASE, -1, 1 << 64), np.uint64)
_BACK[0] = 1
_BACK = np.multiply.accumulate(_BACK)


def text_words(text: str | None) -> np.ndarray:
    """Hash of every word in order. Words are runs of anything but ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    if len(raw) <= SLICE:
        return _hash_words(raw)
    out, at = [], 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):  # cut between words; a word beyond the slice is hashed alone
            gaps = np.flatnonzero(_SPACE[raw[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(_SPACE[raw[end:]])
                end = end + int(more[0]) if len(more) else len(raw)
                out.append(_hash_long(raw[at:end]))
                at = end
                continue
        out.append(_hash_words(raw[at:end]))
        at = end
    return np.concatenate(out)


def _hash_long(word: np.ndarray) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(_LOWER[word].tobytes())], np.uint64)


def _hash_words(raw: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all words from one cumulative sum over the bytes."""
    space = np.ones(len(raw) + 2, bool)
    np.take(_SPACE, raw, out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    first, last = edge[::2], edge[1::2]
    if len(first) == 1 and last[0] - first[0] >= SLICE:
        return _hash_long(raw)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _POWER[: len(raw)], out=total[1:])
    return mix((total[last] - total[first]) * _BACK[first] + (last - first).astype(np.uint64)) if len(first) else np.empty(0, np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, one of the whole sequence."""
    if not 1 <= k <= MOST_WORDS:
        raise ValueError(f"shingles have 1 to {MOST_WORDS} words")
    h = text_words(text)
    if not len(h):
        return h
    if len(h) < k:
        return mix((h * PLACES[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += h[i : i + n] * PLACES[i]
    return np.unique(mix(out))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
