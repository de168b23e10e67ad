"""Distinct five-word shingles of whole texts as sorted 64-bit hashes, computed over Arrow buffers."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

WORDS = 5
SLICE_BYTES = 1 << 21
_STEP = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(WORDS)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd bases of the two rolling byte hashes, and how many bytes are hashed at a time.
_BASES = (0x9E3779B97F4A7C55, 0xC2B2AE3D27D4EB4F)
PIECE = 1 << 19
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """PIECE powers of a base and of its inverse, made once."""
    if which not in _POWERS:
        steps = [np.full(PIECE, base, dtype=np.uint64) for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        _POWERS[which] = tuple(np.cumprod(s, dtype=np.uint64) for s in steps)
    return _POWERS[which]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string array, nulls as empty texts."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset) if at is not None else np.zeros(1, np.int64)
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], body[offsets[0]:offsets[-1]]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Index ranges of neighbouring texts of at most ``most`` bytes; a longer text stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        yield start, min(stop, n)
        start = min(stop, n)


def runs(offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of the runs of equal ``kind`` other than 0; no run goes beyond its text."""
    begins, ends = kind != 0, kind != 0
    change = kind[1:] != kind[:-1]
    begins[1:] &= change
    ends[:-1] &= change
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(kind))]
    begins[cut] = kind[cut] != 0
    ends[cut - 1] = kind[cut - 1] != 0
    return np.flatnonzero(begins), np.flatnonzero(ends)


def run_hashes(first: np.ndarray, last: np.ndarray, data: np.ndarray, lower: bool = True, which: int = 0) -> np.ndarray:
    """A hash of the bytes of each run, A-Z lower-cased if ``lower``.

    Bytes are taken PIECE at a time, so that memory beyond a few bytes a byte does not grow with a text; a run that
    crosses pieces is the sum of its parts, each moved up by the bytes before it.
    """
    up, down = _powers(which)
    raw = np.zeros(len(first), np.uint64)
    for at in range(0, len(data), PIECE):
        part = data[at:at + PIECE]
        lo, hi = int(np.searchsorted(last, at)), int(np.searchsorted(first, at + len(part)))
        if hi <= lo:
            continue
        value = part.astype(np.uint64)
        value += np.uint64(1)
        if lower:
            value[(part >= 65) & (part <= 90)] += np.uint64(32)
        value *= up[:len(part)]
        total = np.cumsum(value, dtype=np.uint64)
        f, l = np.maximum(first[lo:hi] - at, 0), np.minimum(last[lo:hi] - at, len(part) - 1)
        own = (total[l] - np.where(f > 0, total[f - 1], np.uint64(0))) * down[f]
        if first[lo] < at:
            own[:1] *= np.uint64(pow(_BASES[which], int(at - first[lo]), 1 << 64))
        raw[lo:hi] += own
    return mix(raw + (last - first + 1).astype(np.uint64))


_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
WORD_KIND = np.where(_SPACES, 0, 1).astype(np.uint8)
#: 0 white space, 1 letters, digits and bytes beyond ASCII, 2 the other ASCII bytes.
_SPAN_KIND = np.array([0 if _SPACES[b] else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)


def _hashes(offsets: np.ndarray, data: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first, last = runs(offsets, kinds[data])
    return run_hashes(first, last, data), np.searchsorted(first, offsets)


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (n + 1 long).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
    """
    return _hashes(offsets, data, WORD_KIND)


def spans_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, with runs of ASCII marks apart from runs of letters, digits and other characters."""
    return _hashes(offsets, data, _SPAN_KIND)


def shingle_sets(texts: pa.Array):
    """Yield for each text its sorted distinct shingle hashes (uint64).

    A text of fewer than five words gives its whole sequence as one; no words give an empty array.
    """
    offsets, data = text_buffers(texts)
    for lo, hi in slices(offsets):
        own = offsets[lo:hi + 1]
        words, at = word_hashes(own - own[0], data[own[0]:own[-1]])
        n = max(0, len(words) - WORDS + 1)
        if n:
            rolled = words[:n] * _STEP[0]
            for k in range(1, WORDS):
                rolled += words[k:k + n] * _STEP[k]
            rolled = mix(rolled)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WORDS:
                s = np.sort(rolled[a:b - WORDS + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield s[keep]
            elif b > a:
                whole = sum((int(w) * int(s) for w, s in zip(words[a:b], _STEP)), b - a)
                yield mix(np.array([whole & (2**64 - 1)], dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            else:
                yield np.zeros(0, np.uint64)
