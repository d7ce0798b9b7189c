"""Text as numpy arrays: UTF-8 bytes and code points of whole Arrow batches, words, and their 64-bit hashes.

Everything works on whole texts. Work is cut into blocks at text ends and word ends only, so that temporary arrays
stay at a few MB whatever the size of an Arrow batch or of a single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; a longer text (or, in ``words``, a longer word) makes a block of its own.
BLOCK = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64; kept for the usual block."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 4096), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts with about ``size`` bytes."""
    data, offsets = buffers(column)
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every word: runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.

    The 64-bit hash depends on the word's bytes alone: a polynomial over random byte values, finalised.
    """
    texts, hashes, a, n = [], [], 0, len(data)
    while a < n:
        b = min(n, a + BLOCK)
        while b < n and not SEPARATOR[data[b - 1]]:  # a block ends after a separator, or at the end of a text
            step = np.flatnonzero(SEPARATOR[data[b : b + 4096]])
            nearest = offsets[np.searchsorted(offsets, b)]
            b = int(min(nearest, b + (step[0] + 1 if len(step) else min(4096, n - b))))
            if b == nearest:
                break
        t, h = _words_of_block(data[a:b], offsets, a)
        texts.append(t)
        hashes.append(h)
        a = b
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(hashes)


def _words_of_block(data: np.ndarray, offsets: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SEPARATOR[data]
    inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, at + n, "left")] - at  # text ends within
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    starts[inner] |= inside[1:-1][inner]
    ends[inner - 1] |= inside[1:-1][inner - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * _power(_P, n), out=total[1:])
    h = (total[e] - total[s]) * _power(_P_INVERSE, n)[s]
    return np.searchsorted(offsets, s + at, "right") - 1, mix(h + (e - s).astype(np.uint64))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes from each start up to its end; it depends on those bytes alone."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_P, len(data)), out=total[1:])
    end = np.maximum(start, end)
    return mix((total[end] - total[start]) * _power(_P_INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def shingles(text: np.ndarray, word: np.ndarray, n: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): for each of ``texts`` texts, its distinct n-word shingles, sorted by hash.

    A text with at least one but fewer than ``n`` words has one shingle, its whole sequence; one without words has none.
    """
    first = np.searchsorted(text, np.arange(texts + 1))
    count = np.diff(first)
    grams = np.zeros(0, np.uint64)
    if len(word) >= n:
        h = word[: len(word) - n + 1].copy()
        for k in range(1, n):
            h = h * np.uint64(_P) + word[k : len(word) - n + 1 + k]
        grams = mix(h + np.uint64(n))
    sets, sizes = [], np.zeros(texts, np.int64)
    for i in range(texts):
        c = count[i]
        if c >= n:
            s = np.unique(grams[first[i] : first[i] + c - n + 1])
        elif c:
            v = int(word[first[i]])
            for x in word[first[i] + 1 : first[i] + c]:
                v = (v * _P + int(x)) & ((1 << 64) - 1)
            s = mix(np.array([(v + int(c)) & ((1 << 64) - 1)], np.uint64))
        else:
            continue
        sets.append(s)
        sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


_BLANK = np.zeros(34, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends): lower-cased texts one after another, separators as spaces, a space around each."""
    raw = data.tobytes()
    texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sizes = np.array([len(x) for x in texts], np.int64)
    cp = np.frombuffer(f" {' '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + 1)
    return np.where(_BLANK[np.minimum(cp, 33)], np.uint32(32), cp), ends - sizes, ends


_letters: list[np.ndarray] = []


def is_letter(cp: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter in Unicode's sense."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    found = _letters[0][np.minimum(cp, 0xFFFF)]
    high = np.flatnonzero(cp > 0xFFFF)
    if len(high):
        found[high] = [chr(c).isalpha() for c in cp[high]]
    return found


def gram_hashes(cp: np.ndarray, n: int) -> np.ndarray:
    """A 32-bit hash of the ``n`` code points from each position on."""
    size = max(0, len(cp) - n + 1)
    h = np.full(size, (0x811C9DC5 + 0x9E3779B1 * n) & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h ^= cp[k : k + size]
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h
