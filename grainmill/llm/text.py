"""Whole batches of texts as arrays of bytes: words, lines and their hashes without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; bounds the arrays that a step makes, whatever the size of an Arrow batch, and the tables
#: that a worker keeps: hashes take some 70 bytes for each of them.
STEP_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that continue a UTF-8 character.
INNER = (np.arange(256) & 0xC0) == 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Two primes below 2 ** 31 and a base for each: no pair of texts is known to agree modulo both.
_PRIMES = ((2147483629, 1526283741), (2147483587, 1098473921))
_tables: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, np.uint32), np.ones(1, np.uint32)) for _ in _PRIMES]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, prime: int, size: int) -> np.ndarray:
    """base ** 0 .. base ** (size - 1) modulo a prime; `size` is a power of two."""
    out = np.ones(size, np.uint64)
    n = 1
    while n < size:
        out[n : 2 * n] = out[:n] * np.uint64(pow(base, n, prime)) % np.uint64(prime)
        n *= 2
    return out.astype(np.uint32)


def _grow(n: int) -> None:
    if len(_tables[0][0]) <= n:
        size = 1 << int(n + 1).bit_length()
        _tables[:] = [(_powers(b, p, size), _powers(pow(b, -1, p), p, size)) for p, b in _PRIMES]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; equal bytes give equal hashes in every task.

    The bytes are the coefficients of a polynomial, taken at one point modulo each of two primes; modulo a power of two
    there would be short texts that agree at every point.
    """
    _grow(len(data))
    h = (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    letters = data.astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    for (prime, _), (powers, inverse) in zip(_PRIMES, _tables):
        p = np.uint64(prime)
        np.cumsum(letters * powers[: len(data)] % p, out=sums[1:])
        h = mix(h + (sums[end] - sums[start]) % p * inverse[start] % p)
    return h


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes other than ASCII white space that stay in one text."""
    solid = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def steps(texts: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of successive stretches of about `size` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, chars = texts.buffers()
    offsets = np.frombuffer(where, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(chars, np.uint8) if chars is not None and chars.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def per_text(values: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum for each text of the values at byte positions `at` (ascending)."""
    cum = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=cum[1:])
    cut = np.searchsorted(at, offsets)
    return cum[cut[1:]] - cum[cut[:-1]]
