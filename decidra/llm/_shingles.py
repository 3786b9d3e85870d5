"""Word shingles of whole texts as unsigned 64-bit hashes, by vector operations over an Arrow batch's bytes.

Texts are lower-cased in A-Z only and cut at the bytes 0x20 and 0x09 to 0x0D. A word's hash is of two polynomials in its bytes,
modulo two primes near 2**31 (modulo a power of two, words that alternate by a rule can share a value whatever the base), and
scrambled; two words of n bytes share both with a chance of (n / 2**31)**2 at most over the bases. A shingle's is a
weighted sum of its words' hashes, scrambled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from decidra.llm._common import U64, mix64

_CHUNK = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_PRIMES, _BASES = (2**31 - 1, 2**31 - 19), (1_103_515_249, 1_664_525_003)
_NO_WRAP = 1 << 22  # bytes whose terms' sum stays below 2**63 without reducing each
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.arange(1, 257, dtype=U64)
_LETTER[65:91] = _LETTER[97:123]
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
_PRIME_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    """Powers of an odd number, or of its inverse, modulo 2**64."""
    if len(_POWERS[kind]) < n:
        base = np.full(max(n, _CHUNK + 1), _P if kind == "up" else _P_INVERSE, U64)
        base[0] = 1
        _POWERS[kind] = np.cumprod(base, dtype=U64)
    return _POWERS[kind][:n]


def prime_powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """Powers of a base, or of its inverse, modulo a prime."""
    held = _PRIME_POWERS.get((which, inverse), np.ones(1, U64))
    prime = _PRIMES[which]
    base = pow(_BASES[which], -1, prime) if inverse else _BASES[which]
    while len(held) < n:
        held = np.concatenate([held, held * U64(pow(base, len(held), prime)) % U64(prime)])
    _PRIME_POWERS[which, inverse] = held
    return held[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * width).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _words(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the concatenated texts, and where each text's words begin among them (n + 1 numbers)."""
    n = len(text)
    if not n:
        return np.zeros(0, U64), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[text]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends[:-1] &= ~solid[1:] | edge[1:n]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    letters, sums, halves = _LETTER[text], np.zeros(n + 1, U64), []
    for which, prime in enumerate(_PRIMES):
        terms = letters * prime_powers(which, False, n)
        if n > _NO_WRAP:
            terms %= U64(prime)
        np.cumsum(terms, out=sums[1:])
        halves.append((sums[stops] - sums[starts]) % U64(prime) * prime_powers(which, True, n)[starts] % U64(prime))
    hashes = mix64(mix64((halves[0] << U64(32)) | halves[1]) + (stops - starts).astype(U64))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles: of k words, or of all words if there are fewer; none without words."""
    data, offsets = text_buffers(column)
    weights = mix64(np.arange(11, 11 + k, dtype=U64)) | U64(1)
    first, n = 0, len(column)
    with np.errstate(over="ignore"):
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
            last = min(last, n)
            words, at = _words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            grams = np.zeros(max(0, len(words) - k + 1), U64)
            for j in range(k):
                grams += words[j : j + len(grams)] * weights[j]
            grams = mix64(grams)
            for d in range(last - first):
                a, b = int(at[d]), int(at[d + 1])
                if b - a >= k:
                    yield np.unique(grams[a : b - k + 1])
                elif b > a:
                    yield mix64(np.array([(words[a:b] * weights[: b - a]).sum(dtype=U64) + U64(b - a)], U64))
                else:
                    yield np.zeros(0, U64)
            first = last
