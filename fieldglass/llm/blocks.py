"""Arrow text columns as byte blocks: words, lines and polynomial hashes, all by numpy.

Texts are taken half a megabyte at a time, whole documents only, so a task's
memory does not depend on how many rows Arrow puts in a batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: texts are worked on in blocks of about so many bytes; a longer text is a block of its own. A step's arrays take some
#: hundred times that, in every worker
BLOCK = 1 << 19
#: the blocks of the models, which sum floats over a block: its size shows in the last bits of what they learn and score
MODEL_BLOCK = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Cache(dict):
    """Tables that every process makes for itself: they don't travel with functions that use them."""

    def __reduce__(self):
        return Cache, ()


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i up to n.

    Made anew for each block, as products of two short series: kept tables would stay with each ended task's functions,
    which refer to each other, until Python looks for such cycles.
    """
    base = int(np.random.default_rng(seed).integers(1 << 62, 1 << 63)) | 5

    def series(x: int, size: int) -> np.ndarray:
        out = np.full(size, x, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    def product(x: int) -> np.ndarray:
        return np.multiply.outer(series(pow(x, 1 << 10, 1 << 64), (n >> 10) + 1), series(x, 1 << 10)).reshape(-1)

    return product(base), product(pow(base, -1, 1 << 64))


class Prefix:
    """Prefix polynomial hashes of a block: the hash of any byte range in constant time."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        powers, self.inverse = _powers(seed, len(data))
        letters = np.random.default_rng(seed + 1000).integers(0, 1 << 64, 256, np.uint64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * powers[: len(data)], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def windows(self, size: int) -> np.ndarray:
        """The hash of every range of ``size`` bytes, by its start."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.inverse[:n] if n > 0 else np.zeros(0, np.uint64)


#: the prime 2**61 - 1
PRIME = np.uint64((1 << 61) - 1)

_PRIME_POWERS: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = Cache()


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**64 modulo the prime."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 31 bits; 2**61 counts as 1."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    return _reduced(np.uint64(2) * a1 * b1 + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half) + a0 * b0)


def _prime_powers(seed: int, n: int, inverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Upper 31 and lower 30 bits of ``base**i`` (or its inverse) modulo the prime, i from 0 to n at least."""
    found = _PRIME_POWERS.get((seed, inverse))
    if found is None or len(found[0]) <= n:
        base = int(np.random.default_rng([seed, 61]).integers(1 << 59, (1 << 61) - 2))
        size, prime, sign = -(-max(n, 1) // BLOCK) * BLOCK + 1, (1 << 61) - 1, -1 if inverse else 1
        own = np.ones(1, np.uint64)
        while len(own) < 1 << 14:
            own = np.concatenate([own, _times(own, np.full(1, pow(base, sign * len(own), prime), np.uint64))])
        found = np.empty(size, np.uint32), np.empty(size, np.uint32)
        for at in range(0, size, len(own)):  # some at a time: the steps of a product need several times their room
            part = _times(own, np.full(1, pow(base, sign * at, prime), np.uint64))[: size - at]
            found[0][at: at + len(own)], found[1][at: at + len(own)] = part >> np.uint64(30), part & np.uint64((1 << 30) - 1)
        _PRIME_POWERS[seed, inverse] = found
    return found


class Ranges:
    """Hashes of byte ranges of a block, polynomials modulo a prime: for any two different ranges equal by chance only.

    The hash of a range is that of its bytes alone, as ``Prefix`` gives, but no text is built so that its hash modulo
    2**64 vanishes. Sums run over halves of the powers; they may wrap, as their differences over a stretch don't.
    """

    STRETCH = 1 << 24

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.inverse = _prime_powers(seed, len(data), inverse=True)
        letters = data.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for half in _prime_powers(seed, len(data)):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(letters * half[: len(data)], out=sums[1:])
            self.sums.append(sums)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        total, at = np.zeros(len(starts), np.uint64), np.asarray(starts)
        while True:
            to = np.minimum(at + self.STRETCH, ends)
            upper, lower = (_reduced(s[to] - s[at]) for s in self.sums)
            total = _reduced(total + _times(upper, np.full(1, 1 << 30, np.uint64)) + lower)
            if not (to < ends).any():
                break
            at = to
        upper, lower = (half[starts] for half in self.inverse)
        return _times(total, (upper.astype(np.uint64) << np.uint64(30)) | lower)


def plain(texts: pa.Array) -> pa.Array:
    """Nulls as empty texts, with 64-bit offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = texts.cast(kind)
    return pc.fill_null(texts, b"" if kind == pa.large_binary() else "") if texts.null_count else texts


def slices(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of consecutive rows of about ``limit`` bytes together; nulls are empty texts."""
    texts = plain(texts)
    n = len(texts)
    if not n:
        return
    ends = _ends(texts)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, texts.slice(row, last - row)
        row = last


def _ends(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]


def blocks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about ``limit`` bytes together."""
    for row, own in slices(texts, limit):
        ends = _ends(own)
        data = np.frombuffer(own.buffers()[2], np.uint8) if own.buffers()[2] else np.zeros(0, np.uint8)
        yield row, data[ends[0]: ends[-1]], ends - ends[0]


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and each row's first word (rows + 1 entries).

    Words are maximal runs of bytes for which ``inside`` holds; by default bytes that are not white space.
    """
    n = len(data)
    word = (~SPACE if inside is None else inside)[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = word.copy(), word.copy()
    if n:
        start[1:] &= ~word[:-1] | edge[1:n]
        end[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the lines of a block, in order; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    rows = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = offsets[rows + 1]
    same = rows[1:] == rows[:-1]
    ends[:-1][same] = starts[1:][same] - 1
    return starts, ends, rows


def per_row(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``marks`` between consecutive ``edges``."""
    sums = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=sums[1:])
    return sums[edges[1:]] - sums[edges[:-1]]


def grams(hashes: np.ndarray, size: int, seed: int = 7) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes, by the first."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(seed).integers(1 << 62, 1 << 63, size, np.uint64) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k: k + n] * factors[k]
    return mix(out)
