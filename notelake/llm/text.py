"""Vectorised views of Arrow text: words, byte-range hashes and word windows.

Texts arrive in Arrow batches.  Everything here works on the UTF-8 bytes of many
texts at once with NumPy, in blocks of bounded size, so that no step runs Python
code per word and no temporary array grows with the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step handles at once.
BLOCK = 1 << 20

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_ODD = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def _splitmix(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(_ODD) + U64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


@dataclass
class Powers:
    """Tables of b**i and b**-i modulo 2**64, and a random value for each byte."""

    base: int
    values: np.ndarray
    up: np.ndarray
    down: np.ndarray

    @classmethod
    def of(cls, seed: int) -> Powers:
        base = (int(_splitmix(seed * 7919 + 1, 1)[0]) & ~7) | 5  # 5 modulo 8: of full order among the odd numbers
        return cls(base, _splitmix(seed + 12345, 256), np.ones(1, U64), np.ones(1, U64))

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK + 4096)
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                    table = np.full(size, U64(b))
                    table[0] = 1
                    setattr(self, name, np.multiply.accumulate(table))
        return self.up, self.down


_POWERS: dict[int, Powers] = {}


def powers(seed: int = 0) -> Powers:
    if seed not in _POWERS:
        _POWERS[seed] = Powers.of(seed)
    return _POWERS[seed]


def prefix_sums(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """S with S[e]-S[s] = sum of value(byte i) * b**i over s <= i < e."""
    p = powers(seed)
    up, _ = p.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    with np.errstate(over="ignore"):
        np.cumsum(p.values[data] * up[: len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each byte range, the same wherever the bytes stand."""
    _, down = powers(seed).upto(len(sums))
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


@dataclass
class Texts:
    """Some texts of a batch: their bytes one after another, and where each begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK) -> Iterator[Texts]:
    """The texts of a column (null: empty) in blocks of about ``limit`` bytes; a longer text stands alone."""
    first = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_string()) if not pa.types.is_large_string(chunk.type) else chunk
        if chunk.null_count:
            chunk = chunk.fill_null("")
        n = len(chunk)
        if not n:
            continue
        _, offs, data = chunk.buffers()
        offs = np.frombuffer(offs, np.int64, n + 1, chunk.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            hi = min(hi, n)
            yield Texts(first + lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            lo = hi
        first += n


def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of bytes other than 0x20 and 0x09-0x0D."""
    if not len(t.data):
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = _SPACE[t.data]
    before, after = np.empty_like(gap), np.empty_like(gap)
    before[0] = after[-1] = True
    before[1:], after[:-1] = gap[:-1], gap[1:]
    edge = t.offsets[:-1][np.diff(t.offsets) > 0]
    before[edge] = True
    edge = t.offsets[1:][np.diff(t.offsets) > 0]
    after[edge - 1] = True
    word = ~gap
    start, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(t.offsets[:-1], start, "right") - 1


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, in steps of bounded size."""
    out = np.empty(len(start), U64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + 2 * BLOCK, "right")))
        a, b = start[lo], end[hi - 1]
        if hi == lo + 1 and b - a > 2 * BLOCK:
            out[lo] = int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
        else:
            out[lo:hi] = range_hash(prefix_sums(data[a:b], seed), start[lo:hi] - a, end[lo:hi] - a, seed)
        lo = hi
    return out


def window_hash(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each n consecutive values; windows that pass a text's end are included and have to be masked."""
    if len(h) < n or n < 1:
        return np.zeros(0, U64)
    factor = U64(powers(seed + 101).base)
    out = h[: len(h) - n + 1] + U64(n)
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = out * factor + h[j : len(h) - n + 1 + j]
    return mix(out)


def window_ok(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether the n values from each position on belong to one text."""
    return doc[: len(doc) - n + 1] == doc[n - 1 :] if len(doc) >= n else np.zeros(0, bool)


def covered(size: int, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Mask of the positions that ranges [start, start+length) cover."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + length, -1)
    return np.cumsum(steps[:-1]) > 0


def per_text(t: Texts, mask: np.ndarray) -> np.ndarray:
    """How many positions of each text the mask holds."""
    sums = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[t.offsets[1:]] - sums[t.offsets[:-1]]
