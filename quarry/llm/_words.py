"""Words and hashes of whole texts, computed for an Arrow batch at a time with numpy.

Words are maximal runs of the bytes a `Lexer` keeps; each gets a 64-bit hash of its (folded)
bytes. The work goes over slices of about a megabyte, so memory stays bounded however long
the batch is; a single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))


class Lexer:
    """Which bytes make words, and the value of each byte in the hash."""

    def __init__(self, keep: np.ndarray):
        self.keep = keep
        value = seeded(256, 11)
        value[65:91] = value[97:123]  # A-Z as a-z
        value[~keep] = 0
        self.value = value
        self._powers = np.ones(1, dtype=np.uint64)

    def powers(self, n: int) -> np.ndarray:
        if len(self._powers) < n:
            factors = np.full(n, np.uint64(_BASE))
            factors[0] = 1
            self._powers = np.multiply.accumulate(factors)
        return self._powers


def _lexers() -> tuple[Lexer, Lexer]:
    spaced = np.ones(256, dtype=bool)
    spaced[[0x20, *range(0x09, 0x0E)]] = False
    plain = np.zeros(256, dtype=bool)
    plain[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    return Lexer(spaced), Lexer(plain)


#: SPACED: runs without ASCII white space. PLAIN: runs of ASCII letters, digits and non-ASCII.
SPACED, PLAIN = _lexers()


@dataclass
class Words:
    hash: np.ndarray  # of each word
    first: np.ndarray  # of each text, its first word; one more at the end
    start: np.ndarray  # byte offsets of each word in `buf`
    end: np.ndarray
    buf: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(buf: np.ndarray, offs: np.ndarray, lexer: Lexer = SPACED) -> Words:
    """The words of the texts buf[offs[i]:offs[i+1]]."""
    inside = lexer.keep[buf]
    opens, closes = inside.copy(), inside.copy()
    if len(buf):
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        edge = np.unique(offs[(offs > 0) & (offs < len(buf))])
        opens[edge] = inside[edge]
        closes[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, offs)
    if not len(start):
        return Words(np.zeros(0, np.uint64), first, start, end, buf)
    lengths = np.diff(np.append(start, len(buf)))
    place = np.arange(start[0], len(buf)) - np.repeat(start, lengths)
    with np.errstate(over="ignore"):
        value = lexer.value[buf[start[0] :]] * lexer.powers(int(lengths.max()))[place]
        hashed = mix(np.add.reduceat(value, start - start[0]) + (end - start).astype(np.uint64))
    return Words(hashed, first, start, end, buf)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of runs of texts with about SLICE bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, raw, data = column.buffers()
    n = len(column)
    if not n:
        return
    offs = np.frombuffer(raw, dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + SLICE, side="right")) - 1)
        yield lo, hi, held[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's distinct k-word shingles, sorted by text, then hash; a text of
    one to k - 1 words has its whole sequence as one."""
    counts, n = found.counts, len(found.hash)
    factors = seeded(k, 23)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(min(k, n)):
            total[: n - j] += found.hash[j:] * factors[j]
        at = found.text_of()
        place = np.arange(n) - found.first[at]
        fits = place + k <= counts[at]
        short = np.flatnonzero((counts > 0) & (counts < k))
        text, value = at[fits], mix(total[fits])
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                has = counts[short] > j
                own[has] += found.hash[found.first[short[has]] + j] * factors[j]
            text = np.concatenate([text, short])
            value = np.concatenate([value, mix(own + counts[short].astype(np.uint64))])
    bits = max(1, int(len(counts)).bit_length())
    order = np.argsort((text.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits)))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]
