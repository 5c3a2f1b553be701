"""Vectorised scans of text columns: spans, hashes and shingles straight from Arrow's UTF-8 buffers.

Texts come in chunks of about CHUNK bytes. A longer text comes in several chunks of its own row, cut after
border bytes that no span holds, so that what is found in them adds up to what the whole text holds and
temporaries stay small; only a single span without a border makes a longer chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text scanned at once. Bounds the numpy temporaries.
CHUNK = (1 << 19) - 1
#: Blocks of 8 bytes hashed at once.
_BLOCKS = 1 << 18
_U = np.uint64

#: Bytes of [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The line feed alone.
BREAK = np.zeros(256, bool)
BREAK[10] = True
#: A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column; null counts as empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offs, raw


def pieces(data: np.ndarray, border: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """data in pieces that end after a border byte, of about `most` bytes or up to the first border beyond."""
    lo, n = 0, len(data)
    while n - lo > most:
        found = np.flatnonzero(border[data[lo : lo + most]])
        hi = lo + int(found[-1]) + 1 if len(found) else 0
        at = lo + most
        while not hi and at < n:
            found = np.flatnonzero(border[data[at : at + most]])
            hi = at + int(found[0]) + 1 if len(found) else 0
            at += most
        if not hi:
            break
        yield data[lo:hi]
        lo = hi
    yield data[lo:]


def chunks(column: pa.Array, most: int | None = None, border: np.ndarray = SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks (first row, end row, offsets from 0, bytes): whole texts, or pieces() of one text longer than `most` bytes."""
    most = most or CHUNK
    offs, raw = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n)
        if offs[hi] - offs[lo] <= most:
            yield lo, hi, offs[lo : hi + 1] - offs[lo], raw[offs[lo] : offs[hi]]
        else:
            for piece in pieces(raw[offs[lo] : offs[hi]], border, most):
                yield lo, hi, np.array([0, len(piece)]), piece
        lo = hi


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True within each text: starts, ends, and of each text the first run (texts + 1 entries)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offs[:-1][offs[:-1] < n]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[1:][offs[1:] > 0] - 1
    last[edge] = inside[edge]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], _U)


class Hasher:
    """64-bit hashes of byte spans: each block of 8 bytes is mixed with its place in the span, sums of that with the length."""

    def __init__(self, data: np.ndarray):
        room = np.zeros(len(data) + 8, np.uint8)
        room[: len(data)] = data
        self.at = np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))

    def __call__(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        length = ends - starts
        total = self._block(starts, np.minimum(length, 8), np.zeros(1, np.int64), seed)
        longer = np.flatnonzero(length > 8)
        lo = 0
        rest = (length[longer] - 1) >> 3  # blocks after the first
        upto = np.cumsum(rest)
        while lo < len(longer):
            done = int(upto[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + _BLOCKS, "right")))
            some, n = longer[lo:hi], rest[lo:hi]
            if hi - lo == 1 and n[0] > _BLOCKS:
                for a in range(1, int(n[0]) + 1, _BLOCKS):
                    place = np.arange(a, min(a + _BLOCKS, int(n[0]) + 1))
                    total[some] += self._block(starts[some] + 8 * place, np.minimum(length[some] - 8 * place, 8), place, seed).sum(dtype=_U, keepdims=True)
            else:
                first = upto[lo:hi] - n - done
                place = np.arange(int(upto[hi - 1]) - done) - np.repeat(first, n) + 1
                of = np.repeat(some, n)
                total[some] += np.add.reduceat(self._block(starts[of] + 8 * place, np.minimum(length[of] - 8 * place, 8), place, seed), first, dtype=_U)
            lo = hi
        return mix(total + length.astype(_U) * _U(0xD6E8FEB86659FD93))

    def _block(self, at: np.ndarray, size: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
        value = self.at[at] & _MASK[size]
        return mix(mix(value + _U(0xA0761D6478BD642F + seed)) + (place + 1).astype(_U) * _U(0x9E3779B97F4A7C15))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Hasher(data)(starts, ends)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and of each text the first word."""
    data = LOWER[data]
    starts, ends, at = spans(~SPACE[data], offs)
    return span_hashes(data, starts, ends), at


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring hashes."""
    n = max(len(h) - k + 1, 0)
    out = np.full(n, k * 0xA0761D6478BD642F & (1 << 64) - 1, _U)
    for j in range(k):
        out = mix(out + h[j : j + n]) if j else out + h[:n]
        out = out * _U(0xE7037ED1A0B428DB)
    return mix(out)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each text its distinct k-word shingles, sorted; fewer words make one shingle, none make none."""
    every = windows(h, k)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield windows(h[a:b], b - a)
        else:
            yield every[:0]


class Distinct:
    """Distinct hashes of parts that come one by one."""

    def __init__(self) -> None:
        self.whole, self.parts, self.size = np.zeros(0, _U), [], 0

    def add(self, h: np.ndarray) -> None:
        self.parts.append(np.unique(h))
        self.size += len(self.parts[-1])
        if self.size > max(1 << 18, len(self.whole)):
            self.values()

    def values(self) -> np.ndarray:
        if self.parts:
            every = np.concatenate([self.whole, *self.parts])
            self.whole, self.parts, self.size = every[:0], [], 0
            every.sort()
            new = np.ones(len(every), bool)
            new[1:] = every[1:] != every[:-1]
            self.whole = every[new]
        return self.whole


def sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """shingles() of each text of a column. From piece to piece of a long text its last k - 1 words go along."""
    row, found, carried = -1, Distinct(), np.zeros(0, _U)

    def whole() -> np.ndarray:
        s = found.values()
        return s if len(s) else windows(carried, len(carried)) if len(carried) else carried

    for lo, hi, offs, data in chunks(column):
        if row >= 0 and lo != row:
            yield whole()
            row, found, carried = -1, Distinct(), np.zeros(0, _U)
        h, at = words(data, offs)
        if hi - lo > 1:
            yield from shingles(h, at, k)
            continue
        row, h = lo, np.concatenate([carried, h])
        found.add(windows(h, k))
        carried = h[max(0, len(h) - k + 1) :]
    if row >= 0:
        yield whole()
