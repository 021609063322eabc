"""Vectorised tokenising and hashing of Arrow text columns (runs inside tasks).

Texts are handled as UTF-8 bytes, many short ones at once and long ones in pieces cut at white
space, so memory stays near ``PIECE`` whatever a text's length; only one word longer than that
needs more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
_BYTES = stream(1, 256)
_FOLDED = _BYTES[LOWER]
#: Byte classes: 0 space, 1 word (letters, digits, _ and all of UTF-8's longer sequences), 2 the rest.
CLASS = np.full(256, 2, np.uint8)
CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
CLASS[SPACE] = 0


class Powers:
    """Powers of the hash base and of its inverse, modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * PIECE)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                full = np.full(n, base, U64)
                full[0] = 1
                setattr(self, name, np.cumprod(full, dtype=U64))
        return self.up, self.down


_POWERS = Powers()


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool) -> np.ndarray:
    """A 64-bit hash of each data[start:end]: a polynomial by prefix sums, then mixed with its length."""
    up, down = _POWERS.get(len(data) + 1)
    table = _FOLDED if folded else _BYTES
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * up[: len(data)], out=prefix[1:])
    raw = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
    """(bytes, offsets of documents in them, first document, whether the last one goes on).

    Null texts are empty. A document longer than PIECE comes alone, in pieces that end at white space.
    """
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1].copy()
    if column.null_count:  # a null may own bytes
        column = column.fill_null(b"")
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1].copy()
    blob = column.buffers()[2]
    data = np.frombuffer(blob, np.uint8) if blob is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(bounds, bounds[at] + PIECE, "right")) - 1
        if end > at:
            end = min(end, n)
            yield data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at], at, False
            at = end
            continue
        lo, hi = int(bounds[at]), int(bounds[at + 1])
        while lo < hi:
            to = min(hi, lo + PIECE)
            while to < hi:
                blank = np.flatnonzero(SPACE[data[max(lo, to - PIECE) : to]])
                if len(blank):
                    to = max(lo, to - PIECE) + int(blank[-1]) + 1
                    break
                to = min(hi, to + PIECE)
            yield data[lo:to], np.array([0, to - lo]), at, to < hi
            lo = to
        at += 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs without ASCII white space, and the offsets of documents in them."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    solid = solid.view(np.int8)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a word ends where its document does
    now, before = solid[1:].astype(bool), solid[:-1].astype(bool)
    starts = np.flatnonzero(now & (~before | first))
    ends = np.flatnonzero(before & (~now | first))
    return spans(data, starts, ends, True), np.searchsorted(starts, offsets)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of word bytes and runs of other marks, case kept: hashes, offsets of documents, shape.

    Shape: 0 marks, 1 a word with a lower-case or non-ASCII letter, 2 one of capitals only, 3 digits only.
    """
    kind = np.zeros(len(data) + 2, np.uint8)
    kind[1:-1] = CLASS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    now, before = kind[1:], kind[:-1]
    edge = (now != before) | first
    starts = np.flatnonzero(edge & (now > 0))
    ends = np.flatnonzero(edge & (before > 0))
    small, large = np.zeros(len(data) + 1, np.int32), np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 97) & (data != 123), out=small[1:])
    np.cumsum((data >= 65) & (data < 91), out=large[1:])
    n_small, n_large = small[ends] - small[starts], large[ends] - large[starts]
    shape = np.where(now[starts] == 2, 0, np.where(n_small > 0, 1, np.where(n_large > 0, 2, 3)))
    return spans(data, starts, ends, False), np.searchsorted(starts, offsets), shape


def grouped(column: pa.Array, split) -> Iterator[tuple[int, int, tuple[np.ndarray, ...], np.ndarray]]:
    """(first document, how many, arrays of ``split`` without its offsets, offsets); a document's pieces are joined."""
    held: list[tuple[np.ndarray, ...]] = []
    for data, offsets, at, more in pieces(column):
        out = split(data, offsets)
        arrays, places = (out[0], *out[2:]), out[1]
        if more or held:
            held.append(arrays)
            if more:
                continue
            arrays = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            places = np.array([0, len(arrays[0])])
        yield at, len(places) - 1, arrays, places
