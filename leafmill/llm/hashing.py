"""Words of many texts as 64-bit hashes, computed at once over an Arrow column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE = 2 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Bytes of the longest word that is hashed with the others at once.
LONG_WORD = 64

#: Byte classes: ASCII white space separates words; or everything but letters (and digits) and non-ASCII bytes does.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NO_LETTER = np.array([not (chr(i).isalpha() if i < 128 else True) for i in range(256)])
NO_WORD = np.array([not (chr(i).isalnum() if i < 128 else True) for i in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(values: int, factor: int) -> np.ndarray:
    """1, factor, factor^2 ... modulo 2^64."""
    out = np.full(values, np.uint64(factor & MASK))
    if values:
        out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULTIPLIER))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    return running(size, MULTIPLIER), running(size, pow(MULTIPLIER, -1, 1 << 64))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, the usual sizes kept."""
    if size <= SLICE:
        a, b = _powers(SLICE)
        return a[:size], b[:size]
    return running(size, MULTIPLIER), running(size, pow(MULTIPLIER, -1, 1 << 64))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with (h[e] - h[s]) * inverse^s the hash of data[s:e]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * powers(len(data))[0], out=out[1:])
    return out


def slices(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends of the rows in them) of runs of texts, of about ``size`` bytes; nulls are empty."""
    size = size or SLICE
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]
        first = last


def _word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its blocks of eight bytes are mixed in one after the other.

    Mixing is not linear, so no family of words collides whatever the constants, as it does for
    polynomials modulo 2^64. Words above ``LONG_WORD`` bytes are few and hashed one by one.
    """
    sizes = stops - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(sizes.astype(np.uint64) + np.uint64(MULTIPLIER))
    live = np.flatnonzero(sizes <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        live = live[sizes[live] > at]
        if not len(live):
            break
        left = np.minimum(sizes[live] - at, 8).astype(np.uint64)
        block = blocks[starts[live] + at] & (np.uint64(MASK) >> (np.uint64(64) - np.uint64(8) * left))
        out[live] = mix((out[live] ^ block) * np.uint64(MULTIPLIER) + np.uint64(at + 1))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[i] : stops[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def words(data: np.ndarray, ends: np.ndarray, separators: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, one after the other, and where each text's words end."""
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    borders = ends[:-1][ends[:-1] < len(data)]
    first[borders] = inside[borders]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _word_hashes(data, starts, stops), np.searchsorted(starts, ends, "left")


def text_words(column: pa.Array, separators: np.ndarray, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words) for each text of a column."""
    for first, data, ends in slices(column):
        hashes, stops = words(data, ends, separators, lower)
        at = 0
        for i, stop in enumerate(stops.tolist()):
            yield first + i, hashes[at:stop]
            at = stop


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` successive words; of all the words, if they are fewer; of none, if there are none."""
    n = min(size, len(hashes))
    if not n:
        return hashes
    out = np.full(len(hashes) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out * np.uint64(MULTIPLIER) + hashes[k : len(hashes) - n + 1 + k])
    return out
