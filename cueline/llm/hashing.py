"""Vectorised text keys: word and shingle hashes straight from Arrow string buffers.

Everything here is a small numpy helper that runs inside Spark tasks on one
Arrow batch at a time. Hashes are 64 bit; they depend only on the text, so that
executors, retries and runs agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step takes (a longer document is a step of its own).
STEP_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection with good avalanche) over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without a copy. Nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes together; one document at least."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, min(high, n)
        low = high


def byte_classes(separators: str) -> tuple[np.ndarray, np.ndarray]:
    """Two tables over byte values: A-Z lower-cased, and True for the (ASCII) separators."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    apart = np.zeros(256, bool)
    apart[[ord(c) for c in separators]] = True
    return lower, apart


#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
BLANKS = " \t\n\v\f\r"
#: Words are runs of digits, letters and everything beyond ASCII.
NOT_ALNUM = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def word_bounds(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word, and each document's first word (n + 1 entries)."""
    inside = ~apart[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False  # no word crosses documents
    starts = np.flatnonzero(inside & ~before[:-1])
    ahead = np.zeros(len(data) + 1, bool)
    ahead[:-1] = inside
    ahead[offsets] = False
    ends = np.flatnonzero(inside & ~ahead[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, and a random value for each byte."""

    base = np.uint64(0xD1342543DE82EF95)
    inverse = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
    values = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
    up = down = np.ones(1, np.uint64)

    @classmethod
    def until(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, STEP_BYTES + 1)
            ones = np.ones(size, np.uint64)
            for name, factor in (("up", cls.base), ("down", cls.inverse)):
                powers = ones.copy()
                powers[1:] = factor
                setattr(cls, name, np.multiply.accumulate(powers))
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per word: a polynomial over its bytes, from prefix sums, then mixed."""
    up, down = _Powers.until(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_Powers.values[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a document, and each document's first one.

    A document of fewer words, but not none, has one: its whole sequence.
    """
    count = np.diff(first)
    odd = mix(np.arange(1, width + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    have = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(have, out=at[1:])
    owner = np.repeat(np.arange(len(count)), have)
    start = first[owner] + np.arange(at[-1]) - at[owner]
    length = np.minimum(count[owner], width)
    out = length.astype(np.uint64) * _ODD
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for i in range(width):
        out += np.where(length > i, padded[start + i] * odd[i], np.uint64(0))
    return mix(out), at


#: An odd base for hashes of runs of values.
_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums of values times powers, and the powers and their inverses: what :func:`run_hash` needs."""
    n = len(values) + 1
    base, inverse = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    base[0] = inverse[0] = np.uint64(1)
    up, down = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    total = np.zeros(n, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return total, up, down


def run_hash(sums: tuple[np.ndarray, np.ndarray, np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of the values in each run, wherever it stands."""
    total, _, down = sums
    return (total[high] - total[low]) * down[low]
