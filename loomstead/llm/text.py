"""Vectorised text kernels over Arrow buffers: words, shingles and 64-bit hashes, without a Python loop per word.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Whole texts are read, never prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space, other control characters and ASCII punctuation.
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U))
_BYTE[_SPACE] = 0
_BASE = U(0xD1342543DE82EF95)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    off = np.frombuffer(places, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``most`` bytes together, or one longer row: bounds a kernel's memory."""
    _, off = utf8(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(buf: np.ndarray, off: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, offsets of each row's words, and the byte at which each word starts; ``apart`` marks the bytes between words."""
    (hashes,), woff, starts = stems(buf, off, (), apart)
    return hashes, woff, starts


def stems(buf: np.ndarray, off: np.ndarray, lengths: tuple[int, ...], apart: np.ndarray = _SPACE) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """As ``words``, with the hashes of the words and then of their first bytes, for each of ``lengths``; a shorter word counts whole."""
    n = len(buf)
    rows = len(off) - 1
    none = [np.zeros(0, U) for _ in range(1 + len(lengths))]
    if not n:
        return none, np.zeros(rows + 1, np.int64), np.zeros(0, np.int64)
    space = apart[buf]
    opens = np.empty(n, bool)
    opens[0] = True
    opens[1:] = space[:-1]
    opens[off[:-1][off[:-1] < n]] = True
    opens &= ~space
    starts = np.flatnonzero(opens)
    if not len(starts):
        return none, np.zeros(rows + 1, np.int64), starts
    span = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n) - np.repeat(starts, span)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(place.max()) + 1, _BASE, U))
        term = np.where(apart, U(0), _BYTE)[_LOWER][buf[starts[0] :]] * power[place]
        sums = [np.add.reduceat(term, starts - starts[0]), *(np.add.reduceat(np.where(place < m, term, U(0)), starts - starts[0]) for m in lengths)]
    return [mix(s) for s in sums], np.searchsorted(starts, off), starts


def shingles(hashes: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words, offsets of each row's runs, and the word at which each run starts.

    A row with 1 to k - 1 words has its whole sequence as its one shingle; a row without words has none.
    """
    n = len(hashes)
    many = np.diff(woff)
    with np.errstate(over="ignore"):
        h = np.full(n, U(k))
        for i in range(min(k, n)):
            h[: n - i] = mix(h[: n - i] ^ hashes[i:])
    row = np.repeat(np.arange(len(many)), many)
    at = np.arange(n)
    good = at + k <= woff[1:][row]
    for r in np.flatnonzero((many > 0) & (many < k)):
        x = np.full(1, U(k + 1000 * many[r]))
        for w in hashes[woff[r] : woff[r + 1]]:
            x = mix(x ^ w)
        h[woff[r]] = x[0]
        good[woff[r]] = True
    kept = np.flatnonzero(good)
    return h[kept], np.searchsorted(kept, woff), kept


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's values sorted and without repeats, flat, with the new offsets."""
    parts = [np.unique(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, as sorted hashes."""
    h, woff, _ = words(*utf8(column))
    s, soff, _ = shingles(h, woff, k)
    return distinct(s, soff)


def strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())
