"""Vectorised views of a string column: UTF-8 bytes, words and their hashes.

A column of an Arrow batch is cut into chunks of whole texts, at most `max_bytes` each (one longer text
is a chunk of its own), so memory follows the chunk and not the batch. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_powers: dict[str, np.ndarray] = {}


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    member = np.zeros(256, bool)
    for low, high in ranges:
        member[low : high + 1] = True
    return member


#: Words between blanks: all but space, tab, LF, VT, FF and CR.
NON_BLANK = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Letters and digits once A-Z are lower-cased; every byte of a non-ASCII character counts.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows' ends and starts) for runs of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        end = min(end, n)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of member bytes within a row, and the membership of each byte."""
    inside = member[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, inside


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        have = np.full(max(n, 1 << 20), _U(base))
        have[0] = 1
        have = _powers[kind] = np.cumprod(have)
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads each bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with which the hash of data[s:e] is (P[e] - P[s]) / base**s, modulo 2**64."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * _power("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix64((prefix[ends] - prefix[starts]) * _power("down", len(prefix))[starts])


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Of each n consecutive word hashes."""
    out = np.zeros(max(0, len(words) - n + 1), _U)
    scale = 1
    for j in range(n):
        out += words[j : j + len(out)] * _U(scale)
        scale = scale * _BASE % (1 << 64)
    return mix64(out)
