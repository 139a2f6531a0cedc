"""Words and their hashes as arrays: the text work of one Arrow batch in numpy.

A chunk is the UTF-8 bytes of consecutive rows with their offsets; no word or
window crosses a row. Nothing here depends on the order or size of batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (more only for one longer text).
CHUNK_BYTES = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the output (a bijection of 64 bits)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def byte_class(separators: str | None = None, words: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(is the byte part of a word, 64-bit code of the byte with A-Z as a-z).
    Bytes from 0x80 up are always part of words."""
    inside = np.zeros(256, bool)
    inside[128:] = True
    if separators is not None:
        inside[:128] = [chr(i) not in separators for i in range(128)]
    else:
        inside[:128] = [chr(i) in (words or "") for i in range(128)]
    lower = np.arange(256)
    lower[65:91] += 32
    return inside, mix(np.arange(1, 257, dtype=np.uint64) * _Q)[lower]


#: Words are whatever isn't ASCII white space.
SPACED = byte_class(separators=" \t\n\x0b\x0c\r")
#: Words are letters and digits (every code point from U+0080 up counts).
ALNUM = byte_class(words="0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INV)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows and the end); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + max_bytes, "right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a chunk."""
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(w))]
    first[cut] = w[cut]
    last[cut - 1] = w[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _running(data: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which the hash of any piece follows: (total[z] - total[a]) * down[a]."""
    up, down = _powers(1 << max(12, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * up[:len(data)], out=total[1:])
    return total, down


def words(data: np.ndarray, offsets: np.ndarray, kind=SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word in order, words of each row)."""
    s, e = bounds(data, offsets, kind[0])
    total, down = _running(data, kind[1])
    hashes = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(s, offsets))


def word_starts(data: np.ndarray, offsets: np.ndarray, kind, lengths) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(start and bytes of each word, {0: hash of the word, m: hash of its first m bytes})."""
    s, e = bounds(data, offsets, kind[0])
    total, down = _running(data, kind[1])
    piece = lambda z: (total[z] - total[s]) * down[s]
    return s, e - s, {0: piece(e), **{m: piece(np.minimum(s + m, e)) for m in lengths}}


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words (runs over a row's end included)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = hashes[:n].copy()
    for j in range(1, k):
        g *= _Q
        g += hashes[j:n + j]
    return mix(g + np.uint64(k))
