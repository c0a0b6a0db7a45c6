"""Vectorised text primitives shared by the operators: Arrow strings as byte blocks, word tables and hashes.

Texts are handled as concatenated UTF-8 bytes in blocks of bounded size, so the
working arrays of a task don't depend on how many rows a batch has. A text
longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in a block; working arrays take about 60 times as much.
BLOCK_BYTES = 2 << 20

# unsigned arithmetic wraps on purpose
np.seterr(over="ignore")

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: ASCII bytes that are neither letters nor digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2^64, of the rolling base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[i] the rolling sum of the first i bytes; see span_hash."""
    up, _ = powers(len(data))
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def text_blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets, null mask) of consecutive rows, at most ``limit`` bytes of text a block."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_string())
        n = len(chunk)
        if n == 0:
            continue
        _, off_buf, data_buf = chunk.buffers()
        offs = np.frombuffer(off_buf, np.int64)[chunk.offset : chunk.offset + n + 1]
        data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
        null = np.asarray(chunk.is_null())
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
            j = min(j, n)
            yield base + i, data[offs[i] : offs[j]], (offs[i : j + 1] - offs[i]).astype(np.int64), null[i:j]
            i = j
        base += n


class Words:
    """The words of a block: maximal runs of bytes outside ``space``, lower-cased over A-Z, never across rows.

    ``start`` and ``end`` are byte positions in the block, ``row`` the row of each
    word, ``first[r]`` the index of row r's first word (``first[-1]`` the total)
    and ``hash`` a 64-bit hash of each word's bytes.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> None:
        n = len(data)
        data = _LOWER[data]
        solid = ~space[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        edge = offs[:-1][offs[:-1] < n]
        begins[edge] = solid[edge]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        last = offs[1:][offs[1:] > 0] - 1
        ends[last] = solid[last]
        self.data = data
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offs) - 1), self.count)
        self.prefix = prefix_hash(data)
        self.hash = span_hash(self.prefix, self.start, self.end)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``width`` words; a row with fewer words, if any, has its whole sequence as one."""
    h, n = words.hash, len(words.hash)
    rows, out = [], []
    if n >= width:
        whole = words.row[: n - width + 1] == words.row[width - 1 :]
        acc = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            acc = mix(acc + h[k : n - width + 1 + k] + np.uint64(k + 1))
        rows.append(words.row[: n - width + 1][whole])
        out.append(acc[whole])
    for r in np.flatnonzero((words.count > 0) & (words.count < width)):
        acc = np.zeros(1, np.uint64)
        for k, x in enumerate(h[words.first[r] : words.first[r + 1]]):
            acc = mix(acc + x + np.uint64(k + 1))
        rows.append(np.array([r]))
        out.append(mix(acc ^ np.uint64(int(words.count[r]))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, value = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]
