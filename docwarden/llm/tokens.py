"""Word hashes of whole Arrow text columns, computed with numpy.

Texts are never handled word by word in Python. A batch of texts is one byte buffer: word
bounds come from a table lookup per byte and the 64-bit hash of every word from one
``add.reduceat``, so a pass costs some nanoseconds per byte whatever the words are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that end a word.
WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: White space, ASCII punctuation and control characters; bytes of longer UTF-8 forms are word bytes.
NOT_ALPHANUMERIC = bytes(b for b in range(128) if not chr(b).isalnum())
#: Texts are handled in pieces of about so many bytes, to bound the working arrays.
PIECE_BYTES = 1 << 19
#: Words hashed at once.
WORDS_AT_ONCE = 1 << 15

_random = np.random.default_rng(20240917)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _FACTOR, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


@dataclass
class Words:
    """Words of a run of rows: hashes, byte bounds in ``data``, and each row's first word."""

    data: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    row_ptr: np.ndarray

    def of(self, row: int) -> np.ndarray:
        return self.hashes[self.row_ptr[row] : self.row_ptr[row + 1]]

    def prefix_hashes(self, n_bytes: int) -> np.ndarray:
        """Hashes of the first ``n_bytes`` bytes of each word, 0 where it is not longer."""
        longer = self.end - self.begin > n_bytes
        out = np.zeros(len(self.begin), np.uint64)
        at = self.begin[longer]
        total = np.full(len(at), n_bytes, np.uint64)
        powers = _powers(n_bytes)
        for k in range(n_bytes):
            total += _BYTE[self.data[at + k]] * powers[k]
        out[longer] = mix(total * np.uint64(0xD1B54A32D192ED03))
        return out


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words(column: pa.Array, separators: bytes = WHITE_SPACE, fold: bool = True) -> Words:
    """Split texts at ``separators`` and hash each word, A-Z folded to a-z unless told not to."""
    raw, rows = bytes_of(column)
    data = _FOLD[raw] if fold else raw
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    inside = is_word[raw]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    edges = rows[(rows > 0) & (rows < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    table = np.where(is_word, _BYTE, np.uint64(0))
    hashes = np.empty(len(begin), np.uint64)
    for i in range(0, len(begin), WORDS_AT_ONCE):
        b, e = begin[i : i + WORDS_AT_ONCE], end[i : i + WORDS_AT_ONCE]
        length = e - b
        gap = np.diff(b, append=e[-1])  # to the next word; separators in between count 0
        offset = np.arange(e[-1] - b[0]) - np.repeat(b - b[0], gap)
        power = _powers(int(length.max()))
        np.minimum(offset, len(power) - 1, out=offset)
        value = table[data[b[0] : e[-1]]] * power[offset]
        hashes[i : i + WORDS_AT_ONCE] = np.add.reduceat(value, b - b[0]) + length.astype(np.uint64)
    return Words(data, mix(hashes), begin, end, np.searchsorted(begin, rows).astype(np.int64))


def pieces(batch: pa.RecordBatch, text: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text, one row at least."""
    _, rows = bytes_of(batch.column(text))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(rows, rows[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter sequence counts as one run."""
    if len(hashes) == 0:
        return hashes
    n = min(size, len(hashes))
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = mix(total + hashes[k : len(hashes) - n + 1 + k] + np.uint64(k + 1))
    return total


def shingle_sets(found: Words, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for row in range(len(found.row_ptr) - 1):
        yield np.unique(shingle_hashes(found.of(row), size))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
