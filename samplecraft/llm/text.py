"""Arrow/NumPy word helpers for the operators whose work runs in Arrow batches.

All of them take a whole string column (null = empty) and work on its UTF-8
bytes; a batch is cut by rows so that the temporary arrays stay small.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BATCH_BYTES = 2 << 20

#: ASCII white space: 0x20 and 0x09-0x0D
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARKS = np.zeros(256, dtype=bool)
_MARKS[[ord(c) for c in ".,;:!?"]] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words(NamedTuple):
    data: np.ndarray       # uint8, the batch's text
    doc_off: np.ndarray    # int64, n_docs + 1 byte offsets
    in_word: np.ndarray    # bool per byte
    starts: np.ndarray     # int64 byte offset of each word
    ends: np.ndarray
    doc: np.ndarray        # int64 document of each word
    word_off: np.ndarray   # int64, n_docs + 1: words of document d are word_off[d]:word_off[d+1]


def byte_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty, slices are honoured."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1, offset=8 * col.offset)
    if col.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0]:off[-1]]
    return data, off - off[0]


def find_words(col: pa.Array, split_marks: bool = False) -> Words:
    """The runs of non-space bytes of every row.

    ``split_marks``: also cut between an ASCII letter and one of ``. , ; : ! ?``.
    """
    data, off = byte_view(col)
    word = ~_SPACE[data]
    first = word.copy()
    if split_marks:
        cut = _MARKS[data[1:]] & _LETTERS[data[:-1]]
        first[1:] &= ~word[:-1] | cut
    else:
        first[1:] &= ~word[:-1]
    head = off[:-1][off[:-1] < len(data)]
    first[head] = word[head]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    word_off = np.searchsorted(starts, off, side="left")
    doc = np.repeat(np.arange(len(off) - 1), np.diff(word_off))
    return Words(data, off, word, starts, ends, doc, word_off)


def span_strings(data: np.ndarray, keep: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings made of the kept bytes, cut into ``lengths``."""
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    return pa.Array.from_buffers(pa.large_string(), len(lengths),
                                 [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[keep]))])


def word_ids(w: Words) -> tuple[np.ndarray, pa.Array]:
    """(dense id of every word, the distinct words); exact, no hashing."""
    if not len(w.starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    d = span_strings(w.data, w.in_word, w.ends - w.starts).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix of an integer array (splitmix64's finaliser)."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@functools.cache
def _malloc_trim():
    """glibc's ``malloc_trim``; nothing where the C library has none."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError, TypeError):
        return lambda pad: 0


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on through other tasks and stages."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def sub_batches(batch: pa.RecordBatch, column: str, max_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices with at most ``max_bytes`` of text (one longer row stays alone).

    What a slice's work has freed goes back to the system before the next one.
    """
    _, off = byte_view(batch.column(batch.schema.get_field_index(column)))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo)
        give_back()
        lo = hi

