"""Words of an Arrow column as exact codes: one dictionary of distinct words per slice of texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from millrace.llm.textbytes import byte_view

#: Bytes of text that share a dictionary; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Coded(NamedTuple):
    first: int  # row of the column where the slice starts
    rows: int
    doc: np.ndarray  # row within the slice of each word, rising
    start: np.ndarray  # first byte of each word within the slice
    code: np.ndarray  # place of each word in ``words``
    words: pa.Array  # distinct words as bytes, A-Z in lower case
    data: np.ndarray  # the slice's bytes, A-Z in lower case
    offsets: np.ndarray  # where texts start, one more than rows


def coded_slices(column: pa.Array, inside: np.ndarray, size: int = SLICE_BYTES) -> Iterator[Coded]:
    """Slices of whole texts with their words: maximal runs of bytes that ``inside`` accepts.

    NULL is an empty text. Words never cross texts; words and texts of any length are whole.
    """
    data, offsets = byte_view(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(rows, max(last, first + 1))
        own = offsets[first : last + 1] - offsets[first]
        yield _coded(first, LOWER[data[offsets[first] : offsets[last]]], own, inside)
        first = last


def _coded(first: int, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Coded:
    size, rows = len(data), len(offsets) - 1
    kept = inside[data]
    going = np.zeros(size + 1, bool)  # the byte before belongs to the same word
    going[1:size] = kept[:-1] & kept[1:] if size else False
    going[offsets] = False
    start = np.flatnonzero(kept & ~going[:size])
    end = np.flatnonzero(kept & ~going[1:]) + 1
    lengths = end - start
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[kept])]).dictionary_encode()
    doc = np.repeat(np.arange(rows), np.diff(np.searchsorted(start, offsets)))
    return Coded(first, rows, doc, start, words.indices.to_numpy(zero_copy_only=False), words.dictionary, data, offsets)
