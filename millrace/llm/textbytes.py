"""Texts of an Arrow batch as byte arrays: slices of bounded size, words, and hashes of words.

Everything here works on UTF-8 bytes inside a task. A slice holds whole texts and about
``SLICE_BYTES`` bytes, so memory does not follow the batch size; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class TextSlice(NamedTuple):
    first: int  # row of the batch where the slice starts
    data: np.ndarray  # uint8, the texts one after another
    offsets: np.ndarray  # int64, one more than texts


class Words(NamedTuple):
    doc: np.ndarray  # text of the slice, rising
    start: np.ndarray  # first byte
    end: np.ndarray  # byte after the last
    hash: np.ndarray  # uint64


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[TextSlice]:
    data, offsets = byte_view(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(rows, max(last, first + 1))
        own = offsets[first : last + 1]
        yield TextSlice(first, data[own[0] : own[-1]], own - own[0])
        first = last


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=None)
def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for every byte; with ``lower`` A-Z share those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    return values


@lru_cache(maxsize=8)
def powers(count: int) -> np.ndarray:
    out = np.empty(count, np.uint64)
    out[0] = 1
    out[1:] = GOLDEN
    return np.multiply.accumulate(out)


def word_table(breaks: list[tuple[int, int]]) -> np.ndarray:
    """True for bytes that belong to a word; ``breaks`` are inclusive byte ranges that do not."""
    table = np.ones(256, bool)
    for low, high in breaks:
        table[low : high + 1] = False
    return table


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z became a-z) as byte classes.
SPACED = word_table([(0x20, 0x20), (0x09, 0x0D)])
ALPHANUMERIC = word_table([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """Words of the texts of a slice in order; words never cross texts. Long texts go in windows."""
    if len(data) > 4 * SLICE_BYTES:
        return _windowed(data, offsets, table, lower, hashed)
    size = len(data)
    inside = table[data]
    new = np.zeros(size + 1, bool)
    new[offsets] = True
    before = np.zeros(size, bool)
    before[1:] = inside[:-1] & ~new[1:size]
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(size, bool)
    after[:-1] = before[1:] & inside[1:]
    end = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    if not hashed or not len(start):
        return Words(doc, start, end, np.zeros(len(start) if hashed else 0, np.uint64))
    length = end - start
    own = np.flatnonzero(inside)
    at = np.cumsum(length) - length
    place = np.arange(len(own)) - np.repeat(at, length)
    table_size = 1 << max(6, int(length.max()).bit_length())
    return Words(doc, start, end, mix(np.add.reduceat(byte_values(lower)[data[own]] * powers(table_size)[place], at)))


def _windowed(data, offsets, table, lower, hashed) -> Words:
    parts, at, step = [], 0, 2 * SLICE_BYTES
    while at < len(data):
        to = min(len(data), at + step)
        while to < len(data) and table[data[to]] and table[data[to - 1]]:
            to += 1  # to the end of the word
        own = np.concatenate([[0], offsets[(offsets > at) & (offsets < to)] - at, [to - at]])
        found = find_words(data[at:to], own, table, lower, hashed) if to - at <= 4 * SLICE_BYTES else _one_long(data[at:to], table, lower, hashed)
        parts.append((found.start + at, found.end + at, found.hash))
        at = to
    start, end, hashes = (np.concatenate(p) if parts else np.zeros(0, np.int64) for p in zip(*parts))
    return Words(np.searchsorted(offsets, start, "right") - 1, start, end, hashes)


def _one_long(data, table, lower, hashed) -> Words:
    """A window with a word of millions of bytes: its hash is summed piece by piece."""
    inside = np.flatnonzero(np.diff(np.concatenate([[0], table[data].view(np.int8), [0]])))
    start, end = inside[::2], inside[1::2]
    hashes = np.zeros(len(start) if hashed else 0, np.uint64)
    for i in range(len(hashes)):
        total, power = np.uint64(0), np.uint64(1)
        for at in range(start[i], end[i], SLICE_BYTES):
            piece = byte_values(lower)[data[at : min(end[i], at + SLICE_BYTES)]]
            own = powers(SLICE_BYTES + 1)
            with np.errstate(over="ignore"):
                total = total + (piece * own[: len(piece)]).sum(dtype=np.uint64) * power
                power = power * own[SLICE_BYTES]
        hashes[i] = total
    return Words(np.zeros(len(start), np.int64), start, end, mix(hashes))


def shingle_hashes(words: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every run of ``size`` words; with ``short`` a text of fewer words is one run."""
    count = len(words.doc)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    seeds = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
    rows = max(0, count - size + 1)
    whole = words.doc[:rows] == words.doc[size - 1 :] if rows else np.zeros(0, bool)
    total = np.zeros(rows, np.uint64)
    for i in range(size):
        total += words.hash[i : i + rows] * seeds[i]
    doc, hashes = words.doc[:rows][whole], mix(total[whole])
    if not short:
        return doc, hashes
    ids, first, lengths = np.unique(words.doc, return_index=True, return_counts=True)
    few = lengths < size
    if not few.any():
        return doc, hashes
    extra = np.zeros(int(few.sum()), np.uint64)
    for k, (at, n) in enumerate(zip(first[few], lengths[few])):
        extra[k] = (words.hash[at : at + n] * seeds[:n]).sum(dtype=np.uint64) + np.uint64(n)
    doc, hashes = np.concatenate([doc, ids[few]]), np.concatenate([hashes, mix(extra)])
    order = np.argsort(doc, kind="stable")
    return doc[order], hashes[order]


def distinct_per_doc(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text, sorted by (text, hash)."""
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if not len(doc):
        return doc, hashes
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[keep], hashes[keep]
