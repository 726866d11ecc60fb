"""Hashed features of texts for the linear models: word n-grams, skip-grams and byte n-grams."""

from __future__ import annotations

import numpy as np

from millrace.llm.textbytes import Words, byte_values, mix

_SEEDS = mix(np.arange(9001, 9033, dtype=np.uint64)) | np.uint64(1)


def word_grams(words: Words, bits: int, orders: tuple[tuple[int, ...], ...] = ((0,), (0, 1), (0, 2))) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of single words, pairs of neighbours and pairs with one word between, by ``orders``."""
    docs, features = [], []
    for number, places in enumerate(orders):
        rows = len(words.doc) - places[-1]
        if rows <= 0:
            continue
        total = np.full(rows, _SEEDS[16 + number], np.uint64)
        for k, place in enumerate(places):
            total += words.hash[place : place + rows] * _SEEDS[k]
        whole = words.doc[:rows] == words.doc[places[-1] :] if places[-1] else slice(None)
        docs.append(words.doc[:rows][whole])
        features.append((mix(total[whole]) >> np.uint64(64 - bits)).astype(np.int64))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(features)


def stem_grams(data: np.ndarray, words: Words, bits: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of the first ``size`` bytes of longer words: forms of one word share them."""
    long = words.end - words.start > size
    start = words.start[long]
    total = np.full(len(start), _SEEDS[31], np.uint64)
    for k in range(size):
        total += byte_values(True)[data[start + k]] * _SEEDS[k]
    return words.doc[long], (mix(total) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_pairs(doc: np.ndarray, feature: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in order."""
    both = np.unique((doc.astype(np.uint64) << np.uint64(bits)) | feature.astype(np.uint64))
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def byte_trigrams(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every three bytes in a row, letters' case kept."""
    rows = len(data) - 2
    if rows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[:rows].astype(np.uint32) | (data[1 : rows + 1].astype(np.uint32) << 8) | (data[2:].astype(np.uint32) << 16)
    feature = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    start = np.arange(rows)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:rows]
    whole = start + 3 <= offsets[1:][doc]
    return doc[whole], feature[whole].astype(np.int64)
