"""Byte-level BPE by replaying the merges over a whole vocabulary of pieces.

Texts are cut by the tokenizer's pattern. The distinct pieces of a stretch of text form one table of
symbols. An inverted index leads from a token pair's rank to its positions in all pieces; merges are
applied in rank order, each to every position at once, and only the two neighbours of a merge enter the
index anew. Short pieces, nearly all, share arrays: their index holds one number for each pair, ordered by
piece, rank and place, and a pass merges the first pair of every piece. Longer ones share an index of lists.
Each piece is then looked up for its ids. A stretch holds a bounded number of new pieces, and
a task remembers a bounded number of pieces from earlier stretches; neither changes a result. When the task ends
they are given up, since its worker stays and waits for tasks of other stages.

Defined results: NULL and empty texts have no tokens. Special tokens are ordinary text. A text that
cannot be UTF-8 cannot occur in a string column. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

# Bounds of memory and steps of the index by rank; none changes a result.
NEW_PIECES = 25_000
REMEMBERED = 100_000
PAIRS = 300_000
SHORT_BITS = 6  # short pieces have at most as many bytes as this many bits can count
SHORT_BYTES = 1 << 19
STRETCH_CHARS = 8 << 20
LONG_TEXT = 4 << 20
RANK_STEPS = 4
OUT_ROWS = 512  # rows of a batch that leaves a task


class PairRanks:
    """Ranks of all pairs of tokens that join to a token, by open addressing in arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        self.width = max(ranks.values()) + 1
        keys, found = array("q"), array("i")
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None:
                    right = ranks.get(token[cut:])
                    if right is not None:
                        keys.append(left * self.width + right)
                        found.append(rank)
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.found = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        todo, values = np.frombuffer(keys, np.int64), np.frombuffer(found, np.int32)
        at = self.slots(todo)
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = todo[free]  # one of those that meet stays
            own = self.keys[at] == todo
            self.found[at[own]] = values[own]
            todo, values, at = todo[~own], values[~own], (at[~own] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each joined token, -1 if it is none; so too where a side is no symbol."""
        keys = left * np.int64(self.width) + right
        at = self.slots(keys)
        held = self.keys[at]
        found = np.where(held == keys, self.found[at], np.int32(-1))
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.found[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
        found[(left < 0) | (right < 0)] = -1
        return found


class Merges:
    """Ranks of a vocabulary file of lines ``base64 rank``."""

    pair_ranks: PairRanks | None = None  # made when first needed

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs: dict[tuple[int, int], int] = {}

    def merged(self, left: int, right: int) -> int:
        """Id of the joined token, -1 if it is none. Ids are ranks."""
        found = self.pairs.get((left, right))
        if found is None:
            found = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
            self.pairs[left, right] = found
        return found

    def replay(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        if len(self.pairs) >= PAIRS:  # those that are met below are looked up again
            self.pairs.clear()
        out: list[bytes] = [b""] * len(pieces)
        short: list[int] = []
        long: list[int] = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = array("I", (whole,)).tobytes()
            else:
                (long if len(piece) >> SHORT_BITS else short).append(k)
        size, block = 0, []
        for k in short:
            block.append(k)
            size += len(pieces[k])
            if size >= SHORT_BYTES:
                self.replay_short(pieces, block, out)
                size, block = 0, []
        if block:
            self.replay_short(pieces, block, out)
        if long:
            self.replay_long(pieces, long, out)
        return out

    def replay_short(self, pieces: list[bytes], block: list[int], out: list[bytes]) -> None:
        """Puts the ids of the pieces ``block`` into ``out``; a piece has less than 2 ** SHORT_BITS bytes."""
        if self.pair_ranks is None:
            self.pair_ranks = PairRanks(self.ranks)
        ranks_of = self.pair_ranks.of
        body = np.frombuffer(b"".join([pieces[k] for k in block]), np.uint8)
        sizes = np.array([len(pieces[k]) for k in block])
        # A border before each piece and after the last one: no pair reaches over it.
        start = np.cumsum(sizes + 1) - sizes
        piece = np.repeat(np.arange(len(block), dtype=np.int32), sizes + 1)
        symbols = np.full(len(piece) + 1, -1, np.int32)
        symbols[np.arange(1, len(body) + 1) + np.repeat(np.arange(len(block)), sizes)] = np.array(self.single, np.int32)[body]
        after = np.arange(1, len(symbols) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbols) - 1, dtype=np.int32)
        rank_at = np.full(len(symbols), -1, np.int32)  # of the pair that starts there
        rank_at[:-1] = ranks_of(symbols[:-1], symbols[1:])
        rank_bits = int(self.pair_ranks.width).bit_length()
        low, rank_mask = (1 << SHORT_BITS) - 1, (1 << rank_bits) - 1

        def entries(places: np.ndarray) -> np.ndarray:
            own = piece[places].astype(np.int64)
            return (((own << rank_bits) | rank_at[places]) << SHORT_BITS) | (places - start[own])

        later = entries(np.flatnonzero(rank_at >= 0))
        firsts = np.sort((later >> SHORT_BITS) & rank_mask)
        steps = sorted({int(firsts[len(firsts) * s // RANK_STEPS]) for s in range(1, RANK_STEPS)} if len(firsts) else ())
        for end in [*steps, self.pair_ranks.width]:
            now = ((later >> SHORT_BITS) & rank_mask) < end
            index, later = np.sort(later[now]), [later[~now]]
            while len(index):
                own = index >> (rank_bits + SHORT_BITS)
                places = start[own] + (index & low)
                holds = rank_at[places] == ((index >> SHORT_BITS) & rank_mask)  # else a merge has changed the pair
                index, own, places = index[holds], own[holds], places[holds]
                if not len(index):
                    break
                first = np.empty(len(own), bool)
                first[0] = True
                np.not_equal(own[1:], own[:-1], out=first[1:])
                i = places[first]
                j, h = after[i], before[i]
                k = after[j]
                symbols[i] = rank_at[i]
                symbols[j] = rank_at[j] = -2
                after[i] = k
                before[k] = i
                rank_at[h] = ranks_of(symbols[h], symbols[i])
                rank_at[i] = ranks_of(symbols[i], symbols[k])
                new = np.concatenate([h[rank_at[h] >= 0], i[rank_at[i] >= 0]])
                soon = rank_at[new] < end
                later.append(entries(new[~soon]))
                index = index[~first]
                if soon.any():
                    index = np.sort(np.concatenate([index, entries(new[soon])]))
            later = np.concatenate(later)
        stays = np.flatnonzero(symbols >= 0)
        packed = symbols[stays].tobytes()
        ends = (4 * np.searchsorted(stays, start + sizes)).tolist()
        begin = 0
        for k, stop in zip(block, ends):
            out[k] = packed[begin:stop]
            begin = stop

    def replay_long(self, pieces: list[bytes], block: list[int], out: list[bytes]) -> None:
        """The same for pieces of any length."""
        symbols: list[int] = []
        ends = array("q")
        for k in block:
            symbols.extend([self.single[b] for b in pieces[k]])
            symbols.append(-1)  # no pair reaches over a border
            ends.append(len(symbols))
        after = array("q", range(1, len(symbols) + 1))
        before = array("q", range(-1, len(symbols) - 1))
        index: dict[int, list[int]] = {}
        merged, pairs = self.merged, self.pairs
        for i in range(len(symbols) - 1):
            left, right = symbols[i], symbols[i + 1]
            if left >= 0 and right >= 0:
                rank = pairs.get((left, right))
                if rank is None:
                    rank = merged(left, right)
                if rank >= 0:
                    if rank in index:
                        index[rank].append(i)
                    else:
                        index[rank] = [i]
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()  # leftmost first, as in a single piece
            for at, i in enumerate(places):
                left = symbols[i]
                if left < 0:
                    continue
                j = after[i]
                right = symbols[j] if j < len(symbols) else -1
                if right < 0 or pairs.get((left, right)) != rank:
                    continue
                symbols[i] = rank
                symbols[j] = -2
                k = after[j]
                after[i] = k
                before[k] = i  # there is always a border symbol behind
                smaller = False
                h = before[i]
                for a, b in ((h, i), (i, k)):
                    if a >= 0 and symbols[a] >= 0 and symbols[b] >= 0:
                        new = pairs.get((symbols[a], symbols[b]))
                        if new is None:
                            new = merged(symbols[a], symbols[b])
                        if new >= 0:
                            if new in index:
                                index[new].append(a)
                            else:
                                index[new] = [a]
                                heapq.heappush(queue, new)
                            smaller |= new < rank
                if smaller and at + 1 < len(places):  # a lower rank arose: it goes first, the rest waits
                    index.setdefault(rank, []).extend(places[at + 1 :])
                    heapq.heappush(queue, rank)
                    break
        start = 0
        for k, end in zip(block, ends):
            out[k] = array("I", [s for s in symbols[start : end - 1] if s >= 0]).tobytes()
            start = end

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load_merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Texts to ids, a stretch at a time."""

    def __init__(self, path: str, pattern: str):
        self.merges = load_merges(path)
        self.find = regex.compile(pattern)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of each text, in order."""
        waiting: list[array] = []
        places: dict[str, int] = {}
        chars = fresh = 0
        for text in texts:
            own = array("I")
            pieces = self.find.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in self.find.finditer(text))
            pieces = iter(pieces)
            while block := list(islice(pieces, 1 << 16)):
                own.extend([places.setdefault(p, len(places)) for p in block])
            waiting.append(own)
            chars += len(text)
            fresh = len(places)
            if fresh >= NEW_PIECES or chars >= STRETCH_CHARS:
                yield from self.settle(waiting, places)
                waiting, places, chars = [], {}, 0
        yield from self.settle(waiting, places)

    def settle(self, waiting: list[array], places: dict[str, int]) -> Iterator[bytes]:
        new = [p for p in places if p not in self.known]
        ids = dict(zip(new, self.merges.replay([p.encode("utf-8") for p in new])))
        table = [ids[p] if p in ids else self.known[p] for p in places]
        self.known.update(islice(ids.items(), max(0, REMEMBERED - len(self.known))))
        for own in waiting:
            yield b"".join([table[i] for i in own])


@lru_cache(maxsize=1)
def load_encoder(path: str, pattern: str) -> Encoder:
    """One encoder for all tasks of a worker process; each task clears the pieces it remembered."""
    return Encoder(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids (array) and decoded (binary).

    ``path`` is a vocabulary file that every executor can read; it is opened once per worker.
    """
    names = docs.columns
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)], F.col(f"`{text}`").cast("string").alias("_t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(path, pattern)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, OUT_ROWS):
                    part = batch.slice(at, OUT_ROWS)
                    column = part.column(part.num_columns - 1)
                    counts, hashes, decoded, ids_out, bytes_out = [], [], [], [], []
                    for packed in encoder.encode(x.as_py() or "" for x in column):
                        counts.append(len(packed) // 4)
                        hashes.append(hashlib.sha256(packed).hexdigest())
                        ids = array("I", packed)
                        body = encoder.merges.decode(ids)
                        decoded.append(hashlib.sha256(body).hexdigest())
                        if with_ids:
                            ids_out.append(packed)
                            bytes_out.append(body)
                    columns = [pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                    if with_ids:
                        ends = pa.array(np.cumsum([0, *counts]), pa.int32())
                        columns += [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids_out), np.int32))), pa.array(bytes_out, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *out[: len(columns)]])
        finally:
            encoder.known.clear()

    out = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    schema = named.drop("_t").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "binary")
    made = out if with_ids else out[:3]
    result = named.mapInArrow(work, schema)
    keep = [(i, c) for i, c in enumerate(names) if c.lower() not in made]
    return result.select(*[F.col(f"_{i}").alias(c) for i, c in keep], *made)
