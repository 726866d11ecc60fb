"""Language-model scores of texts by logistic mixing of hashed-context bit predictors.

A text is its bytes, A-Z in lower case, and an end. Every byte is eight bits; each bit is predicted by several
contexts: the last 1, 2, 3 and 5 bytes and the word as far as it is written. A context and the bits of the byte
so far lead to a slot that holds how often 0 and 1 came next in training. The predictions
are added in the logistic domain under weights chosen by a gate (bit number and how much is known in the two
strongest contexts), and the sum is refined by an adaptive map over (last byte, bit, predicted odds).

Contexts are short, so a text's bits depend on units only: the last bytes, the word's beginning and the byte that
comes. The training texts are gathered as counts of units, all of them and however many. From these come the slots,
then the weights and the refining map, learnt online over the units, each time with the unit's own
occurrence left out of the slots. Slots, weights and map have a fixed size and are sent to all tasks.

Beside it stands a base: token counts with one added, exact at any size.

Defined results: a NULL or empty text is its end only. Repeated rows count and are scored one by one. Rows without
an id are learnt from. Without any training text the base has a count of 0 for all and bits have even odds at first.
Texts and words of any length are whole; of a long word the last ``WORD_BYTES`` bytes are a context.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from millrace.llm.tables import free_name, saved
from millrace.llm.textbytes import SPACED, byte_view, mix
from millrace.llm.wordcodes import LOWER, coded_slices

END = 0xFF  # no byte of a text
ORDERS, WORD_BYTES = (2, 3, 5), 9
INPUTS = len(ORDERS) + 2  # the word and a constant
#: Slots are doubled with the units up to 2 ** MAX_BITS, 32 MB of counts before they are packed.
MIN_BITS, MAX_BITS = 14, 23
#: The most frequent tokens, whose counts are sent to all tasks; the others are joined.
SENT_TOKENS = 200_000
PIECE, REMEMBERED, GATHERED = 1 << 20, 1_500_000, 1_000_000
STEP, CELLS, REACH = 0.05, 33, 8.0
_BLOCK = 1 << 12

_GAP = 16  # at least as many bytes as a context reaches back
_G = mix(np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_APART = ~SPACED
_APART[END] = True
_MASKS = np.array([(1 << (8 * min(k, 8))) - 1 for k in range(WORD_BYTES + 1)], np.uint64)  # the last bytes of a number


class Units(NamedTuple):
    key: np.ndarray  # hash of the two others
    window: np.ndarray  # the last bytes and the byte that comes
    prefix: np.ndarray  # hash of the word so far


class Piece(NamedTuple):
    units: Units  # distinct ones
    count: np.ndarray  # of each
    code: np.ndarray  # unit of each place in order
    doc: np.ndarray  # texts in the piece, rising
    start: np.ndarray  # first place of each


def pieces(column: pa.Array, piece: int | None = None) -> Iterator[Piece]:
    """The places of all texts of a column, a bounded number at a time; a longer text goes in several pieces."""
    size = piece or PIECE
    data, offsets = byte_view(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(rows, max(last, first + 1))
        own = offsets[first : last + 1] - offsets[first]
        text = data[offsets[first] : offsets[last]]
        if len(text) <= size:
            ends = own[1:] + _GAP * np.arange(1, last - first + 1)
            inside = np.ones(len(text) + _GAP * (last - first + 1), bool)
            inside[:_GAP] = False
            inside[(ends[:, None] + np.arange(_GAP)).ravel()] = False
            buffer = np.full(len(inside), END, np.uint8)
            buffer[inside] = LOWER[text]
            inside[ends] = True
            yield _piece(buffer, inside, np.arange(first, last), own[:-1] + np.arange(last - first))
        else:  # one long text
            for low in range(0, len(text), size):
                high = min(len(text), low + size)
                lead = text[max(0, low - _GAP) : low] if low else np.zeros(0, np.uint8)
                parts = [np.full(_GAP - len(lead), END, np.uint8), lead, text[low:high]] + ([np.full(1, END, np.uint8)] if high == len(text) else [])
                buffer = LOWER[np.concatenate(parts)]
                inside = np.ones(len(buffer), bool)
                inside[:_GAP] = False
                yield _piece(buffer, inside, np.array([first]), np.zeros(1, np.int64))
        first = last


def _piece(buffer: np.ndarray, inside: np.ndarray, doc: np.ndarray, start: np.ndarray) -> Piece:
    """``buffer``: bytes with END before and behind every text; ``inside``: the places that are predicted."""
    # Eight bytes as one number: the byte of a place and the seven before it; then those before these.
    eight = np.ndarray((len(buffer) - 7,), ">u8", buffer.tobytes(), strides=(1,)).astype(np.uint64)
    inside = inside[_GAP:]
    near, far = eight[_GAP - 7 :][inside], eight[_GAP - 15 : -8][inside]
    place = np.arange(len(buffer), dtype=np.int32)
    begun = np.maximum.accumulate(np.where(_APART[buffer[:-1]], place[1:], 0))  # where the word before the next byte starts
    length = np.minimum(place[_GAP:] - begun[_GAP - 1 :], WORD_BYTES)[inside]
    prefix = ((near >> np.uint64(8)) & _MASKS[length]) * _G[0] + (far & _MASKS[np.maximum(length, 7) - 7]) * _G[1] + length.astype(np.uint64)
    prefix = (prefix ^ (prefix >> np.uint64(29))) * _G[2]
    window = near & np.uint64((1 << (8 * (ORDERS[-1] + 1))) - 1)
    key = _key(window, prefix)
    one, code = _first_places(key)
    return Piece(Units(key[one], window[one], prefix[one]), np.bincount(code, minlength=len(one)), code, doc, start)


def _key(window: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    key = window * _G[3] + prefix
    key = (key ^ (key >> np.uint64(32))) * _G[4]
    return key ^ (key >> np.uint64(29))


def _first_places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct key, number of the key of each place).

    Places write their number into a slot by hash; those whose slot was won by another key try a further table.
    """
    code = np.empty(len(key), np.int32)
    found, count, left = [], 0, None
    for turn in range(4):
        own = key if left is None else key[left]
        bits = max(4, len(own).bit_length() - 1)
        slot = ((own * _G[5 + turn]) >> np.uint64(64 - bits)).astype(np.int32)
        table = np.empty(1 << bits, np.int32)
        table[slot] = np.arange(len(own), dtype=np.int32)
        winner = table[slot]
        won = own[winner] == own
        first = np.flatnonzero(winner == np.arange(len(own), dtype=np.int32))
        number = np.empty(len(own), np.int32)
        number[first] = np.arange(count, count + len(first), dtype=np.int32)
        where = won if left is None else left[won]
        code[where] = number[winner[won]]
        found.append(first if left is None else left[first])
        count += len(first)
        left = np.flatnonzero(~won) if left is None else left[~won]
        if not len(left):
            break
    if len(left):
        _, first, rest = np.unique(key[left], return_index=True, return_inverse=True)
        code[left] = rest + count
        found.append(left[first])
    return np.concatenate(found), code


def _summed(parts: list[tuple[Units, np.ndarray]]) -> tuple[Units, np.ndarray]:
    """Distinct units by rising key with the sums of their counts."""
    whole = lambda column: np.concatenate([p[0][column] for p in parts])  # noqa: E731  one column at a time
    key = whole(0)
    if not len(key):
        return parts[0]
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    first = order[starts]
    count = np.add.reduceat(np.concatenate([p[1] for p in parts])[order], starts)
    del order
    return Units(key[starts], whole(1)[first], whole(2)[first]), count


# Training.


def gather_units(texts: DataFrame) -> DataFrame:
    """(bucket, units, window, prefix, n): how often each unit occurs in a column of texts, packed as 64-bit numbers.

    A bucket is a range of hashes; tasks send what they have counted bucket by bucket, where it is added up.
    """
    buckets = max(1024, 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width, piece_bytes, gathered = np.uint64((1 << 64) // buckets + 1), PIECE, GATHERED

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            for piece in pieces(batch.column(0), piece_bytes):
                parts.append((piece.units, piece.count))
                waiting += len(piece.count)
                if waiting > gathered:
                    parts, waiting = [_summed(parts)], 0
                    if len(parts[0][1]) > gathered:
                        yield from split(*parts.pop())
        if parts:
            yield from split(*_summed(parts))

    def split(units: Units, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        bucket = (units.key // width).astype(np.int64)
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(starts[1:], len(bucket))
        for low in range(0, len(starts), 64):
            yield _packed([(int(bucket[i]), Units(*(c[i:j] for c in units)), counts[i:j]) for i, j in zip(starts[low : low + 64], ends[low : low + 64])])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, parts, waiting = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                if number != bucket:
                    yield from settled(bucket, parts)
                    bucket, parts, waiting = number, [], 0
                window, prefix, n = _unpacked(batch, i)
                parts.append((Units(_key(window, prefix), window, prefix), n))
                waiting += len(n)
                if waiting > gathered and len(parts) > 1:
                    parts, waiting = [_summed(parts)], 0
        yield from settled(bucket, parts)

    def settled(bucket: int | None, parts: list) -> Iterator[pa.RecordBatch]:
        if parts:
            units, counts = _summed(parts)
            for low in range(0, len(counts), 1 << 16):
                own = slice(low, low + (1 << 16))
                yield _packed([(bucket, Units(*(c[own] for c in units)), counts[own])])

    schema = "bucket int, units long, window binary, prefix binary, n binary"
    return texts.mapInArrow(work, schema).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema)


def _packed(rows: list[tuple[int, Units, np.ndarray]]) -> pa.RecordBatch:
    blobs = [pa.array([c.tobytes() for c in column], pa.binary()) for column in zip(*((u.window, u.prefix, n) for _, u, n in rows))] if rows else [pa.array([], pa.binary())] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([len(r[2]) for r in rows], pa.int64()), *blobs], ["bucket", "units", "window", "prefix", "n"]
    )


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in ((2, np.uint64), (3, np.uint64), (4, np.int64)))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, prefix, n) of the units in a task's rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield _unpacked(batch, i)


class Slots:
    """Places of (context, bits so far) in a table of 2 ** bits slots."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)

    def of(self, window: np.ndarray, prefix: np.ndarray) -> list[np.ndarray]:
        """A hash for each context."""
        past = window >> np.uint64(8)
        orders = [mix((past & np.uint64((1 << (8 * k)) - 1)) + _G[k]) for k in ORDERS]
        return [*orders, mix(prefix + _G[9])]

    def at(self, context: np.ndarray, node: np.ndarray) -> np.ndarray:
        return (((context ^ _G[16 + node]) * _G[10]) >> self.shift).view(np.int64)


def _bits(window: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, bits of the byte so far, next bit) for the eight bits of the byte that comes."""
    byte = (window & np.uint64(255)).astype(np.int64)
    for j in range(8):
        yield j, (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def fill_slots(units: DataFrame, bits: int) -> np.ndarray:
    """Counts of 0 and 1 in every slot, summed by blocks; a pair that passes 16 bits is halved until it fits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, table, held = Slots(bits), np.zeros(2 << bits, np.uint32), 0
        for window, prefix, n in _columns(batches):
            if held + int(n.sum()) > 1 << 26:  # at most 40 places of a unit meet in a slot
                yield from _blocks(table)
                table[:], held = 0, 0
            if int(n.sum()) > 1 << 26:
                large = np.zeros(2 << bits, np.uint64)
                _add(slots, large, window, prefix, n)
                yield from _blocks(large)
            else:
                _add(slots, table, window, prefix, n)
                held += int(n.sum())
        yield from _blocks(table)

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = np.zeros(2 * _BLOCK, np.uint64)
        for counts in group.column("counts"):
            total += np.frombuffer(counts.as_py(), np.uint64)
        pairs = total.reshape(-1, 2)
        while (large := pairs.max(axis=1) > 0xFFFF).any():
            pairs[large] >>= np.uint64(1)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([pairs.astype(np.uint16).tobytes()], pa.binary())})

    schema = "block long, counts binary"
    rows = units.mapInArrow(work, schema).groupBy("block").applyInArrow(add, schema).toArrow()
    out = np.zeros(((1 << bits) // _BLOCK, 2 * _BLOCK), np.uint16)
    for number, counts in zip(rows.column(0).to_pylist(), rows.column(1)):
        out[number] = np.frombuffer(counts.as_py(), np.uint16)
    return out.reshape(-1, 2)


def _add(slots: Slots, table: np.ndarray, window: np.ndarray, prefix: np.ndarray, n: np.ndarray) -> None:
    times = n.astype(table.dtype)
    for context in slots.of(window, prefix):
        for _, node, bit in _bits(window):
            np.add.at(table, 2 * slots.at(context, node) + bit, times)


def _blocks(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    blocks = table.reshape(-1, 2 * _BLOCK)
    for number in np.flatnonzero(blocks.any(axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([blocks[number].astype(np.uint64).tobytes()], pa.binary())], ["block", "counts"])


def _odds(counts: np.ndarray) -> np.ndarray:
    return np.log((counts[..., 1] + 0.4) / (counts[..., 0] + 0.4)).astype(np.float32)


def _known(total: np.ndarray) -> np.ndarray:
    """Four degrees of how much is known: nothing, little, some, much."""
    return (total > 0).astype(np.uint8) + (total > 2) + (total > 15)


class Model(NamedTuple):
    bits: int
    shared: Broadcast  # the slots' counts, packed
    weights: np.ndarray  # (gate, input)
    refine: np.ndarray  # (last byte, bit, cell): probability of 1


class Table(NamedTuple):
    counts: np.ndarray | None  # pairs, while learning
    odds: np.ndarray | None
    known: np.ndarray | None


_TABLES: list[tuple[bytes, bool, Table]] = []


def table_of(model: Model, learning: bool) -> Table:
    """The slots as a worker holds them, unpacked once."""
    packed = model.shared.value
    if not _TABLES or _TABLES[0][0] is not packed or _TABLES[0][1] != learning:
        _TABLES.clear()
        counts = np.frombuffer(pa.decompress(packed, 4 << model.bits, codec="zstd"), np.uint16).reshape(-1, 2)
        if learning:
            table = Table(counts, None, None)
        else:
            odds, known = np.empty(len(counts), np.float32), np.empty(len(counts), np.uint8)
            for low in range(0, len(counts), 1 << 16):
                own = slice(low, low + (1 << 16))
                odds[own] = _odds(counts[own].astype(np.float32))
                known[own] = _known(counts[own].sum(axis=1, dtype=np.int64))
            table = Table(None, odds, known)
        _TABLES.append((packed, learning, table))
    return _TABLES[0][2]


def start_model(spark: SparkSession, bits: int, counts: np.ndarray) -> Model:
    packed = pa.compress(counts.tobytes(), codec="zstd", asbytes=True)
    weights = np.full((128, INPUTS), 0.3, np.float32)
    weights[:, -1] = 0
    cells = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, CELLS)))
    return Model(bits, spark.sparkContext.broadcast(packed), weights, np.broadcast_to(cells, (256, 8, CELLS)).astype(np.float32).copy())


def predictions(model: Model, window: np.ndarray, prefix: np.ndarray, left_out: bool = False) -> Iterator[tuple]:
    """(bit number, next bit, inputs, gate, last byte) for the eight bits of each unit.

    With ``left_out`` one occurrence of the unit itself is taken off the slots it counts in.
    """
    slots, table = Slots(model.bits), table_of(model, left_out)
    contexts = slots.of(window, prefix)
    last = ((window >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    for j, node, bit in _bits(window):
        inputs = np.ones((INPUTS, len(window)), np.float32)
        known = []
        for k, context in enumerate(contexts):
            at = slots.at(context, node)
            if left_out:
                pair = table.counts[at].astype(np.float32)
                pair[np.arange(len(at)), bit] -= 1
                np.maximum(pair, 0, out=pair)  # halved counts may have lost the rare side
                inputs[k] = _odds(pair)
                if k >= INPUTS - 3:
                    known.append(_known(pair.sum(axis=1)))
            else:
                inputs[k] = table.odds[at]
                if k >= INPUTS - 3:
                    known.append(table.known[at])
        yield j, bit, inputs, (j * 4 + known[0]) * 4 + known[1].astype(np.int64), last


def mixed(model: Model, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
    total = np.zeros(len(gate), np.float32)
    for k in range(INPUTS):
        total += model.weights[gate, k] * inputs[k]
    return np.clip(total, -REACH, REACH)


def _cell(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spot = (total + REACH) * ((CELLS - 1) / (2 * REACH))
    low = np.minimum(spot.astype(np.int64), CELLS - 2)
    return low, (spot - low).astype(np.float32)


def code_lengths(model: Model, window: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Bits that each unit's byte costs."""
    out = np.zeros(len(window))
    for low in range(0, len(window), 1 << 15):
        own = slice(low, low + (1 << 15))
        for j, bit, inputs, gate, last in predictions(model, window[own], prefix[own]):
            total = mixed(model, inputs, gate)
            cell, share = _cell(total)
            refined = model.refine[last, j, cell] * (1 - share) + model.refine[last, j, cell + 1] * share
            one = np.clip(0.5 / (1 + np.exp(-total)) + 0.5 * refined, 1e-6, 1 - 1e-6).astype(np.float64)
            out[own] -= np.log2(np.where(bit == 1, one, 1 - one))
    return out


def learn(units: DataFrame, model: Model) -> Model:
    """The model with weights and refining map, learnt online over all units in every task and put together.

    Weights are averaged by what each gate saw; the map's shares are those of all tasks' predictions.
    """
    gates, size = len(model.weights), model.refine.size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model._replace(weights=model.weights.copy())
        past = np.full(own.weights.shape, 1e-4)
        seen, ones, all_, kept = np.zeros(gates), np.zeros(size), np.zeros(size), []
        for window, prefix, n in _columns(batches):
            for low in range(0, len(window), 4096):
                part = slice(low, low + 4096)
                times = n[part].astype(np.float64)
                for j, bit, inputs, gate, last in predictions(own, window[part], prefix[part], True):
                    total = mixed(own, inputs, gate)
                    miss = times * (1 / (1 + np.exp(-total)) - bit)
                    here = np.bincount(gate, times, gates)
                    slope = np.stack([np.bincount(gate, miss * inputs[k], gates) for k in range(INPUTS)], 1) / np.maximum(here, 1e-9)[:, None]
                    past += slope * slope
                    own.weights[:] -= (STEP * slope / np.sqrt(past)).astype(np.float32)
                    seen += here
                    cell, share = _cell(total)
                    flat = (last * 8 + j) * CELLS + cell
                    kept.append((np.concatenate([flat, flat + 1]), np.concatenate([times * (1 - share), times * share]), np.concatenate([bit, bit])))
                if len(kept) >= 128:
                    _count_cells(kept, ones, all_)
        _count_cells(kept, ones, all_)
        each = np.repeat(seen, INPUTS)
        here = np.flatnonzero(all_)
        sums = np.concatenate([own.weights.astype(np.float64).ravel() * each, ones[here]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.arange(len(each)), here + len(each)])), pa.array(sums), pa.array(np.concatenate([each, all_[here]]))], ["i", "value", "n"]
        )

    rows = units.mapInArrow(work, "i long, value double, n double").groupBy("i").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).where("n > 0").toArrow()
    i, value, n = (c.to_numpy() for c in rows.columns)  # as many as weights and cells
    weights, refine = model.weights.copy().ravel(), model.refine.copy().ravel()
    own = i < len(weights)
    weights[i[own]] = value[own] / n[own]
    cells = i[~own] - len(weights)
    refine[cells] = (value[~own] + 20 * refine[cells]) / (n[~own] + 20)
    return model._replace(weights=weights.reshape(model.weights.shape), refine=refine.reshape(model.refine.shape))


def _count_cells(kept: list, ones: np.ndarray, all_: np.ndarray) -> None:
    if kept:
        cell, weight, bit = (np.concatenate(c) for c in zip(*kept))
        all_ += np.bincount(cell, weight, len(all_))
        ones += np.bincount(cell, weight * bit, len(ones))
        kept.clear()


def fit(texts: DataFrame) -> Model:
    """The model of a frame with one column of texts."""
    units = saved(gather_units(texts), "units")
    bits = min(MAX_BITS, max(MIN_BITS, (units.agg(F.sum("units")).first()[0] or 0).bit_length() + 2))
    return learn(units, start_model(texts.sparkSession, bits, fill_slots(units, bits)))


# Scores.


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) of all words of a column of texts; the end of a text is the empty token."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in coded_slices(batch.column(0), SPACED):
                words = pa.concat_arrays([part.words.cast(pa.large_string()).cast(pa.string()), pa.array([""])])
                counts = np.append(np.bincount(part.code, minlength=len(part.words)), part.rows)
                yield pa.RecordBatch.from_arrays([words, pa.array(counts, pa.int64())], ["token", "c"])

    return texts.mapInArrow(work, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def score_texts(docs: DataFrame, learn: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score, score and bits_per_byte; learns from rows where ``learn`` holds.

    Columns of these names are replaced; with ``keep`` only those columns stay. Scores are logarithms to base 10.
    """
    piece_bytes = PIECE
    spark, made = docs.sparkSession, ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    train = docs.where(F.coalesce(learn, F.lit(False))).select(body.alias("t"))
    model = fit(train)
    counts = saved(token_counts(train), "tokens")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    last = counts.where("token = ''").first()  # the end of a text
    end_log = math.log10(last.c + 1) if last else 0.0
    often = counts.where("token <> ''").orderBy(F.desc("c"), "token").limit(SENT_TOKENS).toArrow()
    sent = spark.sparkContext.broadcast((often.column(0).combine_chunks().cast(pa.large_binary()), often.column(1).to_numpy()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, often_counts = sent.value
        logs = np.log10(often_counts + 1.0)
        remembered = remembered_by(model)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            bits = np.zeros(batch.num_rows)
            for piece in pieces(column, piece_bytes):
                bits[piece.doc] += np.add.reduceat(remembered.lengths(piece.units)[piece.code], piece.start)
            size = np.diff(byte_view(column)[1])
            for part in coded_slices(column, SPACED, 4 << 20):
                own = slice(part.first, part.first + part.rows)
                found = pc.index_in(part.words, value_set=names).fill_null(-1).to_numpy()
                places = found[part.code] if len(found) else np.zeros(0, np.int64)
                often_one = places >= 0
                tokens = np.bincount(part.doc, minlength=part.rows) + 1
                known = np.bincount(part.doc[often_one], minlength=part.rows) + (last is not None)
                sums = np.bincount(part.doc[often_one], logs[places[often_one]], part.rows) + end_log
                # Other tokens are listed once for each text and looked up by a join.
                both, times = np.unique(part.doc[~often_one] * max(1, len(part.words)) + part.code[~often_one], return_counts=True)
                doc, code = np.divmod(both, max(1, len(part.words)))
                ends = np.zeros(part.rows + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=part.rows), out=ends[1:])
                rare = part.words.cast(pa.large_string()).cast(pa.string()).take(pa.array(code))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(part.first, part.rows) for i in range(batch.num_columns - 1)), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(sums), pa.array(bits[own]), pa.array(size[own], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), rare), pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32)))],
                    schema.names,
                )

    columns = docs.columns if keep is None else keep
    named = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)], body.alias("_t"))
    extra = "_tokens long, _known long, _sum double, _bits double, _size long, _rare array<string>, _times array<int>"
    schema = T.StructType([*named.drop("_t").schema.fields, *T.StructType.fromDDL(extra).fields])
    scored = named.mapInArrow(work, schema)
    row = free_name(scored.columns, "_row")
    scored = saved(scored.withColumn(row, F.monotonically_increasing_id()), "scored")
    model.shared.unpersist()
    sent.unpersist()
    rare = scored.select(row, F.explode(F.arrays_zip("_rare", "_times")).alias("z")).select(row, F.col("z._rare").alias("token"), F.col("z._times").alias("times"))
    found = rare.join(counts, "token").groupBy(row).agg(F.sum("times").cast("bigint").alias("_more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("_added"))
    joined = scored.drop("_rare", "_times").join(found, row, "left")
    known = F.col("_known") + F.coalesce("_more", F.lit(0))
    base = F.col("_sum") + F.coalesce("_added", F.lit(0.0)) - F.col("_tokens") * F.lit(math.log10(total + kinds + 1))
    others = [F.col(f"_{i}").alias(c) for i, c in enumerate(columns) if c.lower() not in made]
    return joined.select(
        *others, F.col("_tokens").alias("n_tokens"), known.cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), base.alias("base_score"),
        (F.col("_bits") * F.lit(-math.log10(2))).alias("score"), (F.col("_bits") / (F.col("_size") + 1)).alias("bits_per_byte"),
    )


class Remembered:
    """Code lengths of units, a bounded number of them kept from earlier pieces."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.bits = np.zeros(0, np.uint64), np.zeros(0)

    def lengths(self, units: Units) -> np.ndarray:
        order = np.argsort(units.key)
        key = units.key[order]
        at = np.searchsorted(self.keys, key)
        old = np.zeros(len(at), bool)
        inside = at < len(self.keys)
        old[inside] = self.keys[at[inside]] == key[inside]
        values = np.zeros(len(at))
        values[old] = self.bits[at[old]]
        new = np.flatnonzero(~old)
        values[new] = code_lengths(self.model, units.window[order[new]], units.prefix[order[new]])
        new = new[: max(0, REMEMBERED - len(self.keys))]
        self.keys = np.insert(self.keys, at[new], key[new])
        self.bits = np.insert(self.bits, at[new], values[new])
        out = np.empty(len(order))
        out[order] = values
        return out


_REMEMBERED: list[tuple[bytes, Remembered]] = []


def remembered_by(model: Model) -> Remembered:
    """What a worker remembers for a model, over all its tasks."""
    packed = model.shared.value
    if not _REMEMBERED or _REMEMBERED[0][0] is not packed:
        _REMEMBERED[:] = [(packed, Remembered(model))]
    return _REMEMBERED[0][1]
