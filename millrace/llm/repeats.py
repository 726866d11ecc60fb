"""Repeated passages by suffix arrays: every byte under a long string that starts elsewhere too.

A suffix array over a whole corpus does not fit one machine, so suffixes are dealt by content. In
every stretch of ``length`` bytes the smallest hash of a ``SEED``-byte string is its anchor; equal stretches
have the same anchor at the same place, whatever surrounds them. Anchors whose seed occurs once cannot
lie in a repeat and go no further. If all owners of a seed agree on every stretch they own, all of those
are repeats. For the others, suffixes starting at anchors of one seed meet in one bucket: they are sorted,
their common prefixes give an enhanced suffix array, a stack scan walks its intervals, and within each
interval the diversity of the left extensions is tested in the same manner. That yields the maximal repeats
with all their occurrences. A seed with more than ``BUCKET`` undecided owners is not brought together:
its stretches meet one by one by hash, after each task has settled what repeats among its own.

Defined results: strings lie within one text; overlapping occurrences count; NULL is an empty text;
texts shorter than ``length`` have no repeats. Repeated rows are repeats of each other. Bytes are judged on
the input, not on what is left. Strings of ``length`` bytes are compared by 64-bit hashes at the anchors
that are decided without a bucket, and byte by byte in buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.tables import saved
from millrace.llm.textbytes import GOLDEN, byte_values, byte_view, mix

SEED = 64
BUCKET = 10_000
CONTEXT_BYTES = 16 << 20  # different bytes of anchors that a task holds before it sends them on
WINDOW = 1 << 19  # bytes hashed at once
BASE = GOLDEN


class Anchors(NamedTuple):
    text: np.ndarray  # row
    at: np.ndarray  # byte of the text where the seed starts
    low: np.ndarray  # fewest bytes an owned stretch starts before the seed
    high: np.ndarray  # most
    seed: np.ndarray  # hash of the seed
    body: np.ndarray  # hash of all owned stretches


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(BASE), n, 1 << 64))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes, by doubling."""
    out, have = None, 0
    level, width = byte_values(False)[data], 1
    while True:
        if size & width:
            if out is None:
                out, have = level, width
            else:
                n = len(data) - (have + width) + 1
                out = out[:n] * _power(width) + level[have : have + n]
                have += width
        width *= 2
        if width > size:
            return out
        level = level[: -width // 2] * _power(width // 2) + level[width // 2 :]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    level, have = values, 1
    while 2 * have <= width:
        level = np.minimum(level[:-have], level[have:])
        have *= 2
    return level if have == width else np.minimum(level[: len(level) - (width - have)], level[width - have :])


def find_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[Anchors]:
    """Anchors of all texts; a window holds whole texts or overlapping pieces of a long one."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, min(rows, int(np.searchsorted(offsets, offsets[row] + WINDOW, "right")) - 1))
        if last == row + 1 and offsets[last] - offsets[row] > WINDOW:
            for piece in range(int(offsets[row]), int(offsets[last]) - length + 1, WINDOW):
                end = min(int(offsets[last]), piece + WINDOW + length - 1)
                found = _window_anchors(data[piece:end], np.array([0, end - piece]), length)
                yield found._replace(text=found.text + row, at=found.at + (piece - int(offsets[row])))
        else:
            own = offsets[row : last + 1]
            found = _window_anchors(data[own[0] : own[-1]], own - own[0], length)
            yield found._replace(text=found.text + row)
        row = last


def _window_anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Anchors:
    if len(data) < length:
        return Anchors(*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2)
    seeds = mix(rolling(data, SEED))
    place = np.arange(len(seeds), dtype=np.uint64)
    # The place in the low bits makes the leftmost of equal seeds the smallest.
    best = sliding_min((seeds & ~np.uint64(0xFFFFF)) | place, length - SEED + 1)
    owner = (best & np.uint64(0xFFFFF)).astype(np.int64)
    start = np.arange(len(owner))
    text = np.searchsorted(offsets, start, "right") - 1
    inside = start + length <= offsets[text + 1]
    start, owner, text = start[inside], owner[inside], text[inside]
    if not len(start):
        return Anchors(*[np.zeros(0, np.int64)] * 4, *[np.zeros(0, np.uint64)] * 2)
    new = np.ones(len(start), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    at, text = owner[first], text[first]
    high, low = at - start[first], at - start[last]
    # Seeds that cover the first and the last owned stretch stand for all their bytes.
    body = (high * 1024 + low).astype(np.uint64)
    for stretch in (start[first], start[last]):
        for place in (*range(0, length - SEED, SEED), length - SEED):
            body = mix(body * np.uint64(3) + seeds[stretch + place])
    return Anchors(text, at - offsets[text], low, high, seeds[at], body)


def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    if x == y:
        return n
    different = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (different.bit_length() + 7) // 8


def common_prefixes(ordered: list[bytes]) -> list[int]:
    """Common prefix of each string with the one before it in sorted order; 0 for the first."""
    return [0] + [common_prefix(ordered[i - 1], ordered[i]) for i in range(1, len(ordered))]


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the common-prefix tree with depth >= ``least``.

    One scan with a stack over the enhanced suffix array; children come before their parents.
    """
    stack: list[tuple[int, int]] = []  # depth, first
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            if top >= least:
                yield top, first, i - 1
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before, bytes after, members) of the maximal repeats of at least ``length`` bytes around an anchor.

    ``left`` holds reversed texts before the anchor, ``right`` texts from it on. A right interval is one
    depth of agreement behind the anchor. Inside it the left contexts form a tree of their own; a node
    is a maximal repeat if its members are left-diverse (that is what makes it a node) and do not all
    lie in one deeper right interval.
    """
    if len(right) == 2:
        before, after = common_prefix(left[0], left[1]), common_prefix(right[0], right[1])
        if before + after >= length:
            yield before, after, [0, 1]
        return
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = common_prefixes([right[i] for i in order])
    reach = max(map(len, left))
    rank = {member: i for i, member in enumerate(order)}
    for after, first, last in prefix_intervals(lcp, max(1, length - reach)):
        members = sorted(order[first : last + 1], key=left.__getitem__)
        tree = common_prefixes([left[i] for i in members])
        deeper = lcp[first + 1 : last + 1]
        cuts = np.cumsum([0] + [d == after for d in deeper])  # child of each place in the interval
        nodes = list(prefix_intervals(tree, max(1, length - after)))
        if after >= length and min(tree[1:]) == 0:
            nodes.append((0, 0, len(members) - 1))
        for before, a, b in nodes:
            own = members[a : b + 1]
            if len({int(cuts[rank[i] - first]) for i in own}) > 1:
                yield before, after, own


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.encode(F.col(f"`{text}`").cast("string"), "UTF-8"), F.lit(b""))
    # d only keeps texts of one hash apart, so a NULL key may share a number.
    d = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0).cast("bigint")).alias("d")
    return docs.select(d, body.alias("t")).select("d", F.xxhash64("t").alias("h"), "t")


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(d, h, at, low, high, seed, body) of every anchor; d and h name the text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(2))
            for found in find_anchors(data, offsets, length):
                if len(found.at):
                    rows = pa.array(found.text)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(rows), batch.column(1).take(rows), pa.array(found.at, pa.int64()),
                            pa.array(found.low.astype(np.int32)), pa.array(found.high.astype(np.int32)),
                            pa.array(found.seed.view(np.int64)), pa.array(found.body.view(np.int64)),
                        ],
                        ["d", "h", "at", "low", "high", "seed", "body"],
                    )

    return docs.mapInArrow(work, "d long, h long, at long, low int, high int, seed long, body long")


def _contexts(undecided: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Undecided anchors with the bytes of all stretches they own, before (reversed) and from the seed.

    Anchors of a batch with equal bytes are one row, with the lists of their owners.
    """
    # A set: each of several equal rows then yields every anchor once, which is its true multiplicity.
    wanted = undecided.groupBy("d", "h").agg(F.collect_set(F.struct("at", "low", "high", "seed", "n")).alias("w"))
    texts = docs.join(wanted.hint("merge"), ["d", "h"]).select("d", "h", "t", "w")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners: dict[tuple, tuple[list, list, list]] = {}
        held = 0
        for batch in batches:
            for d, h, t, w in zip(*(batch.column(i) for i in range(4))):
                body, d, h = t.as_py(), d.as_py(), h.as_py()
                for x in w.as_py():
                    at = x["at"]
                    row = (x["seed"], x["n"], body[at - x["high"] : at][::-1], body[at : at - x["low"] + length])
                    own = owners.get(row)
                    if own is None:
                        own = owners[row] = ([], [], [])
                        held += len(row[2]) + len(row[3])
                    for values, value in zip(own, (d, h, at)):
                        values.append(value)
                if held > CONTEXT_BYTES:
                    yield _context_batch(owners)
                    owners, held = {}, 0
        yield _context_batch(owners)

    return texts.mapInArrow(work, "seed long, n long, d array<long>, h array<long>, at array<long>, before binary, after binary")


def _context_batch(owners: dict[tuple, tuple[list, list, list]]) -> pa.RecordBatch:
    columns = [[row[0] for row in owners], [row[1] for row in owners], *([own[i] for own in owners.values()] for i in range(3)), [row[2] for row in owners], [row[3] for row in owners]]
    kinds = [pa.int64()] * 2 + [pa.list_(pa.int64())] * 3 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["seed", "n", "d", "h", "at", "before", "after"])


def _bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of each seed, read in sorted order; a bucket is bounded by ``BUCKET``."""
    now, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != now and group:
                yield group
                group = []
            now = row[0]
            group.append(row)
    if group:
        yield group


def bucket_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(repeat, d, h, start, end): maximal repeats within the bytes around each anchor, all occurrences."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(5)]
        for group in _bucket_groups(batches):
            for k, (before, after, members) in enumerate(maximal_repeats([r[5] for r in group], [r[6] for r in group], length) if len(group) > 1 else ()):
                for i in members:
                    for d, h, at in zip(*group[i][2:5]):
                        for column, value in zip(out, (f"{group[i][0] & (1 << 64) - 1:016x}.{k}", d, h, at - before, at + after)):
                            column.append(value)
                if len(out[0]) > 20_000:
                    yield _spans_batch(out)
                    out = [[] for _ in range(5)]
        yield _spans_batch(out)

    return _in_buckets(contexts).mapInArrow(work, "repeat string, d long, h long, start long, end long")


def bucket_spans(contexts: DataFrame, length: int) -> DataFrame:
    """(d, h, start, end): what the maximal repeats of a bucket cover of each member.

    All repeats of a member reach over its anchor, so together they are one span. Members with equal
    bytes repeat each other whole and go through the suffix array once.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(4)]
        for group in _bucket_groups(batches):
            if sum(len(row[2]) for row in group) < 2:
                continue
            equal: dict[tuple[bytes, bytes], list[int]] = {}
            for i, row in enumerate(group):
                equal.setdefault(row[5:7], []).append(i)
            texts = list(equal)
            reach = [(len(x[0]), len(x[1])) if sum(len(group[i][2]) for i in own) > 1 else (0, 0) for x, own in equal.items()]
            if len(texts) > 1:
                for before, after, members in maximal_repeats([x[0] for x in texts], [x[1] for x in texts], length):
                    for m in members:
                        b, a = reach[m]
                        if before > b or after > a:
                            reach[m] = (max(before, b), max(after, a))
            for (before, after), own in zip(reach, equal.values()):
                if after:
                    for i in own:
                        for d, h, at in zip(*group[i][2:5]):
                            for column, value in zip(out, (d, h, at - before, at + after)):
                                column.append(value)
            if len(out[0]) > 20_000:
                yield _plain_batch(out)
                out = [[] for _ in range(4)]
        yield _plain_batch(out)

    return _in_buckets(contexts).mapInArrow(work, "d long, h long, start long, end long")


def _in_buckets(contexts: DataFrame) -> DataFrame:
    return contexts.repartition("seed").sortWithinPartitions("seed", "before", "after")


def _plain_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["d", "h", "start", "end"])


def _spans_batch(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(out, [pa.string()] + [pa.int64()] * 4)], ["repeat", "d", "h", "start", "end"]
    )


def _stretches(before: bytes, after: bytes, length: int) -> np.ndarray:
    """Hash of every stretch an anchor owns, in order; the first starts ``len(before)`` bytes before it."""
    body = np.frombuffer(before[::-1] + after, np.uint8)
    return mix(rolling(body, length)).view(np.int64) if len(body) >= length else np.zeros(0, np.int64)


def counted_repeats(contexts: DataFrame, length: int) -> DataFrame:
    """(d, h, s) for seeds with too many owners: their stretches meet by hash, one by one; s holds spans of a text.

    A task settles at once what repeats among its own stretches and passes on one row for each
    different stretch. So a stretch that a third of all texts share arrives once per batch of owners, and
    the rows that meet never exceed the stretches.
    """

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2_000):
                part = batch.slice(low, 2_000)
                before, after = part.column(5).to_pylist(), part.column(6).to_pylist()
                found = [_stretches(x, y, length) for x, y in zip(before, after)]
                sizes = np.array([len(w) for w in found])
                if not sizes.sum():
                    continue
                d, h, at = (part.column(k).flatten().to_numpy() for k in (2, 3, 4))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in part.column(2)])])  # where the owners of a row start
                whole = np.concatenate(found)
                row = np.repeat(np.arange(len(sizes)), sizes)
                place = np.arange(len(whole)) - np.repeat(np.cumsum(sizes) - sizes, sizes) - np.array([len(x) for x in before])[row]  # from the anchor
                _, one, back = np.unique(whole, return_index=True, return_inverse=True)
                met = np.bincount(back, np.diff(ends)[row])[back] > 1  # every owner of a row has its stretches
                # Runs of repeated stretches of one row, for each of its owners.
                new, last = met.copy(), met.copy()
                new[1:] &= ~(met[:-1] & (row[1:] == row[:-1]))
                last[:-1] &= ~(met[1:] & (row[1:] == row[:-1]))
                opened, closed = np.flatnonzero(new), np.flatnonzero(last)
                times = np.diff(ends)[row[opened]]
                owner = np.repeat(ends[row[opened]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(opened) else np.zeros(0, np.int64)
                starts, stops = np.repeat(place[opened], times) + at[owner], np.repeat(place[closed] + length, times) + at[owner]
                yield _settled_batch(d[owner], h[owner], starts, stops)
                first = ends[row[one]]
                yield _stretch_batch(d[first], h[first], place[one] + at[first], length, whole[one], met[one])

    # Owners of hot seeds may lie together; dealt by content, every task gets its share.
    dealt = contexts.repartition(F.xxhash64("before", "after", "seed"), F.element_at("d", 1))
    rows = saved(dealt.mapInArrow(settle, "d long, h long, s array<struct<start:long,end:long>>, whole long, met boolean"), "stretches")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            codes = rest["whole"].to_numpy()
            done = int(np.searchsorted(codes, codes[-1]))  # the last hash may go on in the next batch
            yield from _met_spans(rest.slice(0, done))
            rest = rest.slice(done)
        if rest is not None:
            yield from _met_spans(rest)

    open_rows = rows.where("whole IS NOT NULL").select("d", "h", F.col("s")[0]["start"].alias("start"), F.col("s")[0]["end"].alias("end"), "whole", "met")
    others = open_rows.repartition("whole").sortWithinPartitions("whole", "d", "h", "start").mapInArrow(meet, "d long, h long, start long, end long")
    return rows.where("whole IS NULL").select("d", "h", "s").unionAll(_as_lists(others))


def _as_lists(spans: DataFrame) -> DataFrame:
    return spans.select("d", "h", F.array(F.struct("start", "end")).alias("s"))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _settled_batch(d: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row for each text with all its spans."""
    order = np.lexsort((start, h, d))
    d, h, start, end = (x[order] for x in (d, h, start, end))
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], fields=list(_SPAN))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(d)), pa.int32()), spans)
    return pa.RecordBatch.from_arrays(
        [pa.array(d[first], pa.int64()), pa.array(h[first], pa.int64()), lists, pa.nulls(len(first), pa.int64()), pa.array(np.ones(len(first), bool))], ["d", "h", "s", "whole", "met"]
    )


def _stretch_batch(d: np.ndarray, h: np.ndarray, start: np.ndarray, length: int, whole: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(start + length, pa.int64())], fields=list(_SPAN))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1), pa.int32()), spans)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(h, pa.int64()), lists, pa.array(whole), pa.array(met)], ["d", "h", "s", "whole", "met"])


def _met_spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows whose hash another row has too; rows that were settled before need no second span."""
    if table.num_rows > 1:
        codes = table["whole"].to_numpy()
        same = np.zeros(len(codes) + 1, bool)
        same[1:-1] = codes[1:] == codes[:-1]
        keep = (same[:-1] | same[1:]) & ~table["met"].to_numpy()
        yield from table.filter(pa.array(keep)).select(["d", "h", "start", "end"]).combine_chunks().to_batches()


def repeat_spans(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(spans, contexts): lists of covered spans (d, h, s), and the undecided owners with their bytes.

    ``bucket_repeats`` of the contexts lists the maximal repeats with all their occurrences.
    """
    named = _named(docs, key, text)
    found = saved(anchors(named, length), "anchors")
    seeds = found.groupBy("seed").agg(
        F.count(F.lit(1)).alias("n"), (F.min("body") == F.max("body")).alias("agree")
    ).where("n > 1")
    # Written, so that the join has an exchange of its own, in which a hot seed can be split.
    seeds = saved(seeds, "seeds")
    repeated = saved(found.join(seeds.hint("merge"), "seed").drop("body"), "anchors-met")
    decided = repeated.where("agree").select("d", "h", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + F.lit(length)).alias("end"))
    undecided = repeated.where(~F.col("agree"))
    contexts = saved(_contexts(undecided, named, length), "contexts")
    single = decided.union(bucket_spans(contexts.where(F.col("n") <= bucket), length))
    return _as_lists(single).unionAll(counted_repeats(contexts.where(F.col("n") > bucket), length)), contexts


def remove_repeats(docs: DataFrame, length: int = 200, key: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """The table with n_bytes, n_removed, n_spans, kept_sha256 and ``kept`` (binary): the bytes left over."""
    spans, _ = repeat_spans(docs, length, key, text, bucket)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    names = docs.columns
    body = F.coalesce(F.encode(F.col(f"`{text}`").cast("string"), "UTF-8"), F.lit(b""))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)],
        F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0).cast("bigint")).alias("d"), F.xxhash64(body).alias("h"),
    )
    per_text = spans.groupBy("d", "h").agg(F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    joined = rows.join(per_text.hint("merge"), ["d", "h"], "left").select(
        *[f"_{i}" for i in range(len(names))], F.coalesce(F.encode(F.col(f"_{names.index(text)}").cast("string"), "UTF-8"), F.lit(b"")).alias("_b"), "s"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [_kept(b.as_py(), s.as_py()) for b, s in zip(part.column(part.num_columns - 2), part.column(part.num_columns - 1))]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *columns], [*part.schema.names[:-2], *made])

    schema = joined.drop("_b", "s").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")
    result = joined.mapInArrow(work, schema)
    return result.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names) if c.lower() not in made], *made)


def _kept(body: bytes, spans: list[dict] | None) -> tuple[int, int, int, str, bytes]:
    covered = merged_spans([(x["start"], x["end"]) for x in spans or []])
    at, parts = 0, []
    for a, b in covered:
        parts.append(body[at:a])
        at = b
    kept = b"".join([*parts, body[at:]])
    return len(body), len(body) - len(kept), len(covered), hashlib.sha256(kept).hexdigest(), kept
