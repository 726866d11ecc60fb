"""Near-duplicate texts by b-bit MinHash.

A text's set holds its distinct word shingles as 64-bit hashes. 120 minima give 24 band keys of five
minima each; the two low bits of all minima are packed into bit planes. Equal sets form a class, and one
representative of a class goes on. In every band bucket each member is compared with the bucket's
smallest member: bit counts of the packed planes give the similarity, corrected for chance collisions, and
pairs that may reach the threshold are confirmed on the full sets. Links then make components.

Buckets that still hold several components are opened once more, for pairs of different components only.
Their members get a finer sketch of 2,048 one-bit minima; a large bucket is dealt to tasks as pairs of chunks;
a task counts bits of all its pairs and returns only those that may reach the threshold, for confirmation.
So a group of copies of any size needs links in proportion to its members, and no link between components
that share a bucket is lost. Two texts at a threshold of 0.8 or more share no bucket with probability below
1e-4 (1e-6 at 0.85). Both estimates leave five standard deviations of room below the threshold.

Joins of whole tables are marked as sort-merge joins, so plan and shuffle are the same at every size.

Defined results: texts without words (NULL, empty, white space) have an empty set, link with nothing and
are their own component. Texts with fewer words than a shingle are one shingle. Every row is compared by its
own text, with or without an id. Rows with one doc_id are one document: what any of its texts links to
belongs to its component; every row is returned. Rows without an id link others too; a component takes its
name from those with an id, and without any the name is NULL and its rows are kept. Ties in the choice of
representatives go to the first row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.components import connected_components
from millrace.llm.tables import saved
from millrace.llm.textbytes import SPACED, distinct_per_doc, find_words, mix, shingle_hashes, text_slices

BANDS, ROWS = 24, 5
MINIMA = BANDS * ROWS
PLANES = 4  # two bits of 120 minima in 2 x 2 words of 64
#: Five standard deviations of the estimate lie between the threshold and this distance below it.
SLACK = 0.2
FINE, FINE_SLACK = 2048, 0.06
CHUNK = 1024
_FACTORS = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
_SHIFTS = (mix(np.arange(1001, MINIMA + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_BAND_SEEDS = mix(np.arange(5001, 5001 + MINIMA, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(part, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, first place of each text, how many) of a slice."""
    words = find_words(part.data, part.offsets, SPACED, lower=True)
    doc, hashes = distinct_per_doc(*shingle_hashes(words, size))
    counts = np.bincount(doc, minlength=len(part.offsets) - 1) if len(doc) else np.zeros(len(part.offsets) - 1, np.int64)
    return hashes, np.cumsum(counts) - counts, counts


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(MINIMA, texts) smallest permuted 32-bit hash of each non-empty text."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((MINIMA, len(first)), np.uint32)
    step = 1 << 21  # long texts in windows
    for k in range(MINIMA):
        if len(low) <= step:
            out[k] = np.minimum.reduceat(low * _FACTORS[k] + _SHIFTS[k], first)
        else:
            for i, (a, b) in enumerate(zip(first, np.append(first[1:], len(low)))):
                out[k, i] = min((low[at : min(b, at + step)] * _FACTORS[k] + _SHIFTS[k]).min() for at in range(a, b, step))
    return out


def signatures(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, bands, planes); the last three are NULL for empty sets."""
    t = F.col(f"`{text}`").cast("string")
    named = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), t.alias("t"), F.xxhash64(t).alias("text_hash"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1)):
                hashes, first, counts = shingle_sets(part, size)
                some = np.flatnonzero(counts)
                keys: list[bytes | None] = [None] * len(counts)
                for i in some:
                    keys[i] = hashlib.blake2b(hashes[first[i] : first[i] + counts[i]].tobytes(), digest_size=16).digest()
                bands: list = [None] * len(counts)
                planes: list = [None] * len(counts)
                if len(some):
                    low = minima(hashes, first[some])
                    wide = low.astype(np.uint64) * _BAND_SEEDS[:, None]
                    # Five minima of a band make one key; the seed of its first row sets bands apart.
                    band = mix(wide.reshape(BANDS, ROWS, -1).sum(axis=1, dtype=np.uint64)).view(np.int64).T.copy()
                    bits = np.zeros((PLANES * 64, low.shape[1]), np.uint8)
                    bits[:MINIMA] = low & np.uint32(1)
                    bits[128 : 128 + MINIMA] = (low >> np.uint32(1)) & np.uint32(1)
                    packed = np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1)).view(np.int64)
                    for j, i in enumerate(some):
                        bands[i], planes[i] = band[j], packed[j]
                at = slice(part.first, part.first + len(counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at], batch.column(2)[at], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "n_shingles", "set_key", "bands", "planes"],
                )

    return named.mapInArrow(work, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, planes array<long>")


def estimate(left: Column, right: Column) -> Column:
    """Similarity from the share of equal two-bit minima, less the quarter that agree by chance."""
    differ = sum(
        (F.bit_count((left[i].bitwiseXOR(right[i])).bitwiseOR(left[i + 2].bitwiseXOR(right[i + 2]))) for i in range(2)), F.lit(0)
    )
    return ((F.lit(1.0) - differ / F.lit(float(MINIMA))) - F.lit(0.25)) / F.lit(0.75)


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach ``percent`` in a hundred; texts meet pairs by joins on ids."""
    both = pairs.join(texts.withColumnsRenamed({"doc_id": "b", "t": "tb"}).hint("merge"), "b").join(
        texts.withColumnsRenamed({"doc_id": "a", "t": "ta"}).hint("merge"), "a"
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hold = np.zeros(part.num_rows, bool)
                left, right = (_sets(part.column(i), size) for i in (2, 3))
                for i in range(part.num_rows):
                    x, y = left(i), right(i)
                    same = len(x) + len(y) - len(np.union1d(x, y))
                    hold[i] = 100 * same >= percent * (len(x) + len(y) - same)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(hold))

    return both.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def _sets(column: pa.Array, size: int):
    """Function from row to its set; neighbours with one text share the work."""
    unique = column.dictionary_encode()
    sets: list[np.ndarray] = []
    for part in text_slices(unique.dictionary):
        hashes, first, counts = shingle_sets(part, size)
        sets += [hashes[a : a + n] for a, n in zip(first, counts)]
    codes = unique.indices.to_pylist()
    return lambda i: sets[codes[i]]


def fine_sketches(texts: DataFrame, size: int) -> DataFrame:
    """(id, fine): one low bit of each of ``FINE`` minima, packed."""
    factors = (mix(np.arange(20_001, 20_001 + FINE, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)
    shifts = (mix(np.arange(40_001, 40_001 + FINE, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch.column(1)):
                hashes, first, counts = shingle_sets(part, size)
                low = (hashes >> np.uint64(32)).astype(np.uint32)
                packed = []
                for a, n in zip(first, counts):
                    own = low[a : a + n]
                    least = np.full(FINE, 0xFFFFFFFF, np.uint32)
                    for at in range(0, len(own), 64):
                        least = np.minimum(least, (own[at : at + 64, None] * factors + shifts).min(axis=0))
                    packed.append(np.packbits((least >> np.uint32(3)) & np.uint32(1)).tobytes())
                ids = batch.column(0)[part.first : part.first + len(counts)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(packed, pa.binary())], ["id", "fine"])

    return texts.select("doc_id", "t").mapInArrow(work, "id long, fine binary")


def dealt(rows: DataFrame, chunk: int) -> DataFrame:
    """Adds (l, r, left): pairs of chunks of each bucket, every unordered pair of chunks once."""
    sizes = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(chunk))).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    return (
        rows.join(sizes, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("*", F.least("own", "other").alias("l"), F.greatest("own", "other").alias("r"), (F.col("own") <= F.col("other")).alias("left"))
        .drop("own", "other", "chunks")
    )


def crossing_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different components in one bucket that may reach ``percent`` by the fine sketch."""
    coarse, fine = percent / 100 - SLACK, percent / 100 - FINE_SLACK
    kinds = ["band", "l", "r", "left", "id", "part", "n", "bands", "planes", "fine"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            *whole, rest = _runs(rest, ("band", "l", "r"))
            for group in whole:  # the last run may go on in the next batch; a run is two chunks at most
                yield from _pairs_of_task(group, percent, coarse, fine)
        if rest is not None and rest.num_rows:
            yield from _pairs_of_task(rest, percent, coarse, fine)

    ordered = rows.repartition("band", "l", "r").sortWithinPartitions("band", "l", "r", "id")
    return ordered.select(*kinds).mapInArrow(work, "a long, b long")


def _runs(table: pa.Table, names: tuple[str, ...]) -> list[pa.Table]:
    rows = table.num_rows
    if not rows:
        return [table]
    new = np.zeros(rows, bool)
    for name in names:
        values = table[name].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), rows]
    return [table.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def _pairs_of_task(group: pa.Table, percent: int, coarse: float, fine: float) -> Iterator[pa.RecordBatch]:
    column = lambda name: group[name].to_numpy()
    wide = lambda name: np.stack(group[name].to_numpy())
    same_chunk = group["l"][0].as_py() == group["r"][0].as_py()
    side = column("left")
    first = np.flatnonzero(side)
    second = first if same_chunk else np.flatnonzero(~side)
    if not len(first) or not len(second) or len(np.unique(column("part"))) < 2:
        return
    ids, parts, n, band = column("id"), column("part"), column("n"), group["band"][0].as_py()
    bands, planes = wide("bands"), wide("planes").view(np.uint64)
    sketch = np.frombuffer(b"".join(group["fine"].to_pylist()), np.uint64).reshape(len(ids), -1)
    for start in range(0, len(first), 128):
        x = first[start : start + 128]
        fits = parts[x][:, None] != parts[second][None, :]
        if same_chunk:
            fits &= x[:, None] < second[None, :]
        a, b = n[x][:, None], n[second][None, :]
        fits &= np.minimum(a, b) * 100 >= np.maximum(a, b) * percent
        differ = np.zeros(fits.shape, np.int64)
        for k in range(2):
            u = planes[x, k][:, None] ^ planes[second, k][None, :]
            v = planes[x, k + 2][:, None] ^ planes[second, k + 2][None, :]
            differ += np.bitwise_count(u | v)
        fits &= ((1.0 - differ / MINIMA) - 0.25) / 0.75 >= coarse
        i, j = np.nonzero(fits)
        for at in range(0, len(i), 1 << 14):
            p, q = x[i[at : at + (1 << 14)]], second[j[at : at + (1 << 14)]]
            bits = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1)
            near = 1.0 - 2.0 * bits / FINE >= fine
            p, q = p[near], q[near]
            # Only the first band that both share returns the pair.
            shared = bands[p] == bands[q]
            p, q = (z[bands[p][np.arange(len(p)), shared.argmax(axis=1)] == band] for z in (p, q))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[p], ids[q])), pa.array(np.maximum(ids[p], ids[q]))], ["a", "b"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per row of ``docs``."""
    # A set is named by the first row that has it, whatever the ids of its rows.
    signed = saved(signatures(docs, size, key, text).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = saved(
        signed.where("set_key IS NOT NULL").groupBy("set_key").agg(
            F.min(F.struct("row", "doc_id", "text_hash")).alias("first"), F.min("doc_id").alias("least"),
            F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("planes").alias("planes"),
        ).select(F.col("first.row").alias("id"), "*"),
        "classes",
    )
    members = classes.select("id", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("c")).where("k > 1").select("band", "c")
    hits = saved(members.join(shared.hint("merge"), "band"), "buckets")
    texts = saved(_texts_of(docs, classes.join(hits.select("id").distinct().hint("merge"), "id", "left_semi"), key, text), "bucket-texts")
    slim = classes.select("id", "n", "planes")
    starred = (
        hits.where("c < id").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
        .join(slim.withColumnsRenamed({"id": "a", "n": "na", "planes": "pa"}).hint("merge"), "a")
        .join(slim.withColumnsRenamed({"id": "b", "n": "nb", "planes": "pb"}).hint("merge"), "b")
        .where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (estimate(F.col("pa"), F.col("pb")) >= percent / 100 - SLACK))
        .select("a", "b")
    )
    first = saved(confirm(starred, texts, size, percent), "links")
    parts = connected_components(first).withColumnRenamed("component", "part")
    # Buckets with more than one component.
    labelled = saved(hits.select("band", "id").join(parts, "id", "left").withColumn("part", F.coalesce("part", "id")), "labelled")
    mixed = labelled.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("band")
    open_rows = saved(labelled.join(mixed, "band"), "open-buckets")
    open_ids = open_rows.select(F.col("id").alias("doc_id")).distinct()
    sketches = saved(fine_sketches(texts.join(open_ids, "doc_id", "left_semi"), size).join(classes.select("id", "n", "bands", "planes"), "id"), "sketches")
    crossing = saved(crossing_pairs(dealt(open_rows, CHUNK).join(sketches, "id"), percent).distinct(), "pairs")
    second = saved(confirm(crossing, texts, size, percent), "links")
    # Components of the first links stand for their members.
    joined = parts.withColumnsRenamed({"id": "i", "part": "p"})
    bridges = (
        second.unionAll(_links_of_ids(signed, classes)).join(joined.withColumnsRenamed({"i": "a", "p": "pa"}), "a", "left").join(joined.withColumnsRenamed({"i": "b", "p": "pb"}), "b", "left")
        .select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    )
    tops = connected_components(bridges).withColumnsRenamed({"id": "_p", "component": "_top"})
    placed = (
        classes.select("set_key", "least", F.col("id").alias("_id")).join(parts.withColumnsRenamed({"id": "_id", "part": "_part"}), "_id", "left")
        .withColumn("_p", F.coalesce("_part", "_id")).join(tops, "_p", "left").select("set_key", "least", F.coalesce("_top", "_p").alias("_c"))
    )
    lowest = placed.groupBy("_c").agg(F.min("least").alias("_name"))
    placed = placed.join(lowest, "_c").select("set_key", F.col("_name"))
    name = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("_name"))
    return signed.select("doc_id", "n_shingles", "set_key").join(placed, "set_key", "left").select(
        "doc_id", "n_shingles", name.alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _texts_of(docs: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, t): a text for the number of each class, found by the id and the hash of its first row."""
    t = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.xxhash64(F.col(f"`{key}`").cast("bigint"), F.xxhash64(t)).alias("_k"), F.xxhash64(t).alias("_h"), t.alias("t"))
    wanted = classes.select(F.xxhash64("first.doc_id", "first.text_hash").alias("_k"), F.col("first.text_hash").alias("_h"), F.col("id").alias("doc_id"))
    return rows.join(wanted.hint("merge"), ["_k", "_h"]).select("doc_id", "t").dropDuplicates(["doc_id"])


def _links_of_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that meet because one document has texts of both."""
    several = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo < hi")
    sets = signed.join(several.select("doc_id", "lo"), "doc_id").where("set_key IS NOT NULL").select("set_key", "lo").distinct()
    number = classes.select("set_key", "id")
    return sets.join(number, "set_key").join(number.withColumnsRenamed({"set_key": "lo", "id": "a"}), "lo").where("a <> id").select("a", F.col("id").alias("b"))
