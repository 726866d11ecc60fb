"""Phrase collocations from count streams kept in prefix and in suffix order.

Phrases are counted level by level, and a phrase of n words is only looked for where both its parts of n - 1
words reach the least count: a phrase never occurs more often than its parts. What is counted is exact;
the filter between two levels is a bitmap of fixed size that may let more through, never less.

The counts of all lengths then form one stream, sorted once by the words from the first on and once from the
last back. A scan of the first order meets every phrase after the phrases it begins with, which gives the
left counts of its cuts and shows whether a longer phrase to the right covers it; the second order does
the same for what follows the cut and for longer phrases to the left. Both streams are cut into ranges, a
range starts with the few phrases that its first phrase extends, and sorted rows are joined by merging.

Defined results: a NULL or empty text has no words, a NULL language is ``und``. Repeated rows count as often
as they occur. Equal scores are ordered by count, then by phrase. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.tables import saved
from millrace.llm.textbytes import SPACED, mix, word_table
from millrace.llm.wordcodes import coded_slices
from millrace.operators.ordered import default_ranges, positions, range_cuts, range_number

#: Bits of the filter between two levels, 8 MB however long the list of phrases is.
FILTER_BITS = 26
#: Parts of a language that choose their best phrases before these meet.
PARTS = 64

WORD = SPACED & word_table([(0x0A, 0x0D), *((b, b) for b in b".,;:!?")])
BREAK = ~word_table([(0x0A, 0x0D), *((b, b) for b in b".,;:!?")])

_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_COUNTS = "lang string, phrase string, n long"


def mine_collocations(
    docs: DataFrame, least: int = 100, longest: int = 5, top: int | None = 2000, covered: int = 100, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the ``top`` phrases of each language, all with None.

    Candidates have 2 to ``longest`` words and a count of ``least`` or more; one that lies inside a longer
    candidate with at least ``covered`` percent of its count is dropped. ``cut`` is the number of words
    before the cut with the lowest score, the shortest if several have it.
    """
    slim = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")
    )
    levels = [saved(count_phrases(slim, 1).where(F.col("phrase").isNull() | (F.col("n") >= least)), "words")]
    totals = levels[0].where("phrase IS NULL").select("lang", F.col("n").alias("total"))
    levels[0] = levels[0].where("phrase IS NOT NULL")
    for size in range(2, longest + 1):
        frequent = _bitmap(levels[-1])
        if frequent is None:
            break
        levels.append(saved(count_phrases(slim, size, frequent).where(F.col("n") >= least), f"phrases-{size}"))
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionAll(level)
    before, after = (saved(_scan(counts, backward, covered), "stream") for backward in (False, True))
    inner = before.where("covers").select("lang", F.array_join(F.slice("words", 1, F.size("words") - 1), " ").alias("phrase")).unionAll(
        after.where("covers").select("lang", F.array_join(F.slice("words", 2, F.size("words") - 1), " ").alias("phrase"))
    )
    joined = before.hint("merge").join(after.select("lang", "phrase", F.col("counts").alias("behind")), ["lang", "phrase"])
    joined = joined.join(inner.distinct(), ["lang", "phrase"], "left_anti").join(totals, "lang")
    wide = lambda count: count.cast("decimal(19,0)")  # noqa: E731  products may pass 64 bits
    whole = F.lit(1000).cast("decimal(4,0)") * wide(F.col("n")) * wide(F.col("total"))

    def cut(k):
        left, right = F.get("counts", k - 1), F.get("behind", F.size("words") - k - 1)
        return F.struct(F.call_function("div", whole, wide(left) * wide(right)).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), cut)
    best = joined.select("lang", "phrase", "n", "total", F.array_min(cuts).alias("b")).select(
        "lang", "phrase", F.col("n").alias("a"), F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("total").alias("n"), F.col("b.score").alias("score"), F.col("b.k").alias("cut")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # the best of every part first, so that a language never meets in one task whole
        part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
        own = Window.partitionBy("lang", "_part").orderBy(*order)
        best = best.withColumn("_part", part).withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= top)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    else:
        ranked = positions(best.withColumns({"_s": -F.col("score"), "_a": -F.col("a")}), ["lang"], ["_s", "_a", "phrase"], "rank")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def count_phrases(slim: DataFrame, size: int, frequent: bytes | None = None) -> DataFrame:
    """(lang, phrase, n) of all phrases of ``size`` words that may be frequent; with one word also a total with a NULL phrase."""
    shared = slim.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint64) if shared.value is not None else None
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for part in coded_slices(batch.column(1), WORD):
                if len(part.code):
                    yield from _count(part, langs, size, bits)

    found = slim.select("lang", "t").mapInArrow(work, _COUNTS)
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _count(part, langs: pa.DictionaryArray, size: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    lang = langs.indices.to_numpy(zero_copy_only=False)[part.first : part.first + part.rows][part.doc]
    if size == 1:
        found = pa.table({"lang": lang, "w0": part.code}).group_by(["lang", "w0"], use_threads=False).aggregate([([], "count_all")])
        sums = np.bincount(lang, minlength=len(langs.dictionary))
        here = np.flatnonzero(sums)
        yield _rows(langs.dictionary.take(pa.array(here)), pa.nulls(len(here), pa.string()), sums[here])
    else:
        piece = _pieces(part)
        key = _keys(part.words)[part.code] + _keys(langs.dictionary.cast(pa.binary()))[lang] * _SEEDS[63]
        rows = len(key) - size + 1
        if rows <= 0:
            return
        short = np.zeros(rows + 1, np.uint64)  # the phrases of one word less
        for k in range(size - 1):
            short += key[k : k + rows + 1] * _SEEDS[k]
        known = _inside(bits, short)
        at = np.flatnonzero((piece[:rows] == piece[size - 1 :]) & known[:-1] & known[1:])
        if not len(at):
            return
        columns = {"lang": lang[at]} | {f"w{k}": part.code[at + k] for k in range(size)}
        found = pa.table(columns).group_by(list(columns), use_threads=False).aggregate([([], "count_all")])
    words = [part.words.take(found.column(f"w{k}").combine_chunks()) for k in range(size)]
    phrase = words[0] if size == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", words[0].type))
    yield _rows(langs.dictionary.take(found.column("lang").combine_chunks()), phrase.cast(pa.large_string()).cast(pa.string()), found.column("count_all").combine_chunks())


def _rows(lang, phrase, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def _pieces(part) -> np.ndarray:
    """Number of the piece that each word stands in; texts end pieces too."""
    ends = np.flatnonzero(BREAK[part.data])
    return np.searchsorted(ends, part.start) + part.doc.astype(np.int64)


def _keys(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _inside(bits: np.ndarray, sums: np.ndarray) -> np.ndarray:
    slot = mix(sums) >> np.uint64(64 - FILTER_BITS)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _bitmap(level: DataFrame) -> bytes | None:
    """The phrases of a level as bits by hash; None if there are none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros(batch.num_rows, np.uint64)
            langs = _keys(batch.column(0).cast(pa.binary())) * _SEEDS[63]
            for i, phrase in enumerate(batch.column(1).to_pylist()):
                total = 0
                for k, word in enumerate(phrase.encode().split(b" ")):
                    total += (xxhash.xxh64_intdigest(word) + int(langs[i])) * int(_SEEDS[k])
                sums[i] = total & 0xFFFFFFFFFFFFFFFF
            slot = mix(sums) >> np.uint64(64 - FILTER_BITS)
            bit = np.uint64(1) << (slot & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], ["block", "bits"])

    found = level.select("lang", "phrase").mapInArrow(work, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    if not found.num_rows:
        return None
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)  # at most this many blocks reach the driver
    out[found.column("block").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out.tobytes()


def _scan(counts: DataFrame, backward: bool, covered: int) -> DataFrame:
    """(lang, phrase, words, n, counts, covers) of phrases of two words or more, from one sorted stream.

    ``counts`` are those of the phrases of 1, 2, ... words that it begins with (ends with, if ``backward``);
    ``covers``: it makes the one that is a word shorter superfluous.
    """
    words = F.split("phrase", " ")
    stream = counts.select("lang", F.reverse(words).alias("key") if backward else words.alias("key"), "n")
    cuts = range_cuts(stream, [], ["lang", "key"], default_ranges(stream))
    known = _carried(stream, cuts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, lang, path, upto = None, None, [], []
        for batch in batches:
            out: list[tuple] = []
            for number, own, key, n in zip(*(c.to_pylist() for c in batch.columns)):
                if number != place:
                    place = number
                    lang, path, upto = known.get(number, (None, [], []))
                    path, upto = list(path), list(upto)
                if own != lang:
                    lang, path, upto = own, [], []
                size = len(key) - 1
                del path[size:], upto[size:]
                if path != key[:size]:
                    raise ValueError("the stream is out of order")
                if size:
                    ordered = key[::-1] if backward else key
                    out.append((own, " ".join(ordered), ordered, n, list(upto), size > 1 and 100 * n >= covered * upto[-1]))
                path.append(key[-1])
                upto.append(n)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.bool_()))],
                    ["lang", "phrase", "words", "n", "counts", "covers"],
                )

    ranged = stream.select(F.explode(F.array(range_number(stream, ["lang", "key"], cuts))).alias("_range"), "lang", "key", "n")
    ranged = ranged.repartition("_range").sortWithinPartitions("_range", "lang", "key")
    return ranged.mapInArrow(work, "lang string, phrase string, words array<string>, n long, counts array<long>, covers boolean")


def _carried(stream: DataFrame, cuts: list[tuple]) -> dict[int, tuple]:
    """For each range the shorter phrases that its first possible phrase extends, with their counts: at most four."""
    spark = stream.sparkSession
    wanted = [(i + 1, lang, list(key[:k])) for i, (lang, key) in enumerate(cuts) for k in range(1, len(key))]
    if not wanted:
        return {i + 1: (lang, [], []) for i, (lang, _) in enumerate(cuts)}
    asked = spark.createDataFrame(wanted, "_range int, lang string, key array<string>")
    found = stream.join(F.broadcast(asked), ["lang", "key"]).select("_range", "lang", "key", "n").orderBy("_range", F.size("key")).collect()
    out: dict[int, tuple] = {i + 1: (lang, [], []) for i, (lang, _) in enumerate(cuts)}
    for row in found:
        _, path, upto = out[row[0]]
        path.append(row.key[-1])
        upto.append(row.n)
    return out
