"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Words are lower-case runs of letters and digits. A mask keeps some of the words of a stretch and ignores
the others; the kept words are hashed. Masks are chosen by pigeonhole: a window is cut into more blocks than
admitted changes can hit, and every choice of as many blocks as must stay whole is a mask. So no pattern of
substitutions that ``share`` admits is missed. Every place of every training text is hashed under every mask and
meets the hashes of the benchmark. A hit fixes how text and item lie on each other; around it, equal words
are counted in every window of the item, so that substituted words cost only their own place.

The benchmark is the small side by nature, yet its size is checked: it is dealt into blocks of at most
``BLOCK_SEEDS`` hashes, and each block with the words around its seeds (some 50 MB) is broadcast to one pass
over the texts. Texts are never shuffled, only the pairs found are.

Defined results: NULL or wordless texts are clean. NULL items and items with fewer words than
``MIN_WORDS`` are no evidence and match nothing. Items shorter than ``WINDOW`` are one window, with masks
of their own. Rows with one doc_id are judged together and each row is returned; rows without an id
are judged by their own text. Repeated items count by their item_id.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.tables import saved

WORD_BREAK = r"[^\p{L}\p{N}]+"
#: Places of a stretch that count in the registered SQL. ``masks_of`` makes those of the search.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 7, 8), (0, 2, 3, 5, 6, 9), (0, 1, 3, 4, 5, 8))
MIN_WORDS = 5
#: Words that a seed should hold where the admitted changes leave room for so many.
SEED_WORDS = 6
WINDOW = 20
SHARE = 0.8
BLOCK_SEEDS = 100_000
PIECE = 64
#: Words before and behind the first word of a seed that a window with this word can reach.
BEFORE, BEHIND = WINDOW - 1, WINDOW + 8


def masks_of(width: int, share: float = SHARE) -> list[tuple[int, ...]]:
    """Masks of which every window of ``width`` words with ``share`` of them equal holds one, somewhere, unchanged.

    With m blocks and c changes at least m - c blocks are whole; their distances make the mask. Of the ways
    with ``SEED_WORDS`` words in m - c blocks, the one with the fewest masks is taken, or else the most words.
    """
    changes = max((c for c in range(width) if (width - c) / width >= share), default=0)
    kinds = []
    for length in range(1, width + 1):
        for blocks in range(changes + 1, width // length + 1):
            whole = blocks - changes
            kinds.append((-min(whole * length, SEED_WORDS), comb(blocks - 1, whole - 1), length, blocks, whole))
    _, _, length, blocks, whole = min(kinds)
    return [
        tuple(block * length + k for block in (0, *others) for k in range(length))
        for others in combinations(range(1, blocks), whole - 1)
    ]


def masks_by_width(widths: Sequence[int], share: float = SHARE) -> list[tuple[tuple[int, ...], list[int]]]:
    """(mask, window widths that need it), every mask once."""
    needed: dict[tuple[int, ...], list[int]] = {}
    for width in sorted(widths):
        for mask in masks_of(width, share):
            needed.setdefault(mask, []).append(width)
    return sorted(needed.items())


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_BREAK)
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def seed(hashes: Column, place: Column, number: int, mask: Sequence[int]) -> Column:
    """Hash of the kept words under one mask; NULL where the stretch leaves the text."""
    kept = [F.get(hashes, place + k) for k in mask]
    return F.when(F.get(hashes, place + mask[-1]).isNotNull(), F.xxhash64(F.lit(number), *kept))


def benchmark_items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, item): the word hashes of every usable item, written once."""
    items = benchmark.select(F.col(f"`{key}`").cast("bigint").alias("item_id"), word_hashes(F.col(f"`{text}`")).alias("item"))
    items = saved(items, "benchmark-items")
    return items.where((F.size("item") >= MIN_WORDS) & F.col("item_id").isNotNull()).distinct()


def aligned(hashes: Column, place: Column) -> Column:
    """The words that may share a window with a seed at ``place``; NULL beyond either end."""
    padded = F.concat(F.array_repeat(F.lit(None).cast("bigint"), BEFORE), hashes, F.array_repeat(F.lit(None).cast("bigint"), BEHIND))
    return F.slice(padded, place + 1, F.lit(BEFORE + 1 + BEHIND))


def benchmark_seeds(items: DataFrame, masks: Sequence[tuple[tuple[int, ...], list[int]]]) -> DataFrame:
    """(seed, item_id, words, around) of every place of every item under the masks of its width."""
    places = items.select("item_id", "item", F.explode(F.sequence(F.lit(0), F.size("item") - 1)).alias("place"))
    parts = []
    for number, (mask, widths) in enumerate(masks):
        own = places.where(F.least(F.size("item"), F.lit(WINDOW)).isin(widths))
        parts.append(
            own.select(
                seed(F.col("item"), F.col("place"), number, mask).alias("seed"), "item_id", F.size("item").alias("words"),
                aligned(F.col("item"), F.col("place")).alias("around"),
            )
        )
    return reduce(DataFrame.union, parts).where("seed IS NOT NULL").distinct()


def best_window(equal: Column, words: Column) -> Column:
    """Largest share of equal words in a window of ``WINDOW`` words (of the item's words, if it has fewer)."""
    width = F.least(words, F.lit(WINDOW))
    sums = F.transform(
        F.sequence(F.lit(1), F.size(equal) - width + 1), lambda at: F.aggregate(F.slice(equal, at, width), F.lit(0), lambda s, x: s + x)
    )
    return F.array_max(sums) / width


def named_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, own, t): ``own`` is a hash of the text that names rows without an id, NULL for the others."""
    named = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    return named.select("doc_id", own_name(F.col("doc_id"), F.col("t")).alias("own"), "t")


def own_name(key: Column, text: Column) -> Column:
    return F.when(key.cast("bigint").isNull(), F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def scored_hits(docs: DataFrame, seeds: DataFrame, masks: Sequence[tuple[tuple[int, ...], list[int]]]) -> DataFrame:
    """(doc_id, own, item_id, overlap) of every shared seed.

    A text goes on in pieces of ``PIECE`` words with the words around them that a window may reach, so
    no row carries a long text and none has to be fetched again.
    """
    pieces = let(
        word_hashes(F.col("t")),
        lambda h: let(
            F.concat(F.array_repeat(F.lit(None).cast("bigint"), BEFORE), h, F.array_repeat(F.lit(None).cast("bigint"), BEHIND)),
            lambda padded: F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(padded) - (BEFORE + BEHIND + 1), F.lit(0)), F.lit(PIECE)),
                lambda at: F.slice(padded, at + 1, F.lit(PIECE + BEFORE + BEHIND)),
            ),
        ),
    )
    rows = docs.select("doc_id", "own", F.explode(pieces).alias("h"))
    places = rows.select("doc_id", "own", "h", F.explode(F.sequence(F.lit(0), F.lit(PIECE - 1))).alias("k"))
    every = places.select("doc_id", "own", "h", "k", F.explode(F.array(*[seed(F.col("h"), F.col("k") + BEFORE, n, m) for n, (m, _) in enumerate(masks)])).alias("seed"))
    hits = every.join(F.broadcast(seeds), "seed").select("doc_id", "own", "item_id", "words", "around", F.slice("h", F.col("k") + 1, F.lit(BEFORE + 1 + BEHIND)).alias("text"))
    equal = F.zip_with("text", "around", lambda a, b: F.when(a == b, 1).otherwise(0))
    return hits.select("doc_id", "own", "item_id", let(equal, lambda e: best_window(e, F.col("words"))).alias("overlap"))


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, overlap): pairs with a window of at least ``share`` equal words around a shared seed.

    Different texts without an id have a row each for an item.
    """
    return text_overlaps(docs, benchmark, key, text, item_key, item_text, share).drop("own")


def text_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, own, item_id, overlap): ``overlaps`` with the names of rows without an id."""
    named = named_texts(docs, key, text)
    items = benchmark_items(benchmark, item_key, item_text)
    sizes = items.groupBy(F.least(F.size("item"), F.lit(WINDOW)).alias("width")).agg(F.sum(F.size("item")).alias("words")).collect()
    masks = masks_by_width([r.width for r in sizes] or [WINDOW], share)
    seeds = benchmark_seeds(items, masks)
    words = {r.width: r.words for r in sizes}
    blocks = max(1, -(-sum(words.get(w, 0) for _, widths in masks for w in widths) // BLOCK_SEEDS))
    hits = reduce(
        DataFrame.union,
        [scored_hits(named, seeds if blocks == 1 else seeds.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == b), masks) for b in range(blocks)],
    )
    return hits.where(F.col("overlap") >= share).groupBy("doc_id", "own", "item_id").agg(F.max("overlap").alias("overlap"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a passage of the benchmark."""
    found = text_overlaps(docs, benchmark, key, text, **options).select("doc_id", "own").distinct()
    found = found.select(F.col("doc_id").alias("_found_id"), F.col("own").alias("_found_own"))
    # NULL meets NULL in neither column, so each kind of row has its own join.
    known = docs.where(F.col(f"`{key}`").cast("bigint").isNotNull())
    nameless = docs.where(F.col(f"`{key}`").cast("bigint").isNull())
    return known.join(found.where("_found_id IS NOT NULL"), F.col(f"`{key}`").cast("bigint") == F.col("_found_id"), "left_anti").union(
        nameless.join(found.where("_found_id IS NULL"), own_name(F.col(f"`{key}`"), F.col(f"`{text}`")) == F.col("_found_own"), "left_anti")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, contaminated, n_items, overlap, first_item) for every row of ``docs``."""
    per_doc = text_overlaps(docs, benchmark, key, text, **options).groupBy("doc_id", "own").agg(
        F.count(F.lit(1)).alias("n_items"), F.max("overlap").alias("overlap"), F.min("item_id").alias("first_item")
    ).select(F.col("doc_id").alias("_i"), F.col("own").alias("_o"), "n_items", "overlap", "first_item")
    rows = named_texts(docs, key, text).select("doc_id", "own")
    return rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_i")) & F.col("own").eqNullSafe(F.col("_o")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("overlap", F.lit(0.0)).alias("overlap"), "first_item",
    )
