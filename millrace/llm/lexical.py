"""Ranked lexical search over an index stratified by document length.

Documents with equal normaliser m form a stratum. A stratum is stored in blocks, each a small inverted index:
its terms, and for every term its documents by falling term frequency. Inside a stratum the impact of a
term depends on the frequency alone, so it is computed once for each frequency. The highest frequency of
each term bounds what a block can score for a query; queries first visit the strata with the highest bounds,
and then only blocks whose bound reaches the score of the last place found so far.

Defined results: a NULL or empty text has no terms and is no document; a document without an id comes after
others of equal score. Repeated rows are documents of their own. Queries without terms have no rows;
equal query rows are one query, different texts under one id are searched one by one. A term that no document holds
adds nothing. Fewer matches than asked for are all returned. Texts of any length are whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.tables import saved
from millrace.llm.textbytes import ALPHANUMERIC
from millrace.llm.wordcodes import coded_slices

# Fixed values of the score: weight scale, length share in percent, impact scale, saturation.
WEIGHT, FLOOR, SLOPE, IMPACT, STEP, LENGTH = 1000, 75, 25, 1_000_000_000, 1000, 12

#: Documents and postings of a block; queries that are worked on together.
BLOCK_DOCS, BLOCK_POSTINGS, QUERIES = 1024, 200_000, 1000
#: Strata that every query visits first.
FIRST = 2
#: Up to so many distinct query terms are sent to the scan of the texts; beyond, every term is indexed.
SENT_TERMS = 500_000

_COUNTED = "doc_id long, n long, terms array<string>, tf array<int>"
_BLOCK = "m long, docs array<long>, terms array<string>, held array<int>, tf array<int>, place array<int>"


class Index(NamedTuple):
    blocks: DataFrame
    held: DataFrame  # (term, df)
    documents: int  # with at least one term
    length: int  # terms of all documents


def count_terms(docs: DataFrame, only: list[str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, tf) for texts with terms: all terms are counted in n, those of ``only`` are listed."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array([t.encode() for t in only], pa.large_binary()) if only is not None else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in coded_slices(batch.column(1), ALPHANUMERIC):
                n = np.bincount(part.doc, minlength=part.rows)
                doc, code = part.doc, part.code
                if shared.value is not None:
                    wanted = pc.is_in(part.words, value_set=shared.value).to_numpy(zero_copy_only=False)[code]
                    doc, code = doc[wanted], code[wanted]
                both, tf = np.unique(doc * len(part.words) + code, return_counts=True)
                doc, code = np.divmod(both, max(1, len(part.words)))
                full = np.flatnonzero(n)
                ends = np.zeros(part.rows + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=part.rows), out=ends[1:])
                terms = part.words.cast(pa.large_string()).cast(pa.string()).take(pa.array(code))
                lists = [pa.ListArray.from_arrays(pa.array(ends), v).take(pa.array(full)) for v in (terms, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.rows).take(pa.array(full)), pa.array(n[full], pa.int64()), *lists], ["doc_id", "n", "terms", "tf"]
                )

    slim = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    return slim.mapInArrow(work, _COUNTED)


def build_index(docs: DataFrame, only: list[str] | None = None, key: str = "doc_id", text: str = "text") -> Index:
    """The stratified index of all documents; with ``only`` of these terms."""
    counted = saved(count_terms(docs, only, key, text), "term-counts")
    documents, length = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    norm = F.lit(FLOOR) + F.call_function("div", F.lit(SLOPE) * F.col("n") * F.lit(documents), F.lit(max(1, length)))
    rows = counted.where(F.size("terms") > 0).select(norm.cast("bigint").alias("m"), "doc_id", "terms", "tf")
    # A stratum that holds many documents is cut by the hash, so ranges stay even.
    ranged = rows.repartitionByRange("m", F.xxhash64("doc_id", F.element_at("terms", 1))).sortWithinPartitions("m")

    most_docs, most_postings = BLOCK_DOCS, BLOCK_POSTINGS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(0).to_numpy()
            size = np.diff(batch.column(2).offsets.to_numpy())
            first = 0
            while first < len(m):
                last = min(int(np.searchsorted(m, m[first], "right")), first + most_docs)
                last = max(first + 1, first + int(np.searchsorted(np.cumsum(size[first:last]), most_postings, "right")))
                yield _block(batch.slice(first, last - first))
                first = last

    blocks = saved(ranged.mapInArrow(work, _BLOCK), "stratum-blocks")
    held = blocks.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).groupBy("t.terms").agg(F.sum("t.held").cast("bigint").alias("df"))
    return Index(blocks, saved(held.select(F.col("terms").alias("term"), "df"), "term-documents"), documents, length)


def _block(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Documents of one stratum turned into postings: by term, then by falling frequency."""
    terms = rows.column(2).flatten().dictionary_encode()
    code = terms.indices.to_numpy(zero_copy_only=False)
    tf = rows.column(3).flatten().to_numpy()
    place = np.repeat(np.arange(rows.num_rows, dtype=np.int32), pc.list_value_length(rows.column(2)).to_numpy())
    order = np.lexsort((place, -tf, code))
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [rows.column(0).slice(0, 1), pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(1)),
         pa.ListArray.from_arrays(pa.array([0, len(terms.dictionary)], pa.int32()), terms.dictionary),
         one(np.bincount(code, minlength=len(terms.dictionary)).astype(np.int32), pa.int32()), one(tf[order], pa.int32()), one(place[order], pa.int32())],
        ["m", "docs", "terms", "held", "tf", "place"],
    )


class Queries(NamedTuple):
    """Some queries as (query, term, times) triples in order of queries."""

    terms: pa.Array  # distinct terms
    weight: np.ndarray  # of each term
    query: np.ndarray
    term: np.ndarray
    times: np.ndarray
    count: int


def search(index: Index, items: DataFrame, top: int = 20, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with a score above 0 for each query."""
    spark = items.sparkSession
    asked = query_terms(items, key, text)
    # Numbered in parts, so that no task orders all queries; a block of them is held by the driver at a time.
    numbered = saved(asked.withColumn("_b", F.pmod(F.xxhash64("item_id", "_h"), F.lit(max(1, -(-asked.count() // QUERIES)))).cast("int")), "queries")
    blocks = numbered.agg(F.max("_b")).first()[0]
    found = None
    for number in range((blocks if blocks is not None else -1) + 1):
        rows = numbered.where(F.col("_b") == number).select("item_id", "terms", "times").collect()
        part = _search_some(spark, index, rows, top)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return found


def query_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, _h, terms, times) of each different query that has terms."""
    counted = count_terms(items, None, key, text).select(F.col("doc_id").alias("item_id"), F.array_sort(F.arrays_zip("terms", "tf")).alias("z"))
    return counted.distinct().select("item_id", F.xxhash64("z").alias("_h"), F.col("z.terms").alias("terms"), F.col("z.tf").alias("times"))


def _search_some(spark, index: Index, rows: list, top: int) -> DataFrame:
    terms = sorted({t for r in rows for t in r.terms})
    asked = spark.createDataFrame([(t,) for t in terms], "term string")
    df = {r.term: r.df for r in index.held.join(F.broadcast(asked), "term").collect()}  # at most the terms of these queries
    known = [t for t in terms if t in df]
    number = {t: i for i, t in enumerate(known)}
    weight = [math.floor(WEIGHT * math.log((2 * index.documents + 2) / (2 * df[t] + 1))) for t in known]
    triples = [(q, number[t], n) for q, r in enumerate(rows) for t, n in zip(r.terms, r.times) if t in number]
    query, term, times = (np.array(c, np.int64) for c in (zip(*triples) if triples else ([], [], [])))
    block = Queries(pa.array(known, pa.string()), np.array(weight, np.int64), query, term, times, len(rows))
    shared = spark.sparkContext.broadcast(block)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                opened = _opened(batch, i, shared.value)
                bound = _bounds(shared.value, opened)
                here = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), opened.m)), pa.array(here), pa.array(bound[here])], ["m", "query", "bound"])

    strata = index.blocks.mapInArrow(bounds, "m long, query long, bound long").groupBy("m", "query").agg(F.max("bound").alias("bound"))
    best = strata.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "m"))).where(F.col("_r") <= FIRST)
    first = best.select("m").distinct()  # at most FIRST strata for each query
    floors = np.ones(block.count, np.int64)
    for row in _best(_visit(index.blocks.join(F.broadcast(first), "m", "left_semi"), shared, floors, top), top).where(F.col("rank") == top).select("query", "score").collect():
        floors[row.query] = row.score
    names = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(rows)], "query long, item_id long")
    ranked = _best(_visit(index.blocks, shared, floors, top), top)
    return ranked.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _visit(blocks: DataFrame, shared, floors: np.ndarray, top: int) -> DataFrame:
    """(query, doc_id, score): each task's best documents among the blocks that can reach the floor of a query."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        floor = floors.copy()
        starts = np.searchsorted(queries.query, np.arange(queries.count + 1))
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            opened = [_opened(batch, i, queries) for i in range(batch.num_rows)]
            limits = [_bounds(queries, o) for o in opened]
            for i in sorted(range(len(opened)), key=lambda i: -int(limits[i].max(initial=0))):
                m, docs, place, tf, first, last = opened[i]
                reach = np.flatnonzero((limits[i] >= floor) & (limits[i] > 0))
                if not len(reach):
                    continue
                impact = _impacts(m, int(tf.max()))[tf]  # one division for each frequency
                missing = docs.is_null().to_numpy(zero_copy_only=False)
                ids = docs.fill_null(0).to_numpy()
                for q in reach:
                    own = slice(starts[q], starts[q + 1])
                    score = np.zeros(len(ids), np.int64)
                    for t, times in zip(queries.term[own], queries.times[own]):
                        low, high = first[t], last[t]
                        if low < high:  # a document stands once in the postings of a term
                            score[place[low:high]] += impact[low:high] * (times * queries.weight[t])
                    here = np.flatnonzero(score >= floor[q])
                    if len(here):
                        kept = best.get(q)
                        new = (score[here], missing[here], ids[here])
                        new = new if kept is None else tuple(np.concatenate(x) for x in zip(kept, new))
                        order = np.lexsort((new[2], new[1], -new[0]))[:top]
                        best[q] = new = tuple(x[order] for x in new)
                        if len(order) == top:
                            floor[q] = max(floor[q], int(new[0][-1]))
        for q, (score, missing, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int64)), pa.array(ids, mask=missing), pa.array(score)], ["query", "doc_id", "score"])

    return blocks.mapInArrow(work, "query long, doc_id long, score long")


def _best(found: DataFrame, top: int) -> DataFrame:
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)


class Opened(NamedTuple):
    """A block with the places where the postings of each query term start and end."""

    m: int
    docs: pa.Array
    place: np.ndarray
    tf: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _opened(batch: pa.RecordBatch, i: int, queries: Queries) -> Opened:
    one = lambda c: batch.column(c).slice(i, 1).flatten()
    ends = np.concatenate([[0], np.cumsum(one(3).to_numpy())])
    at = pc.index_in(queries.terms, value_set=one(2)).fill_null(-1).to_numpy()
    first, last = np.where(at >= 0, ends[at], 0), np.where(at >= 0, ends[at + 1], 0)
    return Opened(batch.column(0)[i].as_py(), one(1), one(5).to_numpy(), one(4).to_numpy(), first, last)


def _impacts(m: int, highest: int) -> np.ndarray:
    tf = np.arange(highest + 1, dtype=np.int64)
    return (IMPACT * tf) // (STEP * tf + LENGTH * m)


def _bounds(queries: Queries, opened: Opened) -> np.ndarray:
    """What each query can score in a block at most: the impacts of the highest frequencies."""
    out = np.zeros(queries.count, np.int64)
    if len(opened.tf) and len(queries.term):
        there = opened.last > opened.first
        highest = np.where(there, opened.tf[np.where(there, opened.first, 0)], 0).astype(np.int64)
        impact = (IMPACT * highest) // (STEP * highest + LENGTH * opened.m)
        np.add.at(out, queries.query, queries.times * (queries.weight * impact)[queries.term])
    return out


def search_texts(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """``search`` over an index made for the terms of these queries, or of all terms if those are very many."""
    terms = saved(query_terms(items, item, text).select(F.explode("terms").alias("term")).distinct(), "query-terms")
    few = terms.count() <= SENT_TERMS
    only = [r.term for r in terms.collect()] if few else None
    return search(build_index(docs, only, key, text), items, top, item, text)
