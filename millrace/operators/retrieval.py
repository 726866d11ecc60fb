"""Hashed embeddings, index build and search, triplets and lexical ranking."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.operators.corpus import reference_haystack
from millrace.operators.ordered import positions
from millrace.operators.profile import table_fingerprint

# ---------------------------------------------------------------------------
# Dimensions, bounds, weights and word lists of the ranking.
DIMENSION, MIN_DIMENSION = 128, 8
DEFAULT_RESULTS = 8
TAG_PENALTY, SCORE_DIGITS = 0.05, 6
NEGATIVE_LABELS = ("negative", "unsafe", "rejected")
TRUSTED = ("project", "system")
FAVOURED_SOURCES = ("project_file", "project_doc", "approved_draft", "mlflow_summary")
TAG_POINTS, TRUST_POINTS, SOURCE_POINTS = 6, 2, 2
STOP_WORDS = ("the", "and", "for", "with", "from", "this", "that", "draft", "create")
# ---------------------------------------------------------------------------


def embedding(text: Column, dimension: int = DIMENSION, instruction: str = "") -> Column:
    """Signed, hashed bag of words of a text, of unit length: worked out where the row lies."""
    body = F.concat(F.lit(instruction + "\n"), F.coalesce(text, F.lit(""))) if instruction else text
    return _weigher(max(MIN_DIMENSION, dimension))(V.terms(body))


def _weigher(size: int):
    """Vectors of arrays of words.

    A word's place is given by the first four bytes of its sha256, modulo the size. It weighs 1 + ln(1 + length), less than
    zero when the fifth byte is odd. Empty words weigh nothing.
    """

    @F.arrow_udf("array<double>")
    def weigh(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()
        own = [w.encode() for w in coded.dictionary.to_pylist()]
        digests = [sha256(w).digest() for w in own]
        places = np.array([int.from_bytes(d[:4], "big") % size for d in digests], np.int64)
        signs = np.array([-1.0 if d[4] & 1 else 1.0 for d in digests])
        lengths = pc.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False)
        weights = np.where(lengths > 0, signs * (1 + np.log1p(lengths)), 0.0)
        rows, codes = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False)), coded.indices.to_numpy(zero_copy_only=False)
        vectors = np.bincount(rows * size + places[codes], weights[codes], len(words) * size).reshape(len(words), size)
        norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        vectors /= np.where(norms == 0, 1.0, norms)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * size, pa.int32()), pa.array(vectors.ravel()))

    return weigh


def hashed_embeddings(df: DataFrame, key: str, text: str, dimension: int = DIMENSION, instruction: str = "") -> DataFrame:
    """(key, embedding): signed, hashed bag of words of unit length, one row per key; rows that share a key count as one text."""
    body = F.concat(F.lit(instruction + "\n"), F.coalesce(text, F.lit(""))) if instruction else F.col(text)
    bags = df.groupBy(key).agg(F.flatten(F.collect_list(V.terms(body))).alias("_w"))
    return bags.select(key, _weigher(max(MIN_DIMENSION, dimension))("_w").alias("embedding"))


def embed_query(spark: SparkSession, query: str, dimension: int = DIMENSION, instruction: str = "") -> list[float]:
    """The vector of one query text, made by the same expressions as the index."""
    return spark.range(1).select(embedding(F.lit(query), dimension, instruction).alias("embedding")).first()["embedding"]


def source_records(references: DataFrame, examples: DataFrame | None = None, text_limit: int | None = None) -> DataFrame:
    """Index sources: references before examples, the first record of every content hash.

    The choice is an aggregate of keys per hash, joined back on the unique record id.
    """
    parts = F.array(*[F.nullif(c, F.lit("")) for c in (F.col("name"), F.col("summary"), F.array_join("excerpts", " "), F.array_join("tags", " "))])
    text = F.array_join(F.array_compact(parts), "\n")
    columns = ("reference_id", "source_type", "name", "summary", "text", "content_hash", "trust_level", "tags")
    every = references.withColumn("text", text).withColumns({
        "content_hash": F.coalesce("content_hash", F.sha2("text", 256)), "text": X.shorten(X.squeeze(F.col("text")), text_limit),
    }).select(*columns, F.lit(0).alias("priority"))
    if examples is not None:
        every = every.unionByName(examples.select(*columns, F.lit(1).alias("priority")))
    first = every.groupBy("content_hash").agg(F.min(F.struct("priority", "reference_id"))["reference_id"].alias("reference_id"))
    return every.join(first.select("reference_id"), "reference_id", "left_semi").drop("priority")


def example_sources(objects: DataFrame, text_limit: int | None = None) -> DataFrame:
    """Catalog samples in the shape of index sources."""
    rows = objects.select("object_name", "family", F.explode("samples").alias("s")).where("s.payload IS NOT NULL")
    digest = F.sha2(F.concat_ws(":", "object_name", "s.tier", "s.payload"), 256)
    return rows.select(
        F.concat_ws("_", F.lit("example"), "object_name", "s.tier", F.substring(digest, 1, 10)).alias("reference_id"),
        F.lit("project_example_catalog").alias("source_type"), F.concat_ws(" ", "object_name", "s.tier").alias("name"),
        F.format_string("%s.%s validated %s example.", "family", "object_name", "s.tier").alias("summary"),
        X.shorten(X.squeeze(F.col("s.payload")), text_limit).alias("text"), digest.alias("content_hash"),
        F.lit("system").alias("trust_level"), F.array(F.lit("project_example"), F.col("family"), F.col("object_name")).alias("tags"),
    )


def build_index(sources: DataFrame, dimension: int = DIMENSION, instruction: str = "") -> DataFrame:
    """Source records with their embedding, each made in its row: the sources are worked out once and not moved for it."""
    return sources.withColumn("embedding", embedding(F.col("text"), dimension, instruction))


def index_status(index: DataFrame) -> DataFrame:
    """One row: record count, dimensions in use and whether they agree."""
    size = F.size("embedding")
    return index.agg(
        F.count(F.lit(1)).alias("record_count"), F.min(size).alias("smallest_dimension"), F.max(size).alias("largest_dimension"),
    ).withColumn("status", F.when(F.col("record_count") == 0, "empty").when(F.col("smallest_dimension") != F.col("largest_dimension"), "mixed").otherwise("ok"))


def clamp_results(limit: int | None) -> int:
    return max(1, int(limit or DEFAULT_RESULTS))


def search(index: DataFrame, query_vector: Sequence[float], tags: Sequence[str] = (), limit: int = DEFAULT_RESULTS, key: str = "reference_id") -> DataFrame:
    """The best records by cosine similarity; records without a wanted tag lose a little.

    The one query vector enters as a literal. Ranking is a bounded heap per task.
    """
    score = V.cosine(F.col("embedding").cast("array<double>"), F.lit([float(x) for x in query_vector]))
    wanted = sorted({t.strip().lower() for t in tags if t.strip()})
    if wanted:
        hit = F.arrays_overlap(F.transform("tags", lambda t: F.lower(F.trim(t))), F.array(*[F.lit(t) for t in wanted]))
        score = score - F.when(F.coalesce(hit, F.lit(False)), F.lit(0.0)).otherwise(F.lit(TAG_PENALTY))
    return index.withColumn("score", F.round(score, SCORE_DIGITS)).orderBy(F.desc("score"), key).limit(clamp_results(limit))


def triplets(queries: DataFrame, query_key: str, documents: DataFrame, document_key: str) -> DataFrame:
    """Query i with document i mod n as positive and (i + n/2) mod n as negative.

    Both sides are numbered without a single-task sort and joined on the number, which every
    document receives equally often. Columns that a side lacks count as missing: ``workflow_type`` and ``source_hash`` of
    queries, ``source_type``, ``content_hash``, ``text`` and ``summary`` of documents.
    """
    def own(df: DataFrame, name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    numbered = positions(documents, [], [document_key], "_p").withColumn("_p", F.col("_p") - 1)
    size = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    asked = positions(queries, [], [query_key], "_i").withColumn("_i", F.col("_i") - 1)
    half = F.greatest(F.lit(1), F.floor(size / 2))
    spots = asked.withColumns({"_pos": F.col("_i") % size, "_neg": F.when(size > 1, (F.col("_i") + half) % size)})
    label = F.when(F.lower(F.coalesce("label", F.lit("unlabeled"))).isin(*NEGATIVE_LABELS), "negative").otherwise("positive")
    text = F.coalesce(F.nullif(own(documents, "text"), F.lit("")), own(documents, "summary"), F.lit(""))
    slim = numbered.select("_p", F.col(document_key).alias("_k"), text.alias("_x"), own(documents, "source_type").alias("_s"), own(documents, "content_hash").alias("_h"))
    good = slim.select(F.col("_p").alias("_pos"), F.col("_k").alias("positive_id"), F.col("_x").alias("positive_text"), "_s", "_h")
    bad = slim.select(F.col("_p").alias("_neg"), F.col("_k").alias("negative_id"), F.col("_x").alias("negative_text"))
    spots = spots.select("_pos", "_neg", query_key, "query", label.alias("label"), own(queries, "workflow_type").alias("workflow_type"), own(queries, "source_hash").alias("_q"))
    return spots.join(good, "_pos", "left").join(bad, "_neg", "left").select(
        query_key, "query", "label", "positive_id", "negative_id",
        F.coalesce("positive_text", F.lit("")).alias("positive_text"), F.coalesce("negative_text", F.lit("")).alias("negative_text"),
        F.coalesce(F.nullif("_s", F.lit("")), F.lit("assistant_training")).alias("source_type"), "workflow_type",
        F.array_compact(F.array(F.col("positive_id").cast("string"), F.col("negative_id").cast("string"))).alias("reference_ids"),
        F.coalesce(F.nullif("_q", F.lit("")), "_h").alias("source_hash"),
    )


def triplet_manifest(examples: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: number, labels and hash of the examples, and the sizes of what they were made from."""
    counts = examples.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    one = lambda df: df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return table_fingerprint(examples).select(
        F.lit("prepared").alias("status"), F.current_timestamp().alias("created_at"), F.sha2("fingerprint", 256).alias("examples_hash"),
        F.col("rows").alias("record_count"), counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("m")).scalar().alias("label_counts"),
        one(documents).alias("source_document_count"), one(queries).alias("interaction_query_count"), (F.col("rows") > 0).alias("ready_for_fine_tuning"),
    )


def fallback_queries(sources: DataFrame, limit: int | None = None) -> DataFrame:
    """Queries made from the sources (the first ``limit``) when there are no interactions."""
    first = sources if limit is None else sources.orderBy("reference_id").limit(limit)
    return first.select(
        F.col("reference_id").alias("query_id"), F.concat(F.lit("Find project context for "), F.coalesce("name", "source_type")).alias("query"),
        F.lit("positive").alias("label"),
    )


def query_terms(query: str) -> list[str]:
    """Distinct words of three or more characters without the stop words."""
    import re

    return sorted(set(re.findall(r"[a-z0-9_]{3,}", query.lower())) - set(STOP_WORDS))


def lexical_scores(references: DataFrame, query: str = "", tags: Sequence[str] = ()) -> DataFrame:
    """Adds ``score``: tag overlap, trust, source type and query words found."""
    import re

    wanted = sorted({t for t in (re.sub(r"[^a-z0-9_]+", "_", tag.strip().lower()).strip("_") for tag in tags) if t})
    own = F.array_distinct(F.filter(F.transform("tags", X.slug), lambda t: t != ""))
    score = F.when(F.col("trust_level").isin(*TRUSTED), TRUST_POINTS).otherwise(0) + F.when(
        F.col("source_type").isin(*FAVOURED_SOURCES), SOURCE_POINTS
    ).otherwise(0)
    if wanted:
        score = score + TAG_POINTS * F.size(F.array_intersect(own, F.array(*[F.lit(t) for t in wanted])))
    out = references.withColumn("_hay", reference_haystack())
    for term in query_terms(query):
        score = score + F.col("_hay").contains(term).cast("int")
    return out.withColumn("score", score).drop("_hay")


def rank_references(references: DataFrame, query: str = "", tags: Sequence[str] = (), limit: int = DEFAULT_RESULTS) -> DataFrame:
    """Best references with a positive score, newest first among equals."""
    scored = lexical_scores(references, query, tags)
    best = scored.orderBy(F.desc("score"), F.desc("updated_at"), "reference_id").limit(clamp_results(limit))
    return best.where("score > 0")  # after the cut: the same rows, and the score is computed once


def selected_pack(references: DataFrame, ids: Sequence[str], query: str = "", tags: Sequence[str] = (), limit: int = DEFAULT_RESULTS) -> DataFrame:
    """Named references in their order, then ranked ones until the pack is full, no duplicates."""
    wanted = list(dict.fromkeys(str(i) for i in ids))
    place = F.lit(None).cast("int")
    for i, ref in reversed(list(enumerate(wanted))):
        place = F.when(F.col("reference_id") == ref, F.lit(i)).otherwise(place)
    named = references.where(F.col("reference_id").isin(wanted)).withColumns({"_g": F.lit(0), "_a": place.cast("double"), "score": F.lit(0)})
    packs = named
    if query or tags:
        others = references.where(~F.col("reference_id").isin(wanted))
        ranked = rank_references(others, query, tags, limit)
        packs = named.unionByName(ranked.withColumns({"_g": F.lit(1), "_a": -F.col("score").cast("double")}))
    order = ["_g", "_a", F.desc("updated_at"), "reference_id"]
    return packs.orderBy(*order).limit(clamp_results(limit)).drop("_g", "_a")
