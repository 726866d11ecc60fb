"""Embedding, search and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators import retrieval as R
from millrace.plans.corpus_queries import REFERENCES_SQL, example_objects, references
from millrace.plans.registry import query, table


def _embedding_sql(name: str, source: str, key: str, text: str, dimension: int) -> str:
    """CTEs <name>_w .. <name>: sparse unit vectors of a text column."""
    return f"""{name}_t AS (SELECT {key} AS k, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS ts FROM {source}),
    {name}_w AS (SELECT k, unnest(CASE WHEN len(ts) = 0 THEN ['empty'] ELSE ts END) AS w FROM {name}_t),
    {name}_e AS (SELECT k, CAST(('0x' || substr(sha256(w), 1, 8)) AS UBIGINT) % {dimension} AS b,
        sum(CASE WHEN CAST(('0x' || substr(sha256(w), 9, 2)) AS UBIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END * (1 + ln(1 + length(w)))) AS x FROM {name}_w GROUP BY 1, 2),
    {name}_n AS (SELECT k, sqrt(sum(x * x)) AS norm FROM {name}_e GROUP BY k),
    {name} AS (SELECT k, b, CASE WHEN norm = 0 THEN 0.0 ELSE x / norm END AS x FROM {name}_e JOIN {name}_n USING (k))"""


@query(
    "retrieval_hashed_embeddings",
    "VEC-1",
    f"""WITH {_embedding_sql('v', 'documents', 'doc_id', 'text', 128)}
    SELECT k AS doc_id, CAST(b AS INTEGER) AS bucket, round(x, 6) + 0.0 AS x FROM v WHERE round(x, 6) <> 0""",
)
def retrieval_hashed_embeddings(spark, sf_dir):
    made = R.hashed_embeddings(table(spark, sf_dir, "documents"), "doc_id", "text")
    long = made.select("doc_id", F.posexplode("embedding").alias("bucket", "x")).withColumn("x", F.round("x", 6))
    return long.where("x <> 0")


@query(
    "retrieval_instruction_prefix",
    "VEC-2",
    f"""WITH q AS (SELECT item_id, 'Represent the document:' || chr(10) || text AS text FROM benchmark), {_embedding_sql('v', 'q', 'item_id', 'text', 64)}
    SELECT k AS item_id, count(*) FILTER (WHERE abs(x) > 1e-12) AS filled, round(sum(x * x), 6) AS length, round(sum(x), 6) AS total FROM v GROUP BY k""",
)
def retrieval_instruction_prefix(spark, sf_dir):
    made = R.hashed_embeddings(table(spark, sf_dir, "benchmark"), "item_id", "text", 64, "Represent the document:")
    e = F.col("embedding")
    return made.select(
        "item_id", F.size(F.filter(e, lambda x: F.abs(x) > 1e-12)).cast("bigint").alias("filled"),
        F.round(V.dot(e, e), 6).alias("length"), F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


def sources(spark, sf_dir):
    return R.source_records(references(spark, sf_dir), R.example_sources(example_objects(spark, sf_dir)))


_SOURCES_SQL = f"""{REFERENCES_SQL}, o AS (SELECT 'Part' || p_partkey AS o, lower(p_type) AS f, t.tier, '{{"p_name":"' || p_name || '","p_brand":"' || p_brand || '","rows":' || t.n || '}}' AS payload
      FROM part, (VALUES ('small', 10), ('large', 1000)) t(tier, n)),
    x AS (SELECT *, sha256(o || ':' || tier || ':' || payload) AS h FROM o),
    u AS (SELECT reference_id, source_type, coalesce(content_hash, '-') AS content_hash, 0 AS priority FROM r
      UNION ALL SELECT 'example_' || o || '_' || tier || '_' || substr(h, 1, 10), 'project_example_catalog', h, 1 FROM x),
    k AS (SELECT reference_id, source_type, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY priority, reference_id) AS rn FROM u) WHERE rn = 1)"""


@query("retrieval_sources", "VEC-3", f"WITH {_SOURCES_SQL} SELECT reference_id, source_type, content_hash FROM k")
def retrieval_sources(spark, sf_dir):
    return sources(spark, sf_dir).select("reference_id", "source_type", "content_hash")


@query(
    "retrieval_index_status",
    "VEC-4 SNK-5",
    f"WITH {_SOURCES_SQL} SELECT count(*) AS record_count, 64 AS smallest_dimension, 64 AS largest_dimension, 'ok' AS status FROM k",
)
def retrieval_index_status(spark, sf_dir):
    return R.index_status(R.build_index(sources(spark, sf_dir), 64))


@query(
    "retrieval_search_vectors",
    "VEC-5",
    """
    WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
    e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, (SELECT v FROM q) AS w FROM embeddings)
    SELECT vec_id, label, round(list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))
        - CASE WHEN label IN (1, 2) THEN 0 ELSE 0.05 END, 6) AS score FROM e ORDER BY score DESC, vec_id LIMIT 50
    """,
)
def retrieval_search_vectors(spark, sf_dir):
    index = table(spark, sf_dir, "embeddings").withColumn("tags", F.array(F.concat(F.lit("Label "), F.col("label").cast("string"))))
    probe = index.where("vec_id = 0").first()["embedding"]
    found = R.search(index, probe, ["label 1", "LABEL 2"], 50, key="vec_id")
    return found.select("vec_id", "label", "score")


@query(
    "retrieval_search_text",
    "VEC-2 VEC-5",
    f"""WITH {_embedding_sql('v', 'documents', 'doc_id', 'text', 128)},
    one AS (SELECT 0 AS id, 'the thing on hand and the elle' AS text), {_embedding_sql('q', 'one', 'id', 'text', 128)},
    s AS (SELECT d.doc_id, d.lang, round(coalesce(sum(v.x * q.x), 0) - CASE WHEN d.lang = 'fr' THEN 0 ELSE 0.05 END, 6) AS score
        FROM documents d LEFT JOIN v ON v.k = d.doc_id LEFT JOIN q ON q.b = v.b GROUP BY d.doc_id, d.lang)
    SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT 10""",
)
def retrieval_search_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array("lang").alias("tags"))
    index = docs.select("doc_id", "tags", R.embedding(F.col("text")).alias("embedding"))
    probe = R.embed_query(spark, "the thing on hand and the elle")
    return R.search(index, probe, ["fr"], 10, key="doc_id").select("doc_id", "score")


@query(
    "retrieval_triplets",
    "VEC-6",
    """
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, doc_id FROM documents),
    n AS (SELECT count(*) AS n FROM documents),
    q AS (SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS i, conv_id * 1000 + turn AS query_id, conv_id FROM conversations WHERE role = 'user')
    SELECT query_id, CASE WHEN conv_id % 3 = 1 THEN 'negative' ELSE 'positive' END AS label, g.doc_id AS positive_id, b.doc_id AS negative_id
    FROM q, n JOIN d g ON g.p = q.i % n.n JOIN d b ON b.p = (q.i + greatest(1, n.n // 2)) % n.n
    """,
)
def retrieval_triplets(spark, sf_dir):
    label = F.when(F.col("conv_id") % 3 == 1, "Rejected").when(F.col("conv_id") % 3 == 2, "positive")
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), label.alias("label")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return R.triplets(asked, "query_id", docs, "doc_id").select("query_id", "label", "positive_id", "negative_id")


_TRIPLET_SIDES = """d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, doc_id, source, md5(text) AS h FROM documents),
    n AS (SELECT count(*) AS n FROM documents),
    q AS (SELECT row_number() OVER (ORDER BY conv_id * 1000 + turn) - 1 AS i, conv_id * 1000 + turn AS query_id, conv_id, text FROM conversations WHERE role = 'user')"""


def _triplets(spark, sf_dir):
    label = F.when(F.col("conv_id") % 3 == 1, "Rejected").when(F.col("conv_id") % 3 == 2, "positive")
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"), label.alias("label"), F.lit("chat").alias("workflow_type"),
        F.when(F.col("conv_id") % 2 == 0, F.md5("text")).alias("source_hash"),
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source_type"), F.md5("text").alias("content_hash"))
    return R.triplets(asked, "query_id", docs, "doc_id"), asked, docs


@query(
    "retrieval_triplet_facts",
    "VEC-6",
    f"""WITH {_TRIPLET_SIDES}
    SELECT query_id, CASE WHEN g.doc_id % 4 <> 0 THEN coalesce(g.source, 'assistant_training') ELSE 'assistant_training' END AS source_type, 'chat' AS workflow_type,
      g.doc_id || ',' || b.doc_id AS reference_ids, CASE WHEN conv_id % 2 = 0 THEN md5(q.text) ELSE g.h END AS source_hash
    FROM q, n JOIN d g ON g.p = q.i % n.n JOIN d b ON b.p = (q.i + greatest(1, n.n // 2)) % n.n""",
)
def retrieval_triplet_facts(spark, sf_dir):
    made, _, _ = _triplets(spark, sf_dir)
    return made.select("query_id", "source_type", "workflow_type", F.array_join("reference_ids", ",").alias("reference_ids"), "source_hash")


@query(
    "retrieval_triplet_manifest",
    "VEC-6",
    """SELECT 'prepared' AS status, count(*) AS record_count, count(*) FILTER (WHERE conv_id % 3 = 1) AS negatives, count(*) FILTER (WHERE conv_id % 3 <> 1) AS positives,
       (SELECT count(*) FROM documents) AS source_document_count, count(*) AS interaction_query_count, true AS ready_for_fine_tuning FROM conversations WHERE role = 'user'""",
)
def retrieval_triplet_manifest(spark, sf_dir):
    made = R.triplet_manifest(*_triplets(spark, sf_dir))
    return made.select("status", "record_count", F.col("label_counts")["negative"].alias("negatives"), F.col("label_counts")["positive"].alias("positives"),
                       "source_document_count", "interaction_query_count", "ready_for_fine_tuning")


@query(
    "retrieval_fallback_queries",
    "VEC-6",
    f"WITH {REFERENCES_SQL} SELECT reference_id AS query_id, 'Find project context for ' || name AS query, 'positive' AS label FROM r",
)
def retrieval_fallback_queries(spark, sf_dir):
    return R.fallback_queries(references(spark, sf_dir))


_SCORE = """(SELECT reference_id, name, age, 6 * (CAST(lang = 'fr' AS INT) + CAST(source = 'src3' AS INT)) + CASE WHEN trust_level = 'project' THEN 2 ELSE 0 END
      + CASE WHEN source_type = 'project_file' THEN 2 ELSE 0 END + CAST(contains(hay, 'elle') AS INT) + CAST(contains(hay, 'project') AS INT) + CAST(contains(hay, 'que') AS INT) AS score FROM r)"""


@query("retrieval_lexical_scores", "VEC-7", f"WITH {REFERENCES_SQL} SELECT reference_id, CAST(score AS INTEGER) AS score FROM {_SCORE}")
def retrieval_lexical_scores(spark, sf_dir):
    return R.lexical_scores(references(spark, sf_dir), "Create the elle project, from que", ["FR", " src3 "]).select("reference_id", "score")


@query(
    "retrieval_lexical_rank",
    "VEC-7",
    f"WITH {REFERENCES_SQL} SELECT reference_id, CAST(score AS INTEGER) AS score FROM {_SCORE} WHERE score > 0 ORDER BY score DESC, age DESC, reference_id LIMIT 40",
)
def retrieval_lexical_rank(spark, sf_dir):
    return R.rank_references(references(spark, sf_dir), "Create the elle project, from que", ["FR", " src3 "], 40).select("reference_id", "score")


@query(
    "retrieval_selected_pack",
    "VEC-8",
    f"""WITH {REFERENCES_SQL} SELECT reference_id FROM (
      SELECT reference_id, 0 AS g, CASE reference_id WHEN 'ref_00000007' THEN 0 ELSE 1 END AS a, age FROM r WHERE reference_id IN ('ref_00000007', 'ref_00000003')
      UNION ALL SELECT reference_id, 1, -score, age FROM {_SCORE} WHERE score > 0 AND reference_id NOT IN ('ref_00000007', 'ref_00000003'))
    ORDER BY g, a, age DESC, reference_id LIMIT 8""",
)
def retrieval_selected_pack(spark, sf_dir):
    ids = ["ref_00000007", "ref_00000003", "ref_00000007", "unknown"]
    return R.selected_pack(references(spark, sf_dir), ids, "Create the elle project, from que", ["FR", " src3 "]).select("reference_id")
