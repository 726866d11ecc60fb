"""A bounded sample of labelled texts for fitting, as rows for one small task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.tables import saved


def training_sample(docs: DataFrame, labels: DataFrame, grade: str, limit: int, allowed: Column | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, y, t): at most ``limit`` labelled texts, those whose hashed id is smallest.

    Labels with a NULL id or grade are left out; of several rows of one id the smallest grade counts.
    Of several texts of one id the one with the smallest hash counts. The chosen ids are bounded by ``limit``, so
    they may be broadcast to the scan of the texts; each task then keeps one text per id.
    """
    rows = labels.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{grade}`").cast("int").alias("y"))
    rows = rows.where("doc_id IS NOT NULL AND y IS NOT NULL")
    if allowed is not None:
        rows = rows.where(allowed)
    chosen = rows.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = saved(chosen, "training-ids")
    texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"))
    first = F.min_by(F.struct("t"), F.struct(F.xxhash64("t"), "t")).alias("first")
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(first).select("doc_id", "y", "first.t")
