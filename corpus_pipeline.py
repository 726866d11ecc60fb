"""Training-corpus pipeline over ``documents``: reject, drop near copies, cut repeats, decontaminate, encode.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a
DataFrame. ``run`` writes each result as Parquet in the shared scratch folder and hands the reread table on.
NULL texts are empty texts in every stage; columns other than those of ``documents`` pass through
unless a stage makes one of that name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import bpe, decontaminate, minhash, quality, repeats
from millrace.llm.tables import free_name, read_table, saved

#: Near copies: five-word shingles, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80
REPEAT_BYTES = 200


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents accepted by the ordinal model, which learns from the graded ones."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.grade(docs, model).where("accepted").select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, one without an id only if none has any.

    Every row is compared by its own text, whatever its id. Rows without words are no copies of each other,
    except rows with one id and one text.
    """
    number, group, order, own = (free_name(docs.columns, w) for w in ("row_number", "row_group", "row_order", "row_text"))
    # Written, so that a row has the same number in every pass.
    numbered = saved(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = minhash.near_duplicates(numbered, SHINGLE, PERCENT, key=number)
    found = found.select(F.col("doc_id").alias(number), F.col("component_id").alias(group), (F.col("n_shingles") > 0).alias("_some"))
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    ranked = numbered.select(number, F.col("doc_id").alias("_id"), text.alias(own), F.xxhash64(*[f"`{c}`" for c in docs.columns]).alias("_all"))
    # The smallest id leads; hashes decide among rows of one id, so that the choice is the same in every run.
    place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col(own).alias("t"), F.col("_all").alias("a"), F.col(number).alias("r"))
    rows = saved(found.join(ranked, number).select(number, group, "_some", "_id", own, place.alias(order)), "ranked")
    copies = rows.where("_some").groupBy(group).agg(F.min(order).alias(order))
    wordless = rows.where("NOT _some")
    alike = wordless.where("_id IS NOT NULL").groupBy("_id", own).agg(F.min(order).alias(order))
    kept = copies.select(f"{order}.r").union(alike.select(f"{order}.r")).union(wordless.where("_id IS NULL").select(number))
    kept = saved(kept.toDF(number), "kept-rows")
    return numbered.join(kept, number, "left_semi").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start elsewhere too; documents with nothing left go.

    A cut may divide a character; its remaining bytes go as well. n_chars is counted anew.
    """
    cut = repeats.remove_repeats(docs, REPEAT_BYTES)
    text = F.when(F.col("n_removed") > 0, F.try_validate_utf8(F.col("kept").cast("string"))).otherwise(F.col("text"))
    whole = F.when(F.col("n_removed") > 0, F.coalesce(text, _mended(F.col("kept")))).otherwise(F.col("text"))
    left = cut.where("n_removed = 0 OR n_removed < n_bytes").withColumn("text", whole)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def _mended(body):
    """Bytes as text; broken characters, replaced by the decoder, are left out."""
    return F.replace(F.make_valid_utf8(body.cast("string")), F.lit("�"), F.lit(""))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_rows(docs, read_table(spark, sf_dir, "benchmark")).select(*docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text with their count and check sums; the decoded ids must give the text again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True)
    whole = F.sha2(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")), 256) == F.col("decoded_sha256")
    return encoded.withColumn("round_trip", whole).drop("decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("byte-level BPE encoding and decoding", byte_level_bpe),
]

#: SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
