"""Balanced shards: global prefix sums of byte sizes, cut at equal targets.

Rows are ordered by (hash of the text, row key), so equal texts stand together. The order is cut into
ranges by Spark's own range partitioning over both columns, which also divides a group of copies that
holds a third of all rows. Only one total per range is summed globally; each range then adds what came
before it. A group of copies that fits into ``group_share`` of a shard goes whole to the shard of its
middle byte; a larger one is divided at the cut.

Defined results: a NULL text counts no bytes and has the check sum of no bytes. Repeated rows are
numbered one after another. An empty table gives no rows. Texts of any length are only measured.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from millrace.llm.tables import saved

ROW_BYTES = 8


def assign_shards(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", group_share: float = 0.005) -> DataFrame:
    """(key, size, text_crc32, shard, slot): contiguous shards of nearly equal bytes.

    ``slot`` numbers the rows of a shard from 0 without gaps. Sizes differ by at most
    ``group_share`` of a shard and one row on either side of a cut.
    """
    body = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    slim = docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        (F.octet_length(body) + F.lit(ROW_BYTES)).cast("bigint").alias("size"),
        F.crc32(body).cast("bigint").alias("text_crc32"),
        F.xxhash64(body).alias("_h"),
    )
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_h", "text_crc32", "size", "doc_id"]
    rows = saved(
        slim.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_r")),
        "shard-rows",
    )
    inside = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    placed = _with_offsets(
        rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))), rows, "_p", F.sum("size"), "_before"
    )
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]  # one number
    target = max(1, total) / shards
    groups = placed.groupBy("_h", "text_crc32", "size").agg(F.min("_before").alias("_g0"), F.count(F.lit(1)).alias("_n"))
    held = F.col("_n") * F.col("size")
    whole = groups.where((F.col("_n") > 1) & (held <= F.lit(target * group_share))).select(
        "_h", "text_crc32", "size", (F.col("_g0") + held / 2).alias("_middle")
    )
    joined = placed.join(whole, ["_h", "text_crc32", "size"], "left")
    middle = F.coalesce(F.col("_middle"), F.col("_before") + F.col("size") / 2)
    shard = F.least(F.lit(shards - 1), F.floor(middle / F.lit(target))).cast("int")
    cut = saved(joined.select("doc_id", "size", "text_crc32", "_p", "_r", shard.alias("shard")), "shard-cut")
    # The order rises with the shard inside a range, so a slot is a count inside (range, shard) plus earlier ranges.
    count = Window.partitionBy("_p", "shard").orderBy("_r")
    numbered = cut.withColumn("_i", F.row_number().over(count) - 1)
    tops = cut.groupBy("_p", "shard").agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("shard").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.select("_p", "shard", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_s"))
    return numbered.join(starts, ["_p", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_s") + F.col("_i")).cast("bigint").alias("slot")
    )


def _with_offsets(frame: DataFrame, rows: DataFrame, part: str, measure, column: str) -> DataFrame:
    """Add to ``column`` what all earlier ranges hold; one total per range is summed globally."""
    totals = rows.groupBy(part).agg(measure.alias("_t"))
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_o"))
    return frame.join(F.broadcast(offsets), part).withColumn(column, F.col(column) + F.col("_o")).drop("_o")
