"""Stream queries: tables are written as file drops, streamed to the end and checked as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.plans.registry import query, table
from millrace.plans.run_queries import _APP, _APP_CLEAN, _UPDATES, app_lines, updates
from millrace.session import scratch_path
from millrace.sources.lines import read_lines
from millrace.streaming import streams as T


@query(
    "stream_redacted_log",
    "STR-1",
    f"WITH {_APP}, m AS (SELECT {_APP_CLEAN} AS message, event_id % 9 <> 0 AS parsed, event_type FROM a) SELECT message, CASE WHEN parsed THEN 'app.' || event_type ELSE '' END AS logger, count(*) AS n FROM m GROUP BY 1, 2",
)
def stream_redacted_log(spark, sf_dir):
    drop, out, mark = (scratch_path(spark, n) for n in ("log-in", "log-out", "log-mark"))
    app_lines(spark, sf_dir).select("value").repartition(6).write.text(drop)
    T.redacted_log_stream(spark, drop, out, mark).awaitTermination()
    return spark.read.parquet(out).groupBy("message", "logger").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_line_offsets",
    "STR-1 LOG-1",
    f"WITH {_APP} SELECT count(*) AS lines, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes, count(*) AS in_place FROM a",
)
def source_line_offsets(spark, sf_dir):
    """Lines of log files with the bytes at which they start; those are in place that start where the line before ends."""
    drop = scratch_path(spark, "offset-in")
    app_lines(spark, sf_dir).repartitionByRange(6, "offset").select("value").write.text(drop)
    rows = read_lines(spark, drop).withColumn("size", F.octet_length("value") + 1)
    ends = rows.select("file", (F.col("offset") + F.col("size")).alias("offset"), F.lit(True).alias("follows"))
    placed = rows.join(ends, ["file", "offset"], "left")
    return placed.agg(
        F.count(F.lit(1)).alias("lines"), F.sum("size").cast("bigint").alias("bytes"), F.count_if((F.col("offset") == 0) | F.col("follows")).alias("in_place")
    )


@query(
    "stream_run_state",
    "STR-2",
    f"""WITH {_UPDATES} SELECT run_id, arg_max(status, (ts, seq)) FILTER (WHERE status IS NOT NULL) AS status, arg_max(stage, (ts, seq)) FILTER (WHERE stage IS NOT NULL) AS stage,
        count(message) AS event_count, arg_max(k, (ts, seq)) AS k FROM w GROUP BY run_id""",
)
def stream_run_state(spark, sf_dir):
    """Updates arrive in two drops; the state is carried from the first to the second."""
    drop, out, mark = (scratch_path(spark, n) for n in ("state-in", "state-out", "state-mark"))
    rows = updates(spark, sf_dir).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    for part in (0, 1):
        rows.where(F.col("seq") % 2 == part).repartition(3).write.mode("append").json(drop)
        T.run_state_stream(spark, drop, out, mark).awaitTermination()
    return T.current_states(spark, out).select("run_id", "status", "stage", "event_count", F.element_at("metrics", "k").alias("k"))


@query(
    "stream_corpus",
    "STR-3",
    r"""SELECT count(DISTINCT sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(api[_-]?key|authorization|bearer|password|secret|token)\s*[:=]\s*[''\"]?[^''\"\s,;]+', '\1=[REDACTED]', 'g'),
        '(?i)bearer\s+[a-z0-9._\-]+', 'secret=[REDACTED]', 'g'), '\s+', ' ', 'g')))) AS stored, count(DISTINCT sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(api[_-]?key|authorization|bearer|password|secret|token)\s*[:=]\s*[''\"]?[^''\"\s,;]+', '\1=[REDACTED]', 'g'),
        '(?i)bearer\s+[a-z0-9._\-]+', 'secret=[REDACTED]', 'g'), '\s+', ' ', 'g')))) AS hashes FROM documents""",
)
def stream_corpus(spark, sf_dir):
    """Documents arrive in two drops; a text stored from the first is skipped in the second."""
    drop, out, mark = (scratch_path(spark, n) for n in ("corpus-in", "corpus-out", "corpus-mark"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).write.mode("append").json(drop)  # as many files as the table has pieces
        T.corpus_stream(spark, drop, out, mark).awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("stored"), F.count_distinct("content_hash").alias("hashes"))
