"""Logs of several sources as one redacted, ordered table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions import text as X
from millrace.functions import values as V

# ---------------------------------------------------------------------------
# Line patterns and tail bounds.
APP_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+\|\s+([^|]+)\s+\|\s+([A-Z]+)\s+\|\s+(.*)$"
CONTAINER_PREFIX = r"^([^|]{1,80})\|\s?(.*)$"
ISO_PREFIX = r"^(\d{4}-\d{2}-\d{2}T[^\s]+)\s+(.*)$"
TAIL_DEFAULT = 160
# ---------------------------------------------------------------------------


def clamp_tail(value: object = None) -> int:
    try:
        tail = int(TAIL_DEFAULT if value is None else value)
    except (TypeError, ValueError):
        tail = TAIL_DEFAULT
    return max(1, tail)


def _entry(df: DataFrame, source: Column, offset: str, timestamp: Column, level: Column, logger: Column, message: Column, raw: Column, redact: bool) -> DataFrame:
    def clean(c: Column) -> Column:
        return X.redact_log(c) if redact else F.coalesce(c, F.lit(""))

    return df.select(
        source.alias("source"), F.col(offset).alias("offset"), F.when(F.coalesce(timestamp, F.lit("")) != "", clean(timestamp)).alias("timestamp"),
        clean(level).alias("level"), clean(logger).alias("logger"), clean(message).alias("message"), clean(raw).alias("raw"),
    )


def app_entries(lines: DataFrame, source: Column, line: str = "value", offset: str = "offset", redact: bool = True) -> DataFrame:
    """Application log lines; lines of another shape keep their text, blank lines vanish."""
    text = F.col(line)
    parts = [F.regexp_extract(text, APP_LINE, i) for i in range(1, 5)]
    fits = text.rlike(APP_LINE)
    kept = lines.where(fits | (F.trim(text) != ""))
    pick = lambda i, other: F.when(fits, parts[i]).otherwise(other)
    return _entry(kept, source, offset, pick(0, F.lit(None)), pick(2, F.lit("")), F.trim(pick(1, F.lit(""))), pick(3, text), text, redact)


def activity_entries(lines: DataFrame, source: Column, line: str = "value", offset: str = "offset", redact: bool = True) -> DataFrame:
    """Activity JSON lines; lines that are no JSON object vanish."""
    got = F.from_json(F.trim(line), "timestamp STRING, event_type STRING, message STRING, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim(line).startswith("{")).withColumn("_j", got).where("_j IS NOT NULL AND _j._bad IS NULL")
    kind = F.coalesce(F.nullif(F.col("_j.event_type"), F.lit("")), F.lit("activity"))
    message = F.coalesce(F.nullif(F.col("_j.message"), F.lit("")), F.nullif(F.col("_j.event_type"), F.lit("")), F.col(line))
    return _entry(rows, source, offset, F.col("_j.timestamp"), F.lit("INFO"), kind, message, F.col(line), redact)


def container_entries(lines: DataFrame, line: str = "value", offset: str = "offset", redact: bool = True) -> DataFrame:
    """Captured container output: source prefix, ISO time and message."""
    text = F.col(line)
    prefixed = text.rlike(CONTAINER_PREFIX)
    source = F.when(prefixed, F.trim(F.regexp_extract(text, CONTAINER_PREFIX, 1))).otherwise(F.lit("Container"))
    body = F.when(prefixed, F.trim(F.regexp_extract(text, CONTAINER_PREFIX, 2))).otherwise(text)
    stamped = body.rlike(ISO_PREFIX)
    return _entry(
        lines, source, offset, F.when(stamped, F.regexp_extract(body, ISO_PREFIX, 1)), F.lit(""), F.lit(""),
        F.when(stamped, F.regexp_extract(body, ISO_PREFIX, 2)).otherwise(body), text, redact,
    )


def snapshot(entries: Sequence[DataFrame], tail: object = None) -> DataFrame:
    """The last lines over all sources in time order, numbered from 1; lines without a time come first.

    Each source is cut to the tail before the union, both cuts are bounded heaps. Secrets are
    removed from the lines that remain, so sources may be passed with ``redact=False``.
    """
    size = clamp_tail(tail)
    moment = V.as_timestamp(F.regexp_replace("timestamp", ",", "."))
    order = [F.desc_nulls_last("_t"), F.desc("source"), F.desc("offset")]
    cut = [e.withColumn("_t", moment).orderBy(*order).limit(size) for e in entries]
    every = cut[0]
    for frame in cut[1:]:
        every = every.unionByName(frame)
    last = every.orderBy(*order).limit(size).withColumns({c: X.redact_log(F.col(c)) for c in ("level", "logger", "message", "raw")})
    last = last.withColumn("timestamp", F.when(F.col("timestamp").isNotNull(), X.redact_log(F.col("timestamp"))))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_first("_t"), "source", "offset"))  # at most 500 rows
    return last.withColumn("_i", place).withColumn("id", F.concat_ws(":", "source", "_i")).drop("_t", "_i")
