"""Stream forms of the append-only sources.

Checkpoints and outputs lie in the shared store, so a stream that lost its executors goes on where it stopped. A
batch writes a folder of its own that is replaced when the batch is repeated. Tests drive the streams with
``availableNow``.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions import text as X
from millrace.operators import logs as L
from millrace.operators.runs import FINAL_STATES
from millrace.sources.lines import line_columns, with_offsets

UPDATE_SCHEMA = "run_id string, seq bigint, ts timestamp, status string, stage string, message string, metrics map<string,string>"
DOCUMENT_SCHEMA = "doc_id bigint, text string"
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _run(stream: DataFrame, save: Callable[[DataFrame, int], None], checkpoint: str, once: bool, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    """Settings that a stream takes over when it starts."""
    before = {name: spark.conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def redacted_log_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Lines of new log files, parsed and redacted, with the byte at which each starts in its file."""
    lines = spark.readStream.option("lineSep", "\n").text(folder).select(*line_columns())

    def save(batch: DataFrame, number: int) -> None:
        entries = L.app_entries(with_offsets(batch), F.regexp_replace("file", r"\.[^.]*$", ""))
        entries.write.mode("overwrite").parquet(f"{output}/part={number}")

    return _run(lines, save, checkpoint, once)


# Run states. A state row holds each value with the place (ts, seq) of the update that told it, so rows of one
# run can be folded in any order and as often as needed.


def _fold(rows: DataFrame) -> DataFrame:
    """State rows of a run put together."""
    whole = rows.groupBy("run_id").agg(
        *[F.max(c).alias(c) for c in ("status", "stage", "updated_at", "completed_at")], *[F.min(c).alias(c) for c in ("created_at", "started_at")],
        F.sum("event_count").alias("event_count"),
    )
    told = rows.select("run_id", F.explode("metrics").alias("key", "told")).groupBy("run_id", "key").agg(F.max("told").alias("told"))
    maps = told.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "told")))).alias("metrics"))
    return whole.join(maps, "run_id", "left")


def _told(value: Column) -> Column:
    return F.struct(F.struct("ts", "seq").alias("at"), value.alias("value"))


def _state_rows(updates: DataFrame) -> DataFrame:
    known = lambda c: F.max(F.when(F.col(c).isNotNull(), _told(F.col(c)))).alias(c)
    whole = updates.groupBy("run_id").agg(
        known("status"), known("stage"), F.max("ts").alias("updated_at"),
        F.max(F.when(F.col("status").isin(*FINAL_STATES), F.col("ts"))).alias("completed_at"), F.min("ts").alias("created_at"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.count_if(F.coalesce("message", F.lit("")) != "").alias("event_count"),
    )
    told = updates.select("run_id", "ts", "seq", F.explode("metrics").alias("key", "value")).groupBy("run_id", "key").agg(F.max(_told(F.col("value"))).alias("told"))
    maps = told.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "told")))).alias("metrics"))
    return whole.join(maps, "run_id", "left")


def run_state_stream(
    spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True, keep: str = "1 day", files_per_batch: int | None = None
) -> StreamingQuery:
    """Current state per run from appended update documents.

    A batch folds its updates with the active states and writes them as a new version. Runs without an update for
    ``keep`` before the newest one leave the active states for good; an update that comes later starts a new row, which
    ``current_states`` folds with the old one. Older versions of active states are removed, so neither the work of a
    batch nor the stored state grows with finished runs.
    """
    reader = spark.readStream.schema(UPDATE_SCHEMA)
    updates = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(folder)

    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = _state_rows(batch)
        before = [v for v in _versions(session, target) if v < number]
        if before:
            active = session.read.schema(rows.schema).parquet(f"{target}/version={before[-1]}/left=false")
            rows = _fold(rows.unionByName(active))
        rows = rows.withColumn("_batch", F.lit(number))
        newest = rows.agg(F.max("updated_at")).first()[0]
        left = F.col("updated_at") < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL '{keep.split()[0]}' {keep.split()[1]}")
        out = f"{target}/version={number}"
        split = rows.drop("_batch").withColumn("left", F.coalesce(left, F.lit(False)).cast("string"))
        for state in ("false", "true"):
            split.where(F.col("left") == state).drop("left").write.mode("overwrite").parquet(f"{out}/left={state}")
        session.range(1).write.mode("overwrite").parquet(f"{out}/written")  # names a version whose two parts are whole
        for old in before[:-1]:
            _remove(session, f"{target}/version={old}/left=false")

    return _run(updates, save, checkpoint, once)


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the versions that are written whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/version=*/written/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getParent().getName().split("=")[1]) for f in found or [])


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def state_rows(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(active state rows, rows of runs that have left): what a run state stream has stored."""
    versions = _versions(spark, target)
    schema = _state_rows(spark.createDataFrame([], UPDATE_SCHEMA)).schema
    reader = spark.read.schema(schema)
    return reader.parquet(f"{target}/version={versions[-1]}/left=false"), reader.parquet(*[f"{target}/version={v}/left=true" for v in versions])


def current_states(spark: SparkSession, target: str) -> DataFrame:
    """One row per run: what the fold of all its updates gives."""
    active, gone = state_rows(spark, target)
    value = lambda c: F.col(f"{c}.value").alias(c)
    return _fold(active.unionByName(gone)).select(
        "run_id", value("status"), value("stage"), "created_at", "updated_at", "started_at", "completed_at", "event_count",
        F.transform_values("metrics", lambda k, v: v["value"]).alias("metrics"),
    )


def corpus_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, once: bool = True, files_per_batch: int | None = None) -> StreamingQuery:
    """Texts (doc_id, text) appended without content that is already stored; of equal new texts the smallest doc_id stays.

    The stream's state, kept on disk, holds for each content hash the time of the batch that brought it, the document
    and its file. A batch touches the state of its own hashes only, and reads the texts of new ones again from
    its own files: stored texts are never read. Batch times must not fall.
    """
    reader = spark.readStream.schema(DOCUMENT_SCHEMA)
    docs = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(folder)
    now = F.current_timestamp()  # the same for all rows of a batch, also when it is repeated
    hashed = docs.select("doc_id", F.col("_metadata.file_path").alias("file"), X.content_hash(F.col("text")).alias("content_hash"), now.alias("batch"))
    first = F.min(F.struct("batch", "doc_id", "file")).alias("first")
    seen = hashed.where("content_hash IS NOT NULL").groupBy("content_hash").agg(first)
    seen = seen.select("content_hash", "first.doc_id", "first.file", (F.col("first.batch") == now).alias("fresh"))

    def save(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        fresh = batch.where("fresh").drop("fresh").persist()
        files = [r.file for r in fresh.select("file").distinct().collect()]  # files of this batch
        if files:
            read = session.read.schema(DOCUMENT_SCHEMA).json(files).withColumn("file", F.col("_metadata.file_path"))
            texts = read.withColumn("content_hash", X.content_hash(F.col("text")))
            kept = texts.join(fresh, ["doc_id", "file", "content_hash"], "left_semi")
            # A hash has one file here; with it in the key, texts stay where the join put them.
            kept = kept.groupBy("doc_id", "file", "content_hash").agg(F.min("text").alias("text")).select("doc_id", "text", "content_hash")
        else:
            kept = session.createDataFrame([], "doc_id bigint, text string, content_hash string")
        kept.write.mode("overwrite").parquet(f"{target}/part={number}")
        fresh.unpersist()

    with _settings(spark, _ROCKS):
        return _run(seen, save, checkpoint, once, "update")
