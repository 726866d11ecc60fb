"""Streams: bounded state, restarts, line offsets."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from millrace.operators import logs as L
from millrace.operators import runs as U
from millrace.sources.lines import read_lines
from millrace.streaming import streams as T


def files(folder, rows, name, per_file=4):
    folder.mkdir(exist_ok=True)
    for k in range(0, len(rows), per_file):
        (folder / f"{name}-{k:04d}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[k : k + per_file]))


def test_offsets_are_those_of_the_file(spark, tmp_path):
    rng = random.Random(1)
    lines = [rng.choice(["", "x", "é" * rng.randint(1, 30), "word " * rng.randint(1, 40), "ends\r"]) for _ in range(3000)]
    for name, end in (("a.log", "\n"), ("b.log", "")):
        (tmp_path / name).write_bytes(("\n".join(lines) + end).encode())
    want, at = {}, 0
    for line in lines:
        want[at] = line.removesuffix("\r")
        at += len(line.encode()) + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = read_lines(spark, str(tmp_path))
        rows = found.collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        for name, value in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before):
            spark.conf.set(name, value)
    for name in ("a.log", "b.log"):
        got = {r.offset: r.value for r in rows if r.file == name}
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert "Python" not in found._jdf.queryExecution().toString()


def test_log_stream_keeps_the_order_of_a_file(spark, tmp_path):
    """Equal time stamps: the snapshot follows the file, batch and stream."""
    (tmp_path / "in").mkdir()
    lines = [f"2024-01-01 10:00:00 | app | INFO | step {k}" for k in range(200)]
    (tmp_path / "in" / "app.log").write_text("\n".join(lines[:100]) + "\n")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    T.redacted_log_stream(spark, str(tmp_path / "in"), out, mark).awaitTermination()
    (tmp_path / "in" / "worker.log").write_text("\n".join(lines[100:]) + "\n")
    T.redacted_log_stream(spark, str(tmp_path / "in"), out, mark).awaitTermination()
    stored = spark.read.parquet(out).drop("part")
    assert stored.count() == 200 and stored.where("offset IS NULL").count() == 0
    batch = L.app_entries(read_lines(spark, str(tmp_path / "in")), F.regexp_replace("file", r"\.[^.]*$", ""))
    for entries in (stored, batch):
        shown = L.snapshot([entries], 500).orderBy(F.substring_index("id", ":", 1), F.substring_index("id", ":", -1).cast("int")).collect()
        assert [r.message for r in shown] == [f"step {k}" for k in range(200)]


def run_updates():
    rng = random.Random(6)
    rows = []
    for k in range(120):
        run, hour = rng.randrange(12), rng.randrange(60)
        rows.append({"run_id": f"r{run}", "seq": k, "ts": f"2024-01-{1 + run // 2:02d}T{hour % 24:02d}:{hour:02d}:00.000Z", "status": rng.choice([None, "queued", "running", "completed", "failed"]),
                     "stage": rng.choice([None, "load", "fit"]), "message": rng.choice([None, "", "told"]), "metrics": rng.choice([None, {}, {"a": str(k)}, {"a": str(k), "b": "x"}])})
    return rows


def test_late_and_unordered_updates_give_the_batch_fold(spark, tmp_path):
    rows = run_updates()
    random.Random(1).shuffle(rows)
    source, target, mark = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "mark")
    for part in range(3):
        files(source, rows[part * 40 : part * 40 + 40], f"u{part}")
        T.run_state_stream(spark, str(source), target, mark, keep="2 hours", files_per_batch=4).awaitTermination()
    updates = spark.read.schema(T.UPDATE_SCHEMA).json(str(source))
    names = ["run_id", "status", "stage", "created_at", "updated_at", "started_at", "completed_at", "event_count"]
    got = {tuple(r) for r in T.current_states(spark, target).select(*names).collect()}
    assert got == {tuple(r) for r in U.fold_state(updates).select(*names).collect()} and len(got) == 12
    maps = {(r.run_id, k, v) for r in T.current_states(spark, target).collect() for k, v in (r.metrics or {}).items()}
    assert maps == {tuple(r) for r in U.fold_maps(updates, "metrics").collect()}


def test_state_shrinks_after_runs_end(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "mark")

    def update(run, day, status):
        return {"run_id": run, "seq": day, "ts": f"2024-01-{day:02d}T00:00:00.000Z", "status": status}

    files(source, [update(f"old{k}", 1, "completed") for k in range(20)], "a")
    T.run_state_stream(spark, str(source), target, mark, keep="3 days").awaitTermination()
    assert T.state_rows(spark, target)[0].count() == 20
    for day in range(2, 9):
        files(source, [update(f"new{day}", day, "running")], f"b{day}")
        T.run_state_stream(spark, str(source), target, mark, keep="3 days").awaitTermination()
    active, gone = T.state_rows(spark, target)
    assert active.count() == 4 and gone.count() == 23
    kept = [p for p in (tmp_path / "state").glob("version=*/left=false")]
    assert len(kept) <= 2  # older versions of active states are gone
    files(source, [update("old3", 8, "failed")], "late")
    T.run_state_stream(spark, str(source), target, mark, keep="3 days").awaitTermination()
    states = {r.run_id: r for r in T.current_states(spark, target).collect()}
    assert len(states) == 27 and states["old3"].status == "failed" and states["old3"].created_at.day == 1


def test_half_written_version_is_not_read(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "mark")
    files(source, [{"run_id": "a", "seq": 1, "ts": "2024-01-01T00:00:00.000Z", "status": "running"}], "a")
    T.run_state_stream(spark, str(source), target, mark).awaitTermination()
    T.current_states(spark, target).limit(0).write.parquet(f"{target}/version=7/left=false")
    assert [r.run_id for r in T.current_states(spark, target).collect()] == ["a"]


def corpus_rows(part):
    return [{"doc_id": 100 * part + k, "text": f"text {k % 7 if k % 2 else 10 * part + k}"} for k in range(20)]


def test_corpus_stream_touches_only_its_own_hashes(spark, tmp_path):
    """Rows are those of the batch-wise rule, over restarts; a batch updates as many states as it has hashes."""
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    stored, want, updated = set(), {}, []
    for part in range(4):
        rows = corpus_rows(part) + [{"doc_id": 1, "text": None}, {"doc_id": 900 - part, "text": "text 1"}]
        files(source, rows, f"d{part}")
        query = T.corpus_stream(spark, str(source), target, mark)
        query.awaitTermination()
        updated += [(p["stateOperators"][0]["numRowsUpdated"], len({r["text"] for r in rows} - {None})) for p in query.recentProgress if p["numInputRows"]]
        for row in sorted(rows, key=lambda r: r["doc_id"]):
            if row["text"] is not None and row["text"] not in stored:
                stored.add(row["text"])
                want[row["doc_id"]] = row["text"]
    assert {r.doc_id: r.text for r in spark.read.parquet(target).collect()} == want
    assert len(updated) == 4 and all(a == b for a, b in updated)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != T._ROCKS["spark.sql.streaming.stateStore.providerClass"]


def test_corpus_batch_reads_its_own_files_only(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    files(source, corpus_rows(0), "a")
    T.corpus_stream(spark, str(source), target, mark).awaitTermination()
    for old in source.glob("a-*.json"):  # earlier input and output are not needed any more
        old.write_text("")
    files(source, corpus_rows(1), "b")
    T.corpus_stream(spark, str(source), target, mark).awaitTermination()
    texts = [r.text for r in spark.read.parquet(target).collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] for p in (0, 1) for r in corpus_rows(p)})
