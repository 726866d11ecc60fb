from __future__ import annotations

import hashlib
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import corpus as C
from millrace.operators import profile as P
from millrace.operators import registry as G
from millrace.operators import retrieval as R
from millrace.operators import runs as U
from millrace.operators import whatif as W
from millrace.sources import documents as S
from millrace.sources import readers


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


def test_redaction(spark):
    assert one(spark, "API_KEY = 'abc', ok", X.redact) == "API_KEY=[REDACTED]', ok"
    assert one(spark, "use Bearer abc.def now", X.redact) == "use secret=[REDACTED] now"
    line = 'GET http://u:p@h/x?token=t1&b=2 Authorization: Bearer abc {"password": "p"}'
    clean = one(spark, line, X.redact_log)
    assert "u:p" not in clean and "t1" not in clean and "abc" not in clean and '"p"' not in clean and "b=2" not in clean.replace("&b=2", "")
    assert one(spark, None, X.redact_log) == ""


def test_squeeze_and_summary(spark):
    assert one(spark, "  a \t  b\r\n c ", X.squeeze) == "a b c"
    assert one(spark, "   ", X.summarise) == X.EMPTY_SUMMARY
    long = one(spark, "word " * 200, X.summarise)
    assert len(long) <= 420 and long.endswith("...")
    assert one(spark, "A b. C d? C d? E. F.", X.excerpts) == ["A b.", "C d?", "E."]


def test_nested_redaction(spark):
    raw = json.dumps({"a": {"Secret_Key": [1, 2]}, "l": ["password=x", {"n": 1}]})
    got = json.loads(spark.createDataFrame([(raw,)], "j string").select(C.redact_json(F.col("j"))).first()[0])
    assert got == {"a": {"Secret_Key": "[REDACTED]"}, "l": ["password=[REDACTED]", {"n": 1}]}


def test_hashed_embedding_against_plain_python(spark):
    texts = {1: "Hello, hello wörld 42", 2: "", 3: "tail."}

    def plain(text, size=64):
        vector = [0.0] * size
        for token in re.findall(r"[^\W_]+", text.lower()) or ["empty"]:
            digest = hashlib.sha256(token.encode()).digest()
            vector[int.from_bytes(digest[:4], "big") % size] += (1 if digest[4] % 2 == 0 else -1) * (1 + math.log1p(len(token)))
        norm = math.sqrt(sum(x * x for x in vector)) or 1.0
        return [x / norm for x in vector]

    df = spark.createDataFrame(list(texts.items()), "id int, t string")
    got = {r["id"]: r["embedding"] for r in R.hashed_embeddings(df, "id", "t", 64).collect()}
    assert all(max(abs(a - b) for a, b in zip(got[k], plain(v))) < 1e-12 for k, v in texts.items())


def test_triplets_wrap_around(spark):
    docs = spark.createDataFrame([(i, f"d{i}") for i in range(4)], "doc_id long, text string")
    asks = spark.createDataFrame([(i, "q", "unsafe" if i == 1 else None) for i in range(6)], "query_id long, query string, label string")
    got = {r["query_id"]: (r["positive_id"], r["negative_id"], r["label"]) for r in R.triplets(asks, "query_id", docs, "doc_id").collect()}
    assert got[0] == (0, 2, "positive") and got[1] == (1, 3, "negative") and got[5] == (1, 3, "positive")


def test_sync_skips(spark):
    files = spark.createDataFrame([("a", "one"), ("b", "one "), ("c", " "), ("d", "x" * 50), ("e", "old")], "path string, text string")
    stored = spark.createDataFrame([(hashlib.sha256(b"old").hexdigest(),)], "content_hash string")
    got = {r["path"]: r["outcome"] for r in C.sync_references(files, "path", "text", stored, max_bytes=40).collect()}
    assert got == {"a": "created", "b": "duplicate_hash", "c": "empty", "d": "too_large", "e": "duplicate_hash"}


def test_delimited_files(spark, tmp_path):
    (tmp_path / "n.tsv").write_text("feature_a\tfeature_b\ttarget\n1\tx\t0\n2\ty\t1\n\t NA\t1\n", encoding="utf-8")
    loaded = readers.load(spark, str(tmp_path / "n.tsv"))
    assert loaded.delimiter == "\t" and loaded.frame.dtypes == [("feature_a", "bigint"), ("feature_b", "string"), ("target", "bigint")]
    assert loaded.frame.where("feature_a IS NULL AND feature_b IS NULL").count() == 1
    (tmp_path / "p.txt").write_bytes("name|x\ncafé €|1.5\n".encode("cp1252"))
    loaded = readers.load(spark, str(tmp_path / "p.txt"))
    assert (loaded.delimiter, loaded.encoding) == ("|", "cp1252") and loaded.frame.first()["name"] == "café €"
    (tmp_path / "b.csv").write_bytes("﻿a,b\n1,true\n".encode("utf-8"))
    loaded = readers.load(spark, str(tmp_path / "b.csv"))
    assert loaded.encoding == "utf-8" and loaded.frame.dtypes == [("a", "bigint"), ("b", "boolean")]
    with pytest.raises(ValueError, match="Supported"):
        readers.load(spark, "table.xlsx")


def test_json_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"a": 1, "b": {"c": "x"}}, {"a": 2}]')
    assert readers.load(spark, str(tmp_path / "r.json")).frame.columns == ["a", "b.c"]
    (tmp_path / "c.json").write_text('{"a": [1, 2], "b": ["x", "y"]}')
    assert sorted(tuple(r) for r in readers.load(spark, str(tmp_path / "c.json")).frame.collect()) == [(1, "x"), (2, "y")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.load(spark, str(tmp_path / "l.jsonl")).frame.count() == 2
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnope\n')
    with pytest.raises(Exception):
        readers.load(spark, str(tmp_path / "bad.jsonl")).frame.collect()


def test_run_ledger_folder(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"run_{i}.json").write_text(json.dumps({
            "run_id": f"run_{i}", "status": "failed", "context": {"model_id": i}, "result": {"stdout": "hello\nworld", "stderr": "warn"},
            "events": [{"status": "queued", "stage": "s", "timestamp": "t", "message": "created"}], "error": None}, indent=1))
    (tmp_path / "broken.json").write_text("{")
    runs = S.read_run_ledger(spark, str(tmp_path))
    assert runs.count() == 2
    flat = runs.withColumns({"timeline": F.col("progress.timeline"), "rerun_payload": F.create_map().cast("map<string,string>")})
    assert [r["run_id"] for r in U.list_runs(flat, statuses=["failed"], model_id=1).collect()] == ["run_1"]
    lines = U.synthesised_lines(flat).where("run_id = 'run_0'").orderBy("index").collect()
    assert [r["message"] for r in lines] == ["created", "hello", "world", "warn"]


def test_terminal_cap(spark):
    text = "\n".join(f"line {i}" for i in range(2105))
    rows = spark.createDataFrame([("r", 0, "first\r\nsecond\n"), ("r", 1, text)], "run_id string, seq long, message string")
    rows = rows.withColumns({"ts": F.lit(None).cast("timestamp"), "stream": F.lit("system"), "stage": F.lit("")})
    assert U.terminal_lines(rows).count() == 2107
    kept = U.terminal_lines(rows, 2000).orderBy("index").collect()
    assert len(kept) == 2000 and kept[0]["index"] == 107 and kept[-1]["message"] == "line 2104"
    tail = U.read_terminal(U.terminal_lines(rows, 2000), "r", cursor=2100).collect()
    assert len(tail) == 7 and tail[0]["next_cursor"] == 2107


def test_nested_device_and_flags(spark):
    base = {"run_id": "r", "run_type": "training", "status": "cancel_requested", "queue": {"reason": "job_not_found"}, "context": {"prefer_gpu": "False"},
            "parameters": {"note": 'say "cpu"', "deep": '{"gpu": "none", "device": "cuda:1"}'}, "result": {}, "rerun_payload": {}, "failure": {}}
    kinds = "run_id string, run_type string, status string, queue map<string,string>, context map<string,string>, parameters map<string,string>, result map<string,string>, rerun_payload map<string,string>, failure map<string,string>"
    df = spark.createDataFrame([tuple(base.values())], kinds)
    row = U.action_flags(U.compute_target(df)).withColumn("effective", U.effective_status()).first()
    assert (row["compute_target"], row["compute_reason"]) == ("gpu", "parameters:device")
    assert row["effective"] == "cancelled" and row["can_cancel"] and not row["can_pause"]


def test_type_and_container_repair(spark):
    df = spark.createDataFrame([(" CSV", '"[1]"'), ("dataset", "[1]"), ("odd", None)], "dataset_type string, history string")
    got = [(r["dataset_type"], r["repaired"]) for r in G.repair_types(df, "dataset_type").collect()]
    assert got == [("dataset", True), ("dataset", False), ("odd", False)]
    assert [(r["history"], r["repaired"]) for r in G.repair_containers(df, {"history": "["}).collect()] == [("[1]", 1), ("[1]", 0), (None, 0)]


def test_profile_of_odd_tables(spark):
    df = spark.createDataFrame([(1, float("nan"), ["a"]), (2, float("inf"), ["b"]), (3, None, ["a"])], "id long, x double, tags array<string>")
    got = {r["column"]: r for r in P.column_explorer(df, ["id"]).collect()}
    assert got["x"]["null_count"] == 3 and got["x"]["std"] is None and got["tags"]["unique_count"] == 2 and got["tags"]["mode"] == '["a"]'
    single = P.column_explorer(spark.createDataFrame([(1.0,)], "x double"), ["x"]).first()
    assert single["std"] is None and single["mean"] == 1.0
    assert P.column_explorer(df.where("id > 9"), ["id"]).count() == 3
    a, b = P.table_fingerprint(df).first(), P.table_fingerprint(df.repartition(3)).first()
    assert a == b


def test_scenarios(spark):
    with pytest.raises(ValueError, match="Unknown feature"):
        W.normalise_scenarios({"scenarios": [{"overrides": {"nope": 1}}]}, ["a"])
    made = W.normalise_scenarios({"scenario": {"a": 2}, "steps": "500"}, ["a"])
    assert made[0].steps == 500 and made[0].overrides == {"a": 2}
    assert W.normalise_scenarios({"steps": 500}, ["a"], max_steps=120)[0].steps == 120
    df = spark.createDataFrame([(1, 10.0, "t")], "id int, a double, t string")
    grid = W.step_grid(df, ["a", "t"], [W.Scenario("s", steps=2, amplitude=0.5, trend="down")]).orderBy("step").collect()
    assert [(r["a"], r["t"]) for r in grid] == [(7.5, "t"), (5.0, "t")]


def test_every_format_has_a_row_of_uses(spark):
    from millrace.sources import readers as R_

    rows = R_.capability_matrix(spark).collect()
    assert {r["extension"] for r in rows} == set(R_.FORMATS) and all(r["train"] and r["monitor"] for r in rows)


def test_ledger_of_one_document_a_file(spark, tmp_path):
    from millrace.sources import documents as D

    texts = ['{\n "run_id": "a",\n "status": "running", "context": {"model_id": 4}\n}', '{"run_id": "b"}', '{"run_id": ', "[1]", '{"status": "lost"}']
    for i, text in enumerate(texts):
        (tmp_path / f"{i}.json").write_text(text)
    got = {r["run_id"]: r for r in D.read_run_ledger(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and got["a"]["context"] == {"model_id": "4"}
    counts = D.ledger_counts(spark, str(tmp_path)).first()
    assert (counts["runs"], counts["documents"] - counts["rejected"]) == (2, 2) and counts["rejected"] == 3
