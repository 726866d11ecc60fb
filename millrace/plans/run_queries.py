"""Run ledger and log queries. Events stand for run updates and, one by one, for run documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import logs as L
from millrace.operators import runs as U
from millrace.plans.registry import query, table

_KIND = "CASE event_id % 5 WHEN 0 THEN 'training' WHEN 1 THEN 'study' WHEN 2 THEN 'editor_execution' WHEN 3 THEN 'assistant_operation' ELSE 'smoke_test' END"
_STATE = "CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'cancel_requested' END"
# Facts of a run document that the queries below ask for.
_RUNS = f"""u AS (SELECT event_id, 'run_' || event_id AS run_id, {_KIND} AS run_type, {_STATE} AS status, ts, user_id, value,
    CAST(props->>'$.k' AS BIGINT) AS k, event_type = 'signup' AND event_id % 2 = 0 AS orphan FROM events)"""
_RERUN = """CASE WHEN k % 2 = 0 AND run_type = 'smoke_test' THEN 0 WHEN k % 2 = 0 AND run_type = 'editor_execution' AND k % 4 <> 0 THEN 1
    WHEN k % 2 = 0 AND run_type = 'assistant_operation' AND k % 4 <> 0 THEN 2 WHEN k % 2 = 0 THEN 3
    WHEN run_type = 'training' AND k % 3 <> 0 THEN 4 ELSE 6 END"""


def _runs(spark, sf_dir):
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    pairs = lambda **items: F.map_from_entries(F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(n).alias("key"), v.cast("string").alias("value"))) for n, v in items.items()
    ])))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), e.cast("string")).alias("run_id"), F.expr(_KIND).alias("run_type"), F.expr(_STATE).alias("status"), F.lit("step").alias("stage"),
        (F.col("ts") - F.expr("INTERVAL 1 HOUR")).alias("created_at"), F.when(e % 3 != 0, F.col("ts")).alias("updated_at"), F.col("ts").alias("completed_at"),
        pairs(model_id=F.col("user_id"), dataset_id=F.when(k % 3 != 0, k), operation=F.when(k % 7 == 0, F.lit("re_index")), prefer_gpu=F.when(k % 11 == 0, F.lit("true"))).alias("context"),
        pairs(lr=F.lit("0.1"), device=F.when(k % 5 == 0, F.lit('{"trainer": {"gpu_name": "none", "accelerator": "CUDA:0"}}'))).alias("parameters"),
        pairs(stdout=F.when(e % 2 == 0, F.lit("hello\nworld\n")), stderr=F.when(e % 4 == 0, F.lit("warn")), log=F.when(k % 13 == 0, F.lit("cpu"))).alias("result"),
        pairs(queue=F.when(k % 6 == 0, F.lit("lane-GPU-1")).when(k % 6 == 1, F.lit("cpu")), reason=F.when(e % 2 == 0, F.lit("job_not_found"))).alias("queue"),
        pairs(code=F.when((k % 2 == 0) & (k % 4 == 0), F.lit("x = 1")), operation=F.when((k % 2 == 0) & (k % 4 == 0), F.lit("o")), seed=F.when(k % 2 == 0, F.lit("1"))).alias("rerun_payload"),
        pairs(traceback=F.when(F.col("event_type") == "error", F.lit("tb")), message=F.when(F.col("event_type") == "error", F.lit("Boom"))).alias("failure"),
        pairs(plot=F.lit("a.png"), model=F.lit("m.bin")).alias("artifacts"),
        F.when(F.col("event_type") == "error", "failed at\nstep").alias("error"), F.lit("").alias("latest_event"),
        F.array(F.struct(F.col("ts").cast("string").alias("timestamp"), F.lit("step").alias("stage"), F.lit("created").alias("message"))).alias("events"),
        F.array(F.struct(F.col("ts").cast("string").alias("timestamp"), F.lit("step").alias("stage"), F.when(e % 5 == 0, "moved").alias("message"))).alias("timeline"),
        F.array(F.lit("one")).alias("terminal_lines"),
    )


@query(
    "run_list",
    "RUN-1",
    f"""WITH {_RUNS} SELECT run_id, status FROM u WHERE run_type = 'training' AND status IN ('queued', 'running') AND user_id <= 50 AND user_id = 8
        ORDER BY CASE WHEN event_id % 3 <> 0 THEN ts ELSE ts - INTERVAL 1 HOUR END DESC, run_id DESC LIMIT 15""",
)
def run_list(spark, sf_dir):
    return U.list_runs(_runs(spark, sf_dir), run_type="training", statuses=["queued", "running", "completed"], active_only=True, model_id=8, limit=15).select("run_id", "status")


@query(
    "run_summary",
    "RUN-2",
    f"""WITH {_RUNS} SELECT run_id, 1 AS event_count, 1 AS line_count, CAST(CAST(k % 13 = 0 AS INT) + CAST(event_id % 4 = 0 AS INT) + CAST(event_id % 2 = 0 AS INT) AS INTEGER) AS result_key_count,
        concat_ws(',', CASE WHEN k % 13 = 0 THEN 'log' END, CASE WHEN event_id % 4 = 0 THEN 'stderr' END, CASE WHEN event_id % 2 = 0 THEN 'stdout' END) AS result_keys,
        'model,plot' AS artifact_keys, status = 'failed' AS has_failure_traceback, CASE WHEN status = 'failed' THEN 'message' ELSE '' END AS failure_keys FROM u""",
)
def run_summary(spark, sf_dir):
    made = U.summarise_runs(_runs(spark, sf_dir))
    return made.select("run_id", "event_count", "line_count", "result_key_count", F.array_join("result_keys", ",").alias("result_keys"),
                       F.array_join("artifact_keys", ",").alias("artifact_keys"), "has_failure_traceback", F.array_join(F.map_keys("failure"), ",").alias("failure_keys"))


def updates(spark, sf_dir):
    """Events as updates of the run of their user."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), e.alias("seq"), "ts", F.when(e % 3 != 0, F.expr(_STATE)).alias("status"),
        F.when(e % 4 == 0, F.col("event_type")).alias("stage"), F.when(e % 2 == 0, F.concat(F.lit("event "), e.cast("string"))).alias("message"),
        F.from_json("props", "map<string,string>").alias("metrics"),
    )


_UPDATES = f"""w AS (SELECT 'run_' || user_id AS run_id, event_id AS seq, ts, CASE WHEN event_id % 3 <> 0 THEN {_STATE} END AS status,
    CASE WHEN event_id % 4 = 0 THEN event_type END AS stage, CASE WHEN event_id % 2 = 0 THEN 'event ' || event_id END AS message, props->>'$.k' AS k FROM events)"""


@query(
    "run_state_fold",
    "RUN-3",
    f"""WITH {_UPDATES} SELECT run_id, arg_max(status, (ts, seq)) FILTER (WHERE status IS NOT NULL) AS status, arg_max(stage, (ts, seq)) FILTER (WHERE stage IS NOT NULL) AS stage,
        min(ts) AS created_at, max(ts) AS updated_at, min(ts) FILTER (WHERE status = 'running') AS started_at,
        max(ts) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS completed_at, arg_max(message, (ts, seq)) FILTER (WHERE message IS NOT NULL) AS latest_event,
        count(message) AS event_count, count(*) FILTER (WHERE message IS NOT NULL OR status IS NOT NULL OR stage IS NOT NULL) AS timeline_count FROM w GROUP BY run_id""",
)
def run_state_fold(spark, sf_dir):
    return U.fold_state(updates(spark, sf_dir))


@query(
    "run_map_fold",
    "RUN-3",
    f"WITH {_UPDATES} SELECT run_id, 'k' AS key, arg_max(k, (ts, seq)) AS value FROM w GROUP BY run_id",
)
def run_map_fold(spark, sf_dir):
    return U.fold_maps(updates(spark, sf_dir), "metrics")


_DOC_LINES = r"""m AS (SELECT source AS run_id, doc_id AS seq, unnest(string_split(regexp_replace(text, '(\r\n|\n|\r)$', ''), chr(10))) AS message,
      generate_subscripts(string_split(regexp_replace(text, '(\r\n|\n|\r)$', ''), chr(10)), 1) AS part FROM documents WHERE text <> ''),
    l AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq, part) - 1 AS index, message, count(*) OVER (PARTITION BY run_id) AS n FROM m)"""


def _terminal(spark, sf_dir):
    text = table(spark, sf_dir, "documents").select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit("stdout").alias("stream"),
        F.lit("").alias("stage"), F.col("text").alias("message"),
    )
    return U.terminal_lines(text)


@query("run_terminal_lines", "RUN-4", f"WITH {_DOC_LINES} SELECT run_id, index, md5(message) AS line_md5 FROM l")
def run_terminal_lines(spark, sf_dir):
    """Lines of all documents of a source as the terminal output of one run."""
    return _terminal(spark, sf_dir).select("run_id", "index", F.md5("message").alias("line_md5"))


@query(
    "run_terminal_synthesis",
    "RUN-5",
    f"""WITH {_RUNS}, p AS (
      SELECT run_id, 1 AS o, 'system' AS stream, 'created' AS message FROM u UNION ALL SELECT run_id, 2, 'system', 'moved' FROM u WHERE event_id % 5 = 0
      UNION ALL SELECT run_id, 3, 'stdout', 'hello' FROM u WHERE event_id % 2 = 0 UNION ALL SELECT run_id, 4, 'stdout', 'world' FROM u WHERE event_id % 2 = 0
      UNION ALL SELECT run_id, 5, 'stderr', 'warn' FROM u WHERE event_id % 4 = 0
      UNION ALL SELECT run_id, 6, 'stderr', 'failed at' FROM u WHERE status = 'failed' UNION ALL SELECT run_id, 7, 'stderr', 'step' FROM u WHERE status = 'failed')
    SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY o) - 1 AS INTEGER) AS index, stream, message FROM p""",
)
def run_terminal_synthesis(spark, sf_dir):
    return U.synthesised_lines(_runs(spark, sf_dir)).select("run_id", "index", "stream", "message")


@query(
    "run_terminal_cursor",
    "RUN-6",
    f"""WITH {_DOC_LINES} SELECT index, next_cursor, md5(message) AS line_md5 FROM (SELECT *, (SELECT max(index) + 1 FROM l WHERE run_id = 'src1') AS next_cursor FROM l
        WHERE run_id = 'src1' AND index >= 100) ORDER BY index DESC LIMIT 300""",
)
def run_terminal_cursor(spark, sf_dir):
    found = U.read_terminal(_terminal(spark, sf_dir), "src1", cursor=100)
    return found.select("index", "next_cursor", F.md5("message").alias("line_md5"))


@query(
    "run_effective_status",
    "RUN-7",
    f"""WITH {_RUNS} SELECT run_id, CASE WHEN orphan THEN 'cancelled' ELSE status END AS effective_status,
        status IN ('queued', 'running', 'cancel_requested') AND NOT orphan AS active FROM u""",
)
def run_effective_status(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", U.effective_status().alias("effective_status"), U.is_active().alias("active"))


_TARGET = """CASE WHEN k % 6 = 0 THEN 'gpu|queue:lane-gpu-1' WHEN k % 6 = 1 THEN 'cpu|queue:cpu' WHEN k % 5 = 0 THEN 'gpu|parameters:device'
    WHEN k % 13 = 0 THEN 'cpu|result:device' WHEN k % 11 = 0 THEN 'gpu|context:gpu' ELSE 'cpu|default:cpu' END"""


@query("run_compute_target", "RUN-8", f"WITH {_RUNS} SELECT run_id, split_part({_TARGET}, '|', 1) AS compute_target, split_part({_TARGET}, '|', 2) AS compute_reason FROM u")
def run_compute_target(spark, sf_dir):
    return U.compute_target(_runs(spark, sf_dir)).select("run_id", "compute_target", "compute_reason")


@query(
    "run_actions",
    "RUN-9",
    f"""WITH {_RUNS}, c AS (SELECT *, {_RERUN} AS r, status IN ('queued', 'running', 'cancel_requested') AND NOT orphan AS active FROM u)
    SELECT run_id, active AND status IN ('queued', 'running') AS can_pause, false AS can_resume, active OR orphan AS can_cancel, NOT active AND r IN (3, 4) AS can_rerun,
      CASE WHEN orphan THEN 'The original RQ job is missing; rerun will create a fresh job.' ELSE ['This run type does not support re-run.', 'Editor rerun payload is missing code.',
       'Assistant rerun payload is missing operation.', 'Payload-backed rerun is available.', 'Training context can be reconstructed.', '',
       'This historical run does not include enough payload to re-run.'][r + 1] END AS rerun_reason FROM c""",
)
def run_actions(spark, sf_dir):
    return U.action_flags(_runs(spark, sf_dir)).select("run_id", "can_pause", "can_resume", "can_cancel", "can_rerun", "rerun_reason")


_TITLE = "concat_ws(' - ', replace(run_type, '_', ' '), CASE WHEN k % 7 = 0 THEN 're index' END, 'model ' || user_id, CASE WHEN k % 3 <> 0 THEN 'dataset ' || k END)"


@query("run_titles", "RUN-10", f"WITH {_RUNS} SELECT run_id, {_TITLE} AS title FROM u")
def run_titles(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", U.run_title().alias("title"))


@query("run_search", "RUN-11", f"WITH {_RUNS} SELECT run_id FROM u WHERE contains(lower(concat_ws(' ', run_id, run_type, {_TITLE}, status)), 'index - model 1')")
def run_search(spark, sf_dir):
    shown = U.compute_target(_runs(spark, sf_dir)).withColumns({"title": U.run_title(), "effective_status": U.effective_status(), "status_reason": F.lit("")})
    return shown.where(U.matches_query("Index - MODEL 1")).select("run_id")


@query(
    "run_merge_groups",
    "RUN-12",
    f"""WITH {_RUNS} SELECT run_id, CASE WHEN status = 'failed' THEN 'second' ELSE 'first' END AS grp FROM u WHERE status IN ('running', 'failed')""",
)
def run_merge_groups(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    first = runs.where("status IN ('running', 'failed')").withColumn("grp", F.lit("first"))
    second = runs.where("status = 'failed'").withColumn("grp", F.lit("second"))
    return U.merge_groups([first, second]).select("run_id", "grp")


@query(
    "run_counts",
    "RUN-13",
    f"""WITH {_RUNS}, c AS (SELECT *, split_part({_TARGET}, '|', 1) AS t FROM u) SELECT count(*) AS run_count,
        count(*) FILTER (WHERE status IN ('queued', 'running', 'cancel_requested') AND NOT orphan) AS active_runs, count(*) FILTER (WHERE status = 'failed') AS recent_failures,
        count(*) FILTER (WHERE t = 'cpu') AS cpu_runs, count(*) FILTER (WHERE t = 'gpu') AS gpu_runs FROM c""",
)
def run_counts(spark, sf_dir):
    return U.run_counts(_runs(spark, sf_dir))


@query(
    "run_experiments",
    "RUN-14",
    """SELECT CAST(user_id AS VARCHAR) AS experiment_id, epoch_us(max(ts)) AS last_update_time, epoch_us(min(ts)) AS creation_time FROM events GROUP BY user_id
       ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50""",
)
def run_experiments(spark, sf_dir):
    stamp = F.unix_micros(F.col("ts").cast("timestamp"))
    made = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("experiment_id")).agg(
        F.max(stamp).alias("last_update_time"), F.min(stamp).alias("creation_time")
    )
    return U.list_experiments(made)


@query(
    "run_experiment_page",
    "RUN-14",
    """SELECT event_id AS run_id, ts AS start_time, (SELECT count(*) FROM events WHERE user_id = 8) > 30 AS has_more FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id LIMIT 20 OFFSET 10""",
)
def run_experiment_page(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.col("ts").alias("start_time"), F.col("user_id").cast("string").alias("experiment_id"))
    return U.experiment_page(runs, "8", 20, 10).select("run_id", "start_time", "has_more")


@query(
    "run_parameter_conflicts",
    "RUN-15",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS run_id, CASE WHEN l_linenumber = 7 THEN 'new' WHEN l_linenumber = 6 THEN 'conflict' ELSE 'same' END AS outcome,
       count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) GROUP BY 1, 2""",
)
def run_parameter_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct().select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("run_id"), F.concat(F.lit("q"), F.col("l_quantity")).alias("key"), "l_linenumber", F.col("l_quantity").alias("q")
    )
    existing = rows.where("l_linenumber <> 7").select("run_id", "key", F.col("q").cast("int").cast("string").alias("value"))
    shifted = F.when(F.col("l_linenumber") == 6, F.col("q") + 0.5).otherwise(F.col("q"))
    incoming = rows.select("run_id", "key", F.concat(F.lit(" "), shifted.cast("string")).alias("value"))
    return U.parameter_conflicts(existing, incoming).groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "run_artifacts",
    "RUN-16",
    """WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'train_' || p_partkey || '_7_x/loss.png' WHEN 1 THEN 'retrain_' || p_partkey || '/a/b.SVG'
        WHEN 2 THEN 'smoke_test_1/c.jpeg' ELSE 'job' || p_partkey || '/notes.txt' END AS path FROM part)
    SELECT path, substr(sha1(path), 1, 16) AS artifact_id, CASE k % 4 WHEN 0 THEN 'training' WHEN 1 THEN 'retraining' ELSE 'smoke_test' END AS domain,
      split_part(path, '/', 1) AS job_id, CASE WHEN k % 4 < 2 THEN k END AS model_id, CASE WHEN k % 4 = 0 THEN CAST(7 AS BIGINT) END AS dataset_id FROM p WHERE k % 4 <> 3""",
)
def run_artifacts(spark, sf_dir):
    p, k = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    path = (
        F.when(p == 0, F.concat(F.lit("train_"), k, F.lit("_7_x/loss.png"))).when(p == 1, F.concat(F.lit("retrain_"), k, F.lit("/a/b.SVG")))
        .when(p == 2, F.lit("smoke_test_1/c.jpeg")).otherwise(F.concat(F.lit("job"), k, F.lit("/notes.txt")))
    )
    return U.artifact_index(table(spark, sf_dir, "part").select(path.alias("path")), "path")


_APP = r"""a AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'trace of token=t' || event_id ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | app.' || event_type || ' | INFO | got https://u:p@h/x?api_key=k'
        || event_id || '&v=1 with password: "p' || event_id || '", Bearer abc.' || event_id END AS line, date_trunc('second', ts) AS t, event_type FROM events)"""
_APP_CLEAN = """CASE WHEN event_id % 9 = 0 THEN 'trace of token=[REDACTED]' ELSE 'got https://[REDACTED]@h/x?api_key=[REDACTED] with password: [REDACTED], Bearer [REDACTED]' END"""


def app_lines(spark, sf_dir):
    k = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("trace of token=t"), k)).otherwise(F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" | app."), F.col("event_type"), F.lit(" | INFO | got https://u:p@h/x?api_key=k"), k,
        F.lit('&v=1 with password: "p'), k, F.lit('", Bearer abc.'), k,
    ))
    return table(spark, sf_dir, "events").select(line.alias("value"), F.col("event_id").alias("offset"))


@query(
    "log_redaction",
    "TXT-6 SRC-13",
    rf"""WITH {_APP} SELECT event_id AS "offset", CASE WHEN event_id % 9 <> 0 THEN strftime(t, '%Y-%m-%d %H:%M:%S') END AS timestamp,
        CASE WHEN event_id % 9 <> 0 THEN 'INFO' ELSE '' END AS level, CASE WHEN event_id % 9 <> 0 THEN 'app.' || event_type ELSE '' END AS logger,
        {_APP_CLEAN} AS message FROM a""",
)
def log_redaction(spark, sf_dir):
    made = L.app_entries(app_lines(spark, sf_dir), F.lit("app"))
    return made.select("offset", "timestamp", "level", "logger", "message")


def activity_lines(spark, sf_dir):
    k = F.col("event_id")
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), "event_type", F.when(k % 2 == 0, F.concat(F.lit("did "), k.cast("string"))).alias("message")))
    return table(spark, sf_dir, "events").select(F.when(k % 8 == 0, F.lit("{broken")).otherwise(line).alias("value"), k.alias("offset"))


@query(
    "log_snapshot",
    "LOG-1",
    rf"""WITH {_APP}, e AS (SELECT 'app' AS source, event_id AS o, CASE WHEN event_id % 9 <> 0 THEN t END AS t, {_APP_CLEAN} AS message FROM a
      UNION ALL SELECT 'activity', event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'did ' || event_id ELSE event_type END FROM events WHERE event_id % 8 <> 0),
    x AS (SELECT * FROM e ORDER BY t DESC NULLS LAST, source DESC, o DESC LIMIT 200)
    SELECT source || ':' || row_number() OVER (ORDER BY t ASC NULLS FIRST, source, o) AS id, o AS "offset", message FROM x""",
)
def log_snapshot(spark, sf_dir):
    entries = [L.app_entries(app_lines(spark, sf_dir), F.lit("app"), redact=False), L.activity_entries(activity_lines(spark, sf_dir), F.lit("activity"), redact=False)]
    return L.snapshot(entries, 200).select("id", "offset", "message")


@query(
    "log_container_lines",
    "LOG-2",
    r"""SELECT event_id AS "offset", CASE WHEN event_id % 3 = 0 THEN 'Container' ELSE 'web-' || user_id END AS source,
        CASE WHEN event_id % 3 = 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') END AS timestamp, 'event ' || event_type AS message FROM events""",
)
def log_container_lines(spark, sf_dir):
    k, body = F.col("event_id") % 3, F.concat(F.lit("event "), "event_type")
    prefix = F.concat(F.lit("web-"), F.col("user_id").cast("string"), F.lit("  | "))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z' ")
    line = F.when(k == 0, body).when(k == 1, F.concat(prefix, stamp, body)).otherwise(F.concat(prefix, body))
    lines = table(spark, sf_dir, "events").select(line.alias("value"), F.col("event_id").alias("offset"))
    return L.container_entries(lines).select("offset", "source", "timestamp", "message")
