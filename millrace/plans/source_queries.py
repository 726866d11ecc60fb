"""Source and sink queries. Tables are written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import features as X
from millrace.operators import logs as L
from millrace.operators import retrieval as R
from millrace.operators import sinks as S
from millrace.operators import versions
from millrace.plans.corpus_queries import interaction_records
from millrace.plans.registry import query, table
from millrace.plans.run_queries import activity_lines, app_lines
from millrace.plans.retrieval_queries import sources
from millrace.session import scratch_path
from millrace.sources import documents as D
from millrace.sources import readers as R_
from millrace.operators import corpus as C


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderkey") % 2 == 0).alias("even"),
    )


_ORDERS = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS price, o_orderstatus AS status,
    strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 2 = 0 AS even FROM orders"""


@query("source_delimited", "SRC-1 SRC-2 SRC-3 SNK-2", _ORDERS)
def source_delimited(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    S.export_csv(_orders(spark, sf_dir), path)
    return R_.read_delimited(spark, path).frame


@query("source_semicolon", "SRC-2", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def source_semicolon(spark, sf_dir):
    path = scratch_path(spark, "customer-txt")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).option("sep", ";").csv(path)
    return R_.load(spark, path, ".txt").frame


@query(
    "source_json_document",
    "SRC-4",
    """SELECT n_name AS name, CAST(n_nationkey AS BIGINT) AS "key.id", r_name AS "key.region" FROM nation JOIN region ON r_regionkey = n_regionkey""",
)
def source_json_document(spark, sf_dir):
    """Nations as one JSON list; its size is that of the nation table."""
    path = scratch_path(spark, "nation-json")
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    record = F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_nationkey").alias("id"), F.col("r_name").alias("region")).alias("key"))
    nation.agg(F.to_json(F.collect_list(record)).alias("value")).write.text(path)
    return R_.load(spark, path, ".json").frame


@query("source_json_columns", "SRC-4", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'v1' AS version FROM nation")
def source_json_columns(spark, sf_dir):
    """Nations as one JSON object of columns."""
    path = scratch_path(spark, "nation-columns")
    pairs = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("p"))
    pairs.select(F.to_json(F.struct(F.col("p.n_nationkey").alias("id"), F.col("p.n_name").alias("name"), F.lit("v1").alias("version"))).alias("value")).write.text(path)
    return R_.load(spark, path, ".json").frame


@query(
    "source_json_lines",
    "SRC-5 SNK-3",
    """SELECT event_id, event_type, CAST(props->>'$.k' AS BIGINT) AS "props.k" FROM events""",
)
def source_json_lines(spark, sf_dir):
    path = scratch_path(spark, "events-jsonl")
    nested = table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k BIGINT").alias("props"))
    S.export_jsonl(nested, path)
    return R_.load(spark, path, ".jsonl").frame


@query("source_parquet", "SRC-6 SRC-7", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def source_parquet(spark, sf_dir):
    return R_.load(spark, f"{sf_dir}/lineitem.parquet").frame.where("l_quantity > 45").select("l_orderkey", "l_quantity")


@query(
    "source_parser_report",
    "SRC-8",
    "SELECT count(*) AS rows, 5 AS columns, 'csv' AS loader, ',' AS delimiter, 'utf-8' AS encoding, '' AS warnings FROM orders",
)
def source_parser_report(spark, sf_dir):
    path = scratch_path(spark, "report-csv")
    S.export_csv(_orders(spark, sf_dir), path)
    return R_.parser_report(R_.read_delimited(spark, path), ["o_orderkey"])


@query("source_markup", "SRC-9", r"""SELECT page_id, regexp_matches(lower(ltrim(substr(html, 1, 512))), '^(<!doctype html|<html|<\?xml)') AS is_markup FROM pages
    UNION ALL SELECT item_id, regexp_matches(lower(ltrim(substr(text, 1, 512))), '^(<!doctype html|<html|<\?xml)') FROM benchmark""")
def source_markup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", R_.is_markup(F.col("html")).alias("is_markup"))
    return pages.unionAll(table(spark, sf_dir, "benchmark").select("item_id", R_.is_markup(F.col("text"))))


@query(
    "source_json_tables",
    "SRC-10",
    """
    WITH e AS (SELECT event_id, event_type, CAST(props->>'$.k' AS BIGINT) AS k, event_id % 4 AS m FROM events)
    SELECT event_id, 'flat_object' AS shape, 0 AS "row", 'key' AS "column", 'k' AS value FROM e WHERE m = 0
    UNION ALL SELECT event_id, 'flat_object', 0, 'value', CAST(k AS VARCHAR) FROM e WHERE m = 0
    UNION ALL SELECT event_id, 'array_of_objects', i, 'a', CAST(k + i AS VARCHAR) FROM e, (VALUES (0), (1)) t(i) WHERE m = 1
    UNION ALL SELECT event_id, 'array_of_objects', 1, 'b', event_type FROM e WHERE m = 1
    UNION ALL SELECT event_id, 'columns_rows', 0, c, v FROM (SELECT event_id, m, unnest(['x', 'y']) AS c, unnest([CAST(k AS VARCHAR), '']) AS v FROM e) WHERE m = 2
    UNION ALL SELECT event_id, 'not_tabular', NULL, NULL, NULL FROM e WHERE m = 3
    """,
)
def source_json_tables(spark, sf_dir):
    m, k = F.col("event_id") % 4, F.get_json_object("props", "$.k")
    text = (
        F.when(m == 0, F.col("props"))
        .when(m == 1, F.format_string('[{"a": %s}, {"a": %s, "b": "%s"}]', k, (k.cast("bigint") + 1).cast("string"), "event_type"))
        .when(m == 2, F.format_string('{"columns": ["x", "y"], "rows": [[%s]]}', k)).otherwise("[1, 2]")
    )
    return D.json_tables(table(spark, sf_dir, "events").select("event_id", text.alias("j")), "event_id", "j")


@query(
    "source_run_ledger",
    "SRC-11",
    """SELECT 'run_' || s_suppkey AS run_id, 'completed' AS status, CAST(s_nationkey AS VARCHAR) AS model_id, 'done ' || s_name AS message FROM supplier""",
)
def source_run_ledger(spark, sf_dir):
    """Run documents of all suppliers and a broken one, one JSON text per line."""
    path = _ledger(spark, sf_dir)
    runs = D.read_run_ledger(spark, path, lines=True)
    return runs.select("run_id", "status", F.col("context")["model_id"].alias("model_id"), F.col("events")[0]["message"].alias("message"))


def _ledger(spark, sf_dir):
    path = scratch_path(spark, "ledger")
    doc = F.to_json(F.struct(
        F.concat(F.lit("run_"), F.col("s_suppkey").cast("string")).alias("run_id"), F.lit("completed").alias("status"),
        F.struct(F.col("s_nationkey").alias("model_id")).alias("context"), F.array(F.struct(F.concat(F.lit("done "), "s_name").alias("message"))).alias("events"),
    ))
    suppliers = table(spark, sf_dir, "supplier")
    suppliers.repartition(4).select(doc.alias("value")).write.text(path)
    suppliers.limit(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return path


@query(
    "source_ledger_counts",
    "SRC-11",
    """SELECT count(*) + 1 AS documents, count(*) AS runs, CAST(1 AS BIGINT) AS rejected FROM supplier""",
)
def source_ledger_counts(spark, sf_dir):
    return D.ledger_counts(spark, _ledger(spark, sf_dir), lines=True)


@query(
    "source_activity",
    "SRC-12",
    """SELECT event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM events WHERE event_id % 8 <> 0 ORDER BY ts DESC LIMIT 200""",
)
def source_activity(spark, sf_dir):
    path = scratch_path(spark, "activity")
    activity_lines(spark, sf_dir).select("value").write.text(path)
    return D.latest_activity(D.read_activity(spark, path), 200).select("event_type", "timestamp")


@query(
    "source_app_log",
    "SRC-13",
    """SELECT CASE WHEN event_id % 9 <> 0 THEN 'app.' || event_type ELSE '' END AS logger, CASE WHEN event_id % 9 <> 0 THEN 'INFO' ELSE '' END AS level, count(*) AS n FROM events GROUP BY 1, 2""",
)
def source_app_log(spark, sf_dir):
    path = scratch_path(spark, "app-log")
    app_lines(spark, sf_dir).select("value").write.text(path)
    entries = L.app_entries(D.read_log_lines(spark, path), F.col("source"))
    return entries.groupBy("logger", "level").agg(F.count(F.lit(1)).alias("n"))


def _net_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("kept", 1 - F.col("l_discount"))
    request = {"math_operations": [{"column": "l_extendedprice", "operator": "multiply", "right_column": "kept", "target": "net"}]}
    return X.apply_feature_operations(lines, request).frame.select("l_orderkey", "l_linenumber", "net", "l_returnflag")


@query(
    "sink_feature_view",
    "SNK-1 SRC-14",
    """SELECT 'net_lines' AS name, 'visual' AS mode, 'lineitem' AS source, count(*) AS rows, 3 AS columns, 'l_orderkey,l_linenumber,net' AS features,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem WHERE l_returnflag = 'R'""",
)
def sink_feature_view(spark, sf_dir):
    view = _net_lines(spark, sf_dir).where("l_returnflag = 'R'").drop("l_returnflag")
    row = S.materialise_view(view, "net_lines", scratch_path(spark, "view"), "visual", "lineitem")
    total = R_.load_registered(spark, row.first()["path"], "assistant_training_dataset").frame.agg(F.round(F.sum("net"), 2).alias("t")).scalar()
    made = F.col("history")[0]
    return row.select("name", made["mode"].alias("mode"), made["source_dataset_id"].alias("source"), F.col("shape")[0].alias("rows"),
                      F.col("shape")[1].cast("int").alias("columns"), F.array_join("features_list", ",").alias("features"), total.alias("total"))


@query(
    "sink_replaced_view",
    "SNK-1",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, CAST(2 AS BIGINT) AS version,
       (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS rows_before, (SELECT count(*) FROM lineitem) AS rows_now FROM lineitem GROUP BY 1""",
)
def sink_replaced_view(spark, sf_dir):
    """A view of returned lines, replaced by one of all lines; the rows before stay readable under their version."""
    root, lines = scratch_path(spark, "view"), _net_lines(spark, sf_dir)
    S.materialise_view(lines.where("l_returnflag = 'R'"), "net_lines", root)
    S.materialise_view(lines, "net_lines", root)
    rows = lambda v: versions.history(spark, root).where(F.col("version") == v).select("rows").scalar()
    newest = versions.history(spark, root).agg(F.max("version").alias("v")).scalar()
    return versions.read_version(spark, root).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("net"), 2).alias("net")).withColumns(
        {"version": newest, "rows_before": rows(1), "rows_now": rows(2)}
    )


@query(
    "sink_corpus_export",
    "SNK-3 SNK-4",
    """SELECT count(*) AS record_count, 16 AS feature_count, 'corpus' AS name, count(DISTINCT md5(text)) AS prompts FROM conversations
       WHERE conv_id % 17 <> 0 AND conv_id % 13 <> 0 AND role = 'user'""",
)
def sink_corpus_export(spark, sf_dir):
    rows = C.tabular_rows(interaction_records(spark, sf_dir))
    data, manifest = scratch_path(spark, "corpus"), scratch_path(spark, "manifest")
    S.export_jsonl(rows, data)
    S.write_manifest(rows, manifest, {"name": "corpus"})
    prompts = R_.read_json_lines(spark, data).frame.agg(F.count_distinct("source_hash").alias("n")).scalar()
    return spark.read.json(manifest).select("record_count", F.col("feature_count").cast("int").alias("feature_count"), "name", prompts.alias("prompts"))


@query(
    "sink_corpus_manifest",
    "SNK-4",
    """WITH k AS (SELECT conv_id FROM conversations WHERE conv_id % 17 <> 0 AND conv_id % 13 <> 0 AND role = 'user')
       SELECT count(*) AS record_count, CAST(16 AS BIGINT) AS feature_count, count(*) AS shape_rows, 16 AS listed, count(*) AS counted,
       count(DISTINCT conv_id) AS source_file_count, count(DISTINCT conv_id) AS stored_sources, 'assistant_training_dataset' AS dataset_type FROM k""",
)
def sink_corpus_manifest(spark, sf_dir):
    """The corpus with its manifest, each conversation being one source."""
    rows = C.tabular_rows(interaction_records(spark, sf_dir))
    kept = table(spark, sf_dir, "conversations").where("conv_id % 17 <> 0 AND conv_id % 13 <> 0 AND role = 'user'")
    listed = kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("record_count")).select(
        F.concat(F.lit("conversation://"), F.col("conv_id").cast("string")).alias("path"), F.lit("interaction").alias("source_type"), "record_count")
    path = scratch_path(spark, "manifest")
    S.write_manifest(rows, path, {"dataset_type": "assistant_training_dataset"}, listed, "source_type")
    stored = spark.read.json(f"{path}-sources").agg(F.count(F.lit(1)).alias("n")).scalar()
    return spark.read.schema("record_count bigint, feature_count bigint, shape array<bigint>, features_list array<string>, record_counts map<string,bigint>, "
                             "source_file_count bigint, dataset_type string").json(path).select(
        "record_count", "feature_count", F.col("shape")[0].alias("shape_rows"), F.size("features_list").alias("listed"),
        F.aggregate(F.map_values("record_counts"), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("counted"), "source_file_count",
        stored.alias("stored_sources"), "dataset_type")


@query("sink_vector_index", "SNK-5 VEC-4")
def sink_vector_index(spark, sf_dir):
    return S.write_index(R.build_index(sources(spark, sf_dir), 32), scratch_path(spark, "index"))
