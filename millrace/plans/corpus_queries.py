"""Corpus curation queries over documents, labels, conversations, events and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import corpus as C
from millrace.plans.registry import query, table

_PAIR = r"(?i)(api[_-]?key|authorization|bearer|password|secret|token)\s*[:=]\s*[''\"]?[^''\"\s,;]+"
_REDACT = r"regexp_replace(regexp_replace({0}, '" + _PAIR + r"', '\1=[REDACTED]', 'g'), '(?i)bearer\s+[a-z0-9._\-]+', 'secret=[REDACTED]', 'g')"
_FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CLEAN = _FLAT.format(_REDACT.format("text"))


def _summary(flat: str, limit: int = 420) -> str:
    return f"CASE WHEN {flat} = '' THEN 'Reference metadata without raw text.' WHEN length({flat}) > {limit} THEN rtrim(substr({flat}, 1, {limit - 3})) || '...' ELSE {flat} END"


@query(
    "corpus_normalise_summary",
    "TXT-1 TXT-2",
    f"""WITH a AS (SELECT doc_id, {_FLAT.format('text')} AS flat FROM documents)
    SELECT doc_id, CAST(length(flat) AS INTEGER) AS flat_length, {_summary('flat')} AS summary FROM a""",
)
def corpus_normalise_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.length(X.squeeze(F.col("text"))).alias("flat_length"), X.summarise(F.col("text")).alias("summary"))


@query(
    "corpus_excerpts",
    "TXT-3",
    f"""WITH a AS (SELECT doc_id, {_CLEAN} AS flat FROM documents),
    b AS (SELECT doc_id, unnest(string_split(regexp_replace(flat, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s,
                 generate_subscripts(string_split(regexp_replace(flat, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS i FROM a WHERE flat <> ''),
    c AS (SELECT doc_id, min(i) AS i, e FROM (SELECT doc_id, i, {_summary('s', 260)} AS e FROM b WHERE s <> '') GROUP BY doc_id, e),
    d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place FROM c)
    SELECT doc_id, CAST(place AS INTEGER) AS place, e AS excerpt FROM d WHERE place <= 3""",
)
def corpus_excerpts(spark, sf_dir):
    built = C.build_references(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return built.select("doc_id", F.posexplode("excerpts").alias("place", "excerpt")).withColumn("place", F.col("place") + 1)


@query("corpus_redact_text", "TXT-4", f"SELECT doc_id, md5({_REDACT.format('text')}) AS redacted_md5, {_REDACT.format('text')} <> text AS changed FROM documents")
def corpus_redact_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", X.redact(F.col("text")).alias("r"))
    return docs.select("doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("text")).alias("changed"))


@query(
    "corpus_redact_nested",
    "TXT-5",
    """SELECT event_id, '[REDACTED]' AS api_key, '[REDACTED]' AS deep_secret, event_type AS kept, 'token=[REDACTED] end' AS note,
       CAST(props->>'$.k' AS BIGINT) AS k FROM events""",
)
def corpus_redact_nested(spark, sf_dir):
    """Free-form JSON built around the event properties, secrets at two depths and in text."""
    raw = F.to_json(F.struct(
        F.concat(F.lit("sk-"), "user_id").alias("api_key"), F.from_json("props", "k BIGINT").alias("props"),
        F.struct(F.lit("x").alias("clientSecret"), F.col("event_type").alias("kept")).alias("inner"),
        F.array(F.concat(F.lit("token: t"), "event_id", F.lit(" end"))).alias("notes"),
    ))
    clean = table(spark, sf_dir, "events").select("event_id", C.redact_json(raw).alias("j"))
    paths = {"api_key": "$.api_key", "deep_secret": "$.inner.clientSecret", "kept": "$.inner.kept", "note": "$.notes[0]"}
    return clean.select(
        "event_id", *[F.get_json_object("j", p).alias(n) for n, p in paths.items()],
        F.get_json_object("j", "$.props.k").cast("bigint").alias("k"),
    )


@query(
    "corpus_redact_unreadable",
    "TXT-5",
    """SELECT event_id, event_id % 5 = 0 AS unreadable, CASE WHEN event_id % 5 NOT IN (0, 1) THEN '[REDACTED]' END AS token FROM events""",
)
def corpus_redact_unreadable(spark, sf_dir):
    """Every fifth text is cut short, every fifth is missing."""
    whole = F.to_json(F.struct(F.col("event_type").alias("token"), F.col("user_id").alias("who")))
    m = F.col("event_id") % 5
    rows = table(spark, sf_dir, "events").select("event_id", F.when(m == 0, F.substring(whole, 1, 9)).when(m > 1, whole).alias("raw"))
    made = C.redact_json_column(rows, "raw", "clean")
    return made.select("event_id", F.col("clean_unreadable").alias("unreadable"), F.get_json_object("clean", "$.token").alias("token"))


@query(
    "corpus_redact_map",
    "TXT-5",
    """SELECT event_id, '[REDACTED]' AS token, event_type AS kind FROM events""",
)
def corpus_redact_map(spark, sf_dir):
    settings = F.create_map(F.lit("authToken"), F.col("user_id").cast("string"), F.lit("kind"), F.col("event_type"))
    clean = table(spark, sf_dir, "events").select("event_id", X.redact_map(settings).alias("m"))
    return clean.select("event_id", F.col("m")["authToken"].alias("token"), F.col("m")["kind"].alias("kind"))


@query(
    "corpus_references",
    "TXT-7 TXT-8",
    f"""WITH a AS (SELECT doc_id, lang, source, text, {_REDACT.format('text')} AS red, {_CLEAN} AS flat FROM documents)
    SELECT doc_id, CASE WHEN flat <> '' THEN sha256(flat) END AS content_hash, CAST(length(text) AS INTEGER) AS content_length,
      CAST(length(red) AS INTEGER) AS redacted_length, {_summary('flat')} AS summary, lang || ',' || source AS tags FROM a""",
)
def corpus_references(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.array(F.concat(F.lit(" "), "lang"), F.col("source"), F.lit(""), F.col("lang")).alias("raw_tags")
    )
    built = C.build_references(docs, "text", tags="raw_tags")
    return built.select("doc_id", "content_hash", "content_length", "redacted_length", "summary", F.array_join("tags", ",").alias("tags"))


@query(
    "corpus_sync",
    "TXT-9",
    f"""WITH a AS (SELECT doc_id, false AS large, CASE WHEN {_CLEAN} <> '' THEN sha256({_CLEAN}) END AS h FROM documents),
    stored AS (SELECT DISTINCT sha256({_CLEAN}) AS h FROM benchmark),
    f AS (SELECT h, min(doc_id) AS first_id FROM a WHERE h IS NOT NULL AND h NOT IN (SELECT h FROM stored) GROUP BY h)
    SELECT doc_id, CASE WHEN large THEN 'too_large' WHEN a.h IS NULL THEN 'empty' WHEN first_id = doc_id THEN 'created' ELSE 'duplicate_hash' END AS outcome
    FROM a LEFT JOIN f USING (h)""",
)
def corpus_sync(spark, sf_dir):
    """Documents against the benchmark texts as the stored corpus."""
    stored = table(spark, sf_dir, "benchmark").select(X.content_hash(F.col("text")).alias("content_hash"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return C.sync_references(docs, "doc_id", "text", stored).select("doc_id", "outcome")


@query(
    "corpus_path_tags",
    "TXT-10",
    """
    WITH a AS (SELECT p_partkey, p_name, p_size % 3 AS k, lower(p_type) AS t FROM part),
    b AS (SELECT p_partkey, CASE k WHEN 0 THEN ['dataset', 'dataset_generation'] WHEN 1 THEN ['model', 'model_generation', 'training'] ELSE ['schema'] END
      || ['internal_reference', 'project_file', CASE WHEN k = 2 THEN 'sql' ELSE 'md' END, t] AS tags FROM a)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(tags)), ',') AS tags FROM b
    """,
)
def corpus_path_tags(spark, sf_dir):
    name = F.when(F.col("p_size") % 3 == 0, F.lit("/Dataset_")).when(F.col("p_size") % 3 == 1, F.lit("/training_model_")).otherwise(F.lit("/schema_"))
    ending = F.when(F.col("p_size") % 3 == 2, F.lit(".SQL")).otherwise(F.lit(".md"))
    path = F.concat(F.lit("/work/Docs/"), "p_type", name, F.col("p_partkey").cast("string"), ending)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.path_tags(path), ",").alias("tags"))


def references(spark, sf_dir):
    """Documents as stored references; shared by the retrieval queries."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(
        F.format_string("ref_%08d", d).alias("reference_id"), "text",
        F.when(d % 4 == 0, "project_file").when(d % 4 == 1, "user_text").otherwise("url").alias("source_type"),
        F.concat_ws(" ", "lang", "source").alias("name"), F.array("lang", "source").alias("tags"),
        F.when(d % 5 == 0, "project").otherwise("user").alias("trust_level"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (d * 7919) % 100_000).alias("updated_at"),
    )
    return C.build_references(docs, "text", tags="tags")


REFERENCES_SQL = f"""r0 AS (SELECT doc_id, lang, source, text, {_CLEAN} AS flat FROM documents),
    r AS (SELECT printf('ref_%08d', doc_id) AS reference_id, doc_id, lang, source, text, flat,
      CASE doc_id % 4 WHEN 0 THEN 'project_file' WHEN 1 THEN 'user_text' ELSE 'url' END AS source_type, lang || ' ' || source AS name,
      CASE WHEN doc_id % 5 = 0 THEN 'project' ELSE 'user' END AS trust_level, (doc_id * 7919) % 100000 AS age,
      {_summary('flat')} AS summary, CASE WHEN flat <> '' THEN sha256(flat) END AS content_hash,
      lower(printf('ref_%08d', doc_id) || ' ' || CASE doc_id % 4 WHEN 0 THEN 'project_file' WHEN 1 THEN 'user_text' ELSE 'url' END
        || ' ' || lang || ' ' || source || ' ' || {_summary('flat')} || ' ' || lang || ' ' || source) AS hay FROM r0)"""


@query(
    "corpus_list_references",
    "TXT-11",
    f"""WITH {REFERENCES_SQL} SELECT reference_id, source_type, name FROM r
    WHERE contains(hay, 'the') AND lang IN ('en', 'fr') AND source_type IN ('project_file', 'url') ORDER BY age DESC, reference_id LIMIT 30""",
)
def corpus_list_references(spark, sf_dir):
    found = C.list_references(references(spark, sf_dir), " THE ", ["EN", "fr"], ["project_file", "URL"], 30)
    return found.select("reference_id", "source_type", "name")


_QUALITY = """CASE WHEN {approved} OR {word} IN ('positive', 'approved', 'completed', 'success') OR {review} = 'approved' OR {state} = 'completed' THEN {a}
    WHEN {word} IN ('needs_revision', 'revision', 'needs-revision') OR {review} IN ('needs_revision', 'changes_requested') THEN {b}
    WHEN {word} IN ('rejected', 'unsafe', 'failed', 'error', 'negative') OR {state} IN ('failed', 'error') THEN {c}
    WHEN {word} IN ('registry_asset', 'reference_asset', 'context') THEN {d} ELSE {e} END"""
_WORDS = "CASE event_id % 7 WHEN 0 THEN 'Positive' WHEN 1 THEN 'revision' WHEN 2 THEN ' unsafe' WHEN 3 THEN 'context' WHEN 4 THEN 'other' ELSE NULL END"
_REVIEWS = "CASE user_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'changes_requested' ELSE NULL END"


@query(
    "corpus_quality_labels",
    "TXT-12",
    "WITH a AS (SELECT event_id, event_type, coalesce(lower(trim(" + _WORDS + ")), '') AS w, coalesce(" + _REVIEWS + ", '') AS v, value > 60 AS ok FROM events) SELECT event_id, CAST("
    + _QUALITY.format(approved="ok", word="w", review="v", state="event_type", a=1, b=0, c=0, d=1, e=0) + " AS INTEGER) AS assistant_success, CAST("
    + _QUALITY.format(approved="ok", word="w", review="v", state="event_type", a=1.0, b=0.5, c=0.0, d=0.75, e=0.25) + " AS DOUBLE) AS assistant_quality_label FROM a",
)
def corpus_quality_labels(spark, sf_dir):
    success, score = C.quality_values(F.expr(_WORDS), F.expr(_REVIEWS), F.col("event_type"), F.col("value") > 60)
    return table(spark, sf_dir, "events").select("event_id", success.alias("assistant_success"), score.alias("assistant_quality_label"))


INTERACTION = "conv_id BIGINT, turn BIGINT, label STRING, workflow_type STRING, prompt STRING, source_hash STRING"


def interaction_lines(spark, sf_dir):
    """User turns as JSON lines; every 17th conversation is cut off and some lines are blank."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    label = F.when(F.col("conv_id") % 3 == 0, "positive").when(F.col("conv_id") % 3 == 1, "rejected")
    line = F.to_json(F.struct(
        "conv_id", "turn", label.alias("label"), F.when(F.col("turn") == 0, "study").otherwise("training").alias("workflow_type"),
        F.col("text").alias("prompt"), F.sha2("text", 256).alias("source_hash"),
    ))
    broken = F.when(F.col("conv_id") % 17 == 0, F.expr("substring(line, 1, length(line) - 2)")).when(F.col("conv_id") % 13 == 0, F.lit("  ")).otherwise(F.col("line"))
    return turns.withColumn("line", line).select(broken.alias("value"))


@query(
    "corpus_tolerant_jsonl",
    "TXT-13 SRC-12",
    """SELECT count(*) FILTER (WHERE conv_id % 17 <> 0) AS kept, count(*) FILTER (WHERE conv_id % 17 = 0) AS rejected,
       count(DISTINCT CASE WHEN conv_id % 17 <> 0 THEN conv_id END) AS conversations,
       CAST(sum(CASE WHEN conv_id % 17 <> 0 THEN length(text) END) AS BIGINT) AS prompt_length
       FROM conversations WHERE role = 'user' AND (conv_id % 17 = 0 OR conv_id % 13 <> 0)""",
)
def corpus_tolerant_jsonl(spark, sf_dir):
    rows = C.load_jsonl(interaction_lines(spark, sf_dir), INTERACTION)
    good = ~F.col("rejected")
    return rows.agg(
        F.count_if(good).alias("kept"), F.count_if("rejected").alias("rejected"),
        F.count_distinct(F.when(good, F.col("conv_id"))).alias("conversations"), F.sum(F.when(good, F.length("prompt"))).alias("prompt_length"),
    )


def interaction_records(spark, sf_dir):
    rows = C.load_jsonl(interaction_lines(spark, sf_dir), INTERACTION).where("NOT rejected")
    return C.to_record(rows, {
        "source_type": F.lit("assistant_interaction"), "label": F.col("label"), "workflow_type": F.col("workflow_type"), "prompt": F.col("prompt"),
        "source_hash": F.col("source_hash"), "recorded_at": F.timestamp_seconds(F.col("conv_id") * 100 + F.col("turn")),
        "record_key": F.format_string("%08d-%03d", "conv_id", "turn"),
    })


def example_objects(spark, sf_dir):
    """One catalog object per part with two samples, built as JSON text."""
    def sample(tier, number):
        payload = F.to_json(F.struct("p_name", "p_brand", F.lit(number).alias("rows")))
        return F.struct(F.lit(tier).alias("tier"), payload.alias("payload"))

    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("Part"), F.col("p_partkey").cast("string")).alias("object_name"), F.lower("p_type").alias("family"),
        F.lit("v1").alias("catalog_version"), F.array(sample("small", 10), sample("large", 1000)).alias("samples"),
    )


_KEPT = "conv_id % 17 <> 0 AND conv_id % 13 <> 0 AND role = 'user'"
_LABEL = "CASE conv_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'rejected' ELSE 'unlabeled' END"


@query(
    "corpus_curation",
    "TXT-14",
    f"""WITH a AS (SELECT {_LABEL} AS label, CASE WHEN turn = 0 THEN 'study' ELSE 'training' END AS w FROM conversations WHERE {_KEPT}
        UNION ALL SELECT 'positive', 'project_example' FROM part, range(2)
        UNION ALL SELECT 'reference_asset', 'reference' FROM documents)
    SELECT 'label' AS "group", label AS name, count(*) AS n FROM a GROUP BY 2 UNION ALL SELECT 'workflow_type', w, count(*) FROM a GROUP BY 2""",
)
def corpus_curation(spark, sf_dir):
    records = interaction_records(spark, sf_dir).unionByName(C.catalog_example_record(example_objects(spark, sf_dir))).unionByName(
        C.reference_record(references(spark, sf_dir), "text")
    )
    return C.curation_counts(records)


@query(
    "corpus_curation_manifest",
    "TXT-14 SNK-4",
    f"""SELECT (SELECT count(*) FROM conversations WHERE {_KEPT}) AS record_count, true AS ready_for_fine_tuning,
        (SELECT count(*) FROM conversations WHERE conv_id % 17 = 0 AND role = 'user') AS rejected_records""",
)
def corpus_curation_manifest(spark, sf_dir):
    rows = C.load_jsonl(interaction_lines(spark, sf_dir), INTERACTION)
    return C.curation_manifest(interaction_records(spark, sf_dir), rows.where("rejected"))


def registry_models(spark, sf_dir):
    """Suppliers as model records of the registry."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("learning_model").alias("object_type"),
        F.concat(F.lit("/models/"), "s_name").alias("path"), F.lit("supervised_model").alias("model_type"),
        F.array(F.lit("l_quantity"), F.lit("l_tax")).alias("input_features"), F.array(F.lit("l_extendedprice")).alias("output_features"),
        F.timestamp_seconds(F.col("s_suppkey") * 60).alias("date"),
    )


@query(
    "corpus_registry_records",
    "TXT-16",
    """SELECT 'registry_learning_model' AS source_type, 'registry_asset' AS label, 'model_generation' AS workflow_type,
       'Model ''' || s_name || ''' type=supervised_model inputs=l_quantity,l_tax outputs=l_extendedprice' AS asset_summary,
       '/models/' || s_name AS source_path, 1 AS assistant_success, CAST(0.75 AS DOUBLE) AS assistant_quality_label FROM supplier""",
)
def corpus_registry_records(spark, sf_dir):
    records = C.registry_asset_record(registry_models(spark, sf_dir), "learning_models")
    return records.select("source_type", "label", "workflow_type", "asset_summary", "source_path", "assistant_success", "assistant_quality_label")


@query(
    "corpus_example_records",
    "TXT-17",
    """WITH s AS (SELECT 'Part' || p_partkey AS o, lower(p_type) AS f, t.tier, '{"p_name":"' || p_name || '","p_brand":"' || p_brand || '","rows":' || t.n || '}' AS payload
         FROM part, (VALUES ('small', 10), ('large', 1000)) t(tier, n))
    SELECT 'Use this validated ' || o || ' ' || tier || ' example as a schema, metadata, and workflow reference.' AS prompt,
      f || '.' || o || ' ' || tier || ' validated project example.' AS asset_summary, payload AS content,
      sha256('{"catalog_version":"v1","object_name":"' || o || '","tier":"' || tier || '","payload":"' || replace(payload, '"', '\\"') || '"}') AS source_hash,
      CAST(1.0 AS DOUBLE) AS assistant_quality_label FROM s""",
)
def corpus_example_records(spark, sf_dir):
    return C.catalog_example_record(example_objects(spark, sf_dir)).select("prompt", "asset_summary", "content", "source_hash", "assistant_quality_label")


@query(
    "corpus_reference_records",
    "TXT-18 TXT-19",
    f"""WITH {REFERENCES_SQL}, t AS (SELECT *, {_REDACT.format('text')} AS red FROM r)
    SELECT 'content_reference' AS source_type, content_hash AS source_hash, {_REDACT.format('summary')} AS asset_summary, md5(red) AS content_md5,
      1 AS assistant_success, CAST(0.75 AS DOUBLE) AS assistant_quality_label, '' AS source_path FROM t""",
)
def corpus_reference_records(spark, sf_dir):
    rows = C.tabular_rows(C.reference_record(references(spark, sf_dir), "text"))
    return rows.select("source_type", "source_hash", "asset_summary", F.md5("content").alias("content_md5"), "assistant_success", "assistant_quality_label", "source_path")


def snapshot(spark, sf_dir):
    """Six source families: interactions, context packs, evaluations, runs, references, registry."""
    labels = table(spark, sf_dir, "labels")
    packs = C.to_record(table(spark, sf_dir, "benchmark"), {
        "source_type": F.lit("context_pack"), "label": F.lit("context"), "workflow_type": F.lit("study"), "prompt": F.col("text"),
        "context_pack_hash": F.sha2("text", 256), "recorded_at": F.timestamp_seconds("item_id"), "record_key": F.format_string("%08d", "item_id"),
    })
    passed = F.col("quality") == 1
    evals = C.to_record(labels, {
        "source_type": F.lit("assistant_eval"), "label": F.when(passed, "positive").otherwise("needs_revision"),
        "recorded_at": F.timestamp_seconds("doc_id"), "record_key": F.format_string("%08d", "doc_id"),
    }, approved=passed)
    kind = F.when(F.col("user_id") % 2 == 0, "training_run").otherwise("study_run")
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    runs = C.to_record(table(spark, sf_dir, "events"), {
        "source_type": kind, "label": F.when(state == "completed", "positive").otherwise(state), "workflow_type": F.regexp_replace(kind, "_run$", ""),
        "recorded_at": F.col("ts"), "record_key": F.format_string("%010d", "event_id"),
    }, status=state)
    registry = C.registry_asset_record(registry_models(spark, sf_dir), "learning_models")
    return C.corpus_snapshot([
        interaction_records(spark, sf_dir), packs, evals, runs, C.reference_record(references(spark, sf_dir), "text"), registry,
    ])


@query(
    "corpus_snapshot",
    "TXT-15",
    f"""WITH a AS (
      SELECT * FROM (SELECT 'assistant_interaction' AS source_type, {_LABEL} AS label FROM conversations WHERE {_KEPT} ORDER BY conv_id * 100 + turn DESC, printf('%08d-%03d', conv_id, turn) DESC)
      UNION ALL SELECT * FROM (SELECT 'context_pack', 'context' FROM benchmark ORDER BY item_id DESC)
      UNION ALL SELECT * FROM (SELECT 'assistant_eval', CASE WHEN quality = 1 THEN 'positive' ELSE 'needs_revision' END FROM labels ORDER BY doc_id DESC)
      UNION ALL SELECT * FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'training_run' ELSE 'study_run' END, CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'error' THEN 'failed' ELSE 'running' END
          FROM events ORDER BY ts DESC, event_id DESC)
      UNION ALL SELECT * FROM (SELECT 'content_reference', 'reference_asset' FROM documents ORDER BY (doc_id * 7919) % 100000 DESC, doc_id DESC)
      UNION ALL SELECT * FROM (SELECT 'registry_learning_model', 'registry_asset' FROM supplier ORDER BY s_suppkey DESC))
    SELECT source_type, label, CASE label WHEN 'positive' THEN 1.0::DOUBLE WHEN 'needs_revision' THEN 0.5 WHEN 'failed' THEN 0 WHEN 'rejected' THEN 0
      WHEN 'context' THEN 0.75 WHEN 'reference_asset' THEN 0.75 WHEN 'registry_asset' THEN 0.75 ELSE 0.25 END AS assistant_quality_label, count(*) AS n FROM a GROUP BY 1, 2, 3""",
)
def corpus_snapshot(spark, sf_dir):
    return snapshot(spark, sf_dir).groupBy("source_type", "label", "assistant_quality_label").agg(F.count(F.lit(1)).alias("n"))


_EXAMPLE_SQL = f"""x AS (SELECT printf('%08d-%03d', conv_id, turn) AS record_key, {_LABEL} AS label, CASE WHEN turn = 0 THEN 'study' ELSE 'training' END AS w,
      trim({_REDACT.format('text')}, chr(10) || chr(13) || chr(9) || ' ') || chr(10) || CASE WHEN turn = 0 THEN 'study' ELSE 'training' END AS prompt FROM conversations WHERE {_KEPT})"""


@query(
    "corpus_instruction_examples",
    "TXT-21",
    f"WITH {_EXAMPLE_SQL} SELECT record_key, label, w AS workflow_type, 'system,user,assistant' AS roles, md5(prompt) AS prompt_md5 FROM x",
)
def corpus_instruction_examples(spark, sf_dir):
    made = C.instruction_examples(interaction_records(spark, sf_dir))
    return made.select(
        "record_key", "label", "workflow_type", F.array_join("messages.role", ",").alias("roles"), F.md5(F.col("messages")[1]["content"]).alias("prompt_md5")
    )


_DOC_TOKENS = "len(regexp_extract_all('sys' || chr(10) || {0} || chr(10) || {1}, '\\S+'))"


@query(
    "corpus_token_statistics",
    "TXT-22",
    f"""WITH {REFERENCES_SQL}, k AS (SELECT {_DOC_TOKENS.format("'reference' || chr(10) || summary || chr(10) || " + _REDACT.format('text'), "'{}'")} AS n,
       {_DOC_TOKENS.format("'x'", "reference_id")} AS unused FROM r)
    SELECT count(*) AS record_count, CAST(sum(n) AS BIGINT) AS total_estimated_tokens, round(avg(n), 6) AS average_estimated_tokens,
      max(n) AS max_observed_tokens, count(*) FILTER (WHERE n > 1024) AS truncation_count, round(avg(CASE WHEN n > 1024 THEN 1.0 ELSE 0.0 END), 6) AS truncation_rate FROM k""",
)
def corpus_token_statistics(spark, sf_dir):
    """Documents as records whose response is one token, so both sides count the same text."""
    records = C.reference_record(references(spark, sf_dir), "text").withColumn("registry_metadata", F.lit("{x}"))
    stats = C.token_statistics(C.instruction_examples(records, system="sys", max_tokens=1024))
    return stats.withColumns({"average_estimated_tokens": F.round("average_estimated_tokens", 6), "truncation_rate": F.round("truncation_rate", 6)})


@query(
    "corpus_label_counts",
    "TXT-22",
    f"SELECT {_LABEL} AS label, count(*) AS n FROM conversations WHERE {_KEPT} GROUP BY 1",
)
def corpus_label_counts(spark, sf_dir):
    return C.label_counts(C.instruction_examples(interaction_records(spark, sf_dir)))


def drafts(spark, sf_dir):
    """Documents as drafts of five kinds, with gaps in every checked field."""
    d = F.col("doc_id")
    kinds = F.array(*[F.lit(k) for k in C.REQUIRED_OUTPUTS])
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", d.cast("string").alias("draft_id"), F.element_at(kinds, (d % 5 + 1).cast("int")).alias("draft_type"),
        F.element_at(F.split("text", "\n"), 1).alias("title"), "text",
    )
    payload = F.create_map(F.lit("name"), F.col("title"), F.lit("object_type"), F.lit("m"), F.lit("path"), F.when(d % 3 == 0, "/p").otherwise(""))
    listed = F.array(F.lit("numpy"))
    return docs.select(
        "source", "draft_id", "draft_type", "title", F.col("text").alias("summary"),
        F.when(d % 11 != 0, "csv_text joblib_bytes").alias("code"), F.lit("pack").alias("context_pack_id"),
        F.when(d % 13 != 0, F.md5("text")).alias("context_pack_hash"), F.lit("m1").alias("model_version"), F.lit("p1").alias("prompt_template_version"),
        F.lit("e1").alias("evaluation_profile"),
        F.when(d % 2 == 0, payload).alias("registry_payload"), F.when(d % 2 == 1, payload).alias("form_payload"),
        F.lit("{}").alias("training_request"), F.when(d % 2 == 0, "{}").alias("study_request"),
        F.when(d % 19 != 0, F.array(F.lit("risk"))).alias("risks"), F.lit(None).cast("array<string>").alias("assumptions"),
        F.array(F.lit("submit")).alias("next_actions"), (d % 23 != 0).alias("approved"), (d % 29 != 0).alias("safety_ok"),
        F.when(d % 4 == 0, listed).alias("dependencies"), F.when(d % 4 == 1, listed).alias("review_dependencies"),
        F.when(d % 4 == 3, "unknown").alias("execution_profile"),
    )


_DRAFTS = """d AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS title, text, doc_id % 5 AS k FROM documents),
    c AS (SELECT *, CASE k WHEN 0 THEN doc_id % 11 <> 0 WHEN 1 THEN doc_id % 11 <> 0 WHEN 4 THEN doc_id % 2 = 0 ELSE true END AS req,
      k <> 2 OR doc_id % 3 = 0 AS reg, title <> '' AS titled, length(trim(title)) >= 8 AND lower(trim(title)) NOT IN ('review', 'draft', 'assistant review') AS tq,
      length(trim(text)) >= 24 AS sq FROM d),
    e AS (SELECT *, titled AND doc_id % 13 <> 0 AND doc_id % 23 <> 0 AND req AND doc_id % 29 <> 0 AND doc_id % 4 <> 3 AND reg AND tq AND sq AND doc_id % 19 <> 0 AS passed FROM c)"""


@query(
    "corpus_draft_contract",
    "TXT-23",
    f"""WITH {_DRAFTS} SELECT CAST(doc_id AS VARCHAR) AS draft_id, req AS required_outputs, doc_id % 23 <> 0 AS review_approved,
      titled AND req AS output_alignment, reg AS registry_alignment, doc_id % 29 <> 0 AND doc_id % 4 <> 3 AS dependency_alignment, doc_id % 13 <> 0 AS mlflow_alignment, tq AS title_quality, sq AS summary_quality,
      doc_id % 19 <> 0 AS risk_or_assumption_quality, passed FROM e""",
)
def corpus_draft_contract(spark, sf_dir):
    done = C.evaluate_drafts(drafts(spark, sf_dir))
    return done.select(
        "draft_id", *[F.col("checks")[c].alias(c) for c in ("required_outputs", "review_approved")],
        *[F.col("alignment_contracts")[c].alias(c) for c in ("output_alignment", "registry_alignment", "dependency_alignment", "mlflow_alignment")],
        *[F.col("draft_quality")[c].alias(c) for c in ("title_quality", "summary_quality", "risk_or_assumption_quality")], "passed",
    )


@query(
    "corpus_recent",
    "TXT-24",
    f"""SELECT * FROM (SELECT 'example' AS kind, printf('%08d-%03d', conv_id, turn) AS key FROM conversations WHERE {_KEPT} ORDER BY conv_id * 100 + turn DESC, 2 DESC LIMIT 3)
        UNION ALL SELECT * FROM (SELECT 'evaluation', CAST(doc_id AS VARCHAR) FROM labels ORDER BY doc_id DESC LIMIT 3)""",
)
def corpus_recent(spark, sf_dir):
    examples = C.recent(interaction_records(spark, sf_dir), "recorded_at", "record_key", 3)
    evals = C.recent(table(spark, sf_dir, "labels"), "doc_id", "doc_id", 3)
    return examples.select(F.lit("example").alias("kind"), F.col("record_key").alias("key")).unionByName(
        evals.select(F.lit("evaluation").alias("kind"), F.col("doc_id").cast("string").alias("key"))
    )


@query(
    "corpus_evaluation_suite",
    "TXT-25",
    f"WITH {_DRAFTS} SELECT source AS suite, count(*) AS cases, count(*) FILTER (WHERE passed) AS passed_cases, bool_and(passed) AS passed FROM e GROUP BY source",
)
def corpus_evaluation_suite(spark, sf_dir):
    named = drafts(spark, sf_dir)
    done = C.evaluate_drafts(named).join(named.select("draft_id", F.col("source").alias("suite")), "draft_id")
    return C.suite_results(done)
