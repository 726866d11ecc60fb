"""Corpus curation: references, labels, records, snapshots and statistics.

Open JSON fields travel as JSON text, so every source can be united without losing keys.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.functions import text as X
from millrace.session import durable

# ---------------------------------------------------------------------------
# Limits, label words, the record layout and required outputs.
MAX_CONTEXT_TOKENS = 4_096
TOPIC_WORDS = ("dataset", "model", "registry", "feature", "training", "study", "mlflow", "schema", "prompt")
POSITIVE_LABELS = ("positive", "approved", "completed", "success")
REVISION_LABELS = ("needs_revision", "revision", "needs-revision")
REVISION_STATUSES = ("needs_revision", "changes_requested")
FAILED_LABELS = ("rejected", "unsafe", "failed", "error", "negative")
FAILED_STATUSES = ("failed", "error")
CONTEXT_LABELS = ("registry_asset", "reference_asset", "context")
RECORD_COLUMNS = (
    "source_type", "label", "workflow_type", "prompt", "context_pack_hash", "asset_summary", "content",
    "registry_metadata", "source_path", "source_hash", "draft", "review", "user_edits", "quality_signals",
    "assistant_success", "assistant_quality_label",
)
REQUIRED_OUTPUTS = {
    "dataset_generation": "csv_text", "model_generation": "joblib_bytes", "registry_object": "registry_payload",
    "training_run": "training_request", "study": "study_request",
}
PROFILES = ("dataset_generation", "model_generation", "registry_object", "feature_operations", "training_run", "study")
GENERIC_TITLES = ("review", "draft", "assistant review")
DEFAULT_PROMPT = "Create a valid assistant draft."
SYSTEM_MESSAGE = (
    "You are the workspace assistant. Return strict draft JSON only. "
    "Use project context, registry schemas, safety rules, and approved dependencies."
)
# ---------------------------------------------------------------------------


def path_tags(path: Column) -> Column:
    """Sorted distinct tags from a file path: extension, folder and topic words."""
    file = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    folder = F.regexp_extract(F.lower(path), r"^(.*)/[^/]*$", 1)
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    tags = [F.lit("internal_reference"), F.lit("project_file"), F.regexp_extract(file, r".\.([^.]+)$", 1), F.regexp_extract(folder, r"([^/]*)$", 1)]
    for word in TOPIC_WORDS:
        tags.append(F.when(stem.contains(word) | folder.contains(word), F.lit(word)))
        if word in ("dataset", "model"):
            tags.append(F.when(stem.contains(word), F.lit(f"{word}_generation")))
    return F.array_sort(F.array_distinct(F.filter(F.array(*tags), lambda t: t.isNotNull() & (t != ""))))


def clean_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""))


def build_references(df: DataFrame, text: str, tags: str | None = None, summary: str | None = None) -> DataFrame:
    """Adds summary, content hash, lengths, excerpts and clean tags to a table of texts."""
    out = df.withColumn("_redacted", X.redact(F.col(text))).withColumn("_flat", X.squeeze(F.col("_redacted"))).withColumns({
        "content_hash": F.when(F.col("_flat") != "", F.sha2("_flat", 256)),
        "content_length": F.length(F.coalesce(text, F.lit(""))),
        "redacted_length": F.length("_redacted"),
        "excerpts": F.when(F.col("_flat") == "", F.array().cast("array<string>")).otherwise(X.excerpts(F.col("_flat"))),
        "summary": F.coalesce(F.nullif(F.col(summary), F.lit("")), X.summarise_flat(F.col("_flat"))) if summary else X.summarise_flat(F.col("_flat")),
    })
    if tags:
        out = out.withColumn("tags", clean_tags(F.col(tags)))
    return out.drop("_redacted", "_flat")


def sync_references(files: DataFrame, path: str, text: str, stored: DataFrame | None = None, max_bytes: int | None = None) -> DataFrame:
    """(path, content_hash, outcome): created, empty, duplicate_hash, or too_large beyond ``max_bytes``.

    Of equal texts the first path is created. That path is found by an aggregate per hash and
    joined back on the path, so a text shared by a third of all files meets no hot join key. The
    texts are hashed once; only paths and hashes are written to the shared store and joined.
    """
    large = F.lit(False) if max_bytes is None else F.coalesce(F.octet_length(text) > max_bytes, F.lit(False))
    sized = durable(files.select(path, large.alias("_large"), F.when(~large, X.content_hash(F.col(text))).alias("content_hash")))
    firsts = sized.groupBy("content_hash").agg(F.min(path).alias("_first")).where(F.col("content_hash").isNotNull())
    if stored is not None:
        known = stored.select("content_hash").where(F.col("content_hash").isNotNull()).distinct()
        firsts = firsts.join(known, "content_hash", "left_anti")
    created = firsts.select(F.col("_first").alias(path), F.lit(True).alias("_new"))
    outcome = (
        F.when(F.col("_large"), "too_large").when(F.col("content_hash").isNull(), "empty")
        .when(F.col("_new"), "created").otherwise("duplicate_hash")
    )
    return sized.join(created, path, "left").withColumn("outcome", outcome).select(path, "content_hash", "outcome")


def list_references(
    df: DataFrame, query: str = "", tags: Sequence[str] = (), source_types: Sequence[str] = (), limit: int = 20
) -> DataFrame:
    """Newest references that contain the query, carry any wanted tag and have a wanted source."""
    keep = F.lit(True)
    if query.strip():
        keep = keep & reference_haystack().contains(query.strip().lower())
    wanted = sorted({t.strip().lower() for t in tags if t.strip()})
    if wanted:
        keep = keep & F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*[F.lit(t) for t in wanted]))
    kinds = [s.strip().lower() for s in source_types if s.strip()]
    if kinds:
        keep = keep & F.lower("source_type").isin(kinds)
    return df.where(keep).orderBy(F.desc("updated_at"), "reference_id").limit(max(1, int(limit or 20)))


def reference_haystack() -> Column:
    return F.lower(F.concat_ws(" ", "reference_id", "source_type", F.coalesce("name", F.lit("")), "summary", F.array_join("tags", " ")))


def quality_values(label: Column, review_status: Column, status: Column, approved: Column) -> tuple[Column, Column]:
    """(success, score) by the decision table, tested from top to bottom."""
    word, review, state = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (label, review_status, status))
    steps = (
        (F.coalesce(approved, F.lit(False)) | word.isin(*POSITIVE_LABELS) | (review == "approved") | (state == "completed"), 1, 1.0),
        (word.isin(*REVISION_LABELS) | review.isin(*REVISION_STATUSES), 0, 0.5),
        (word.isin(*FAILED_LABELS) | state.isin(*FAILED_STATUSES), 0, 0.0),
        (word.isin(*CONTEXT_LABELS), 1, 0.75),
    )
    success, score = F.lit(0), F.lit(0.25)
    for test, ok, value in reversed(steps):
        success, score = F.when(test, F.lit(ok)).otherwise(success), F.when(test, F.lit(value)).otherwise(score)
    return success, score


def load_jsonl(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parsed rows of JSON lines with ``rejected``; blank lines vanish, other bad lines are marked.

    A line must hold one JSON object; anything else is rejected.
    """
    text = F.trim(column)
    parsed = F.from_json(text, schema + ", _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(text != "").withColumn("_r", parsed)
    rejected = F.coalesce(F.col("_r._bad").isNotNull(), F.lit(True)) | ~text.startswith("{")
    return rows.withColumn("rejected", rejected).select("_r.*", "rejected").drop("_bad")


def redact_json(col: Column) -> Column:
    """Secrets in free-form JSON text: values by key name at any depth, text rule on other strings.

    The nesting is unknown, so no fixed Spark schema fits; the values are rewritten batch-wise.
    """
    key, pair, bearer, mark = re.compile(X.SECRET_KEY), re.compile(X.SECRET_PAIR), re.compile(X.SECRET_BEARER), X.SECRET_MARK

    def clean(value):
        if isinstance(value, dict):
            return {k: mark if key.search(k) else clean(v) for k, v in value.items()}
        if isinstance(value, list):
            return [clean(v) for v in value]
        if isinstance(value, str):
            return bearer.sub("secret=" + mark, pair.sub(r"\1=" + mark, value))
        return value

    def one(text):
        try:
            return json.dumps(clean(json.loads(text)), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(col)


def redact_json_column(df: DataFrame, column: str, into: str) -> DataFrame:
    """Adds ``into``, the redacted JSON of a column, and ``into``_unreadable, which marks text that is no JSON.

    Unreadable text is not passed on, since its secrets cannot be told apart; a missing value is not unreadable.
    """
    out = df.withColumn(into, redact_json(F.col(f"`{column}`")))
    return out.withColumn(f"{into}_unreadable", F.col(f"`{column}`").isNotNull() & F.col(f"`{into}`").isNull())


def to_record(df: DataFrame, fields: Mapping[str, Column], approved: Column | None = None,
              review_status: Column | None = None, status: Column | None = None) -> DataFrame:
    """The common record layout; fields that a source lacks take the layout's empty values."""
    empty = {
        "source_type": F.lit("unknown"), "label": F.lit("unlabeled"), "workflow_type": F.lit("unknown"), "prompt": F.lit(""),
        "context_pack_hash": F.lit(None), "asset_summary": F.lit(""), "content": F.lit(""), "registry_metadata": F.lit("{}"),
        "source_path": F.lit(None), "source_hash": F.lit(None), "draft": F.lit("{}"), "review": F.lit("{}"),
        "user_edits": F.lit("{}"), "quality_signals": F.lit("{}"),
    }
    got = {name: F.coalesce(fields[name].cast("string"), default.cast("string")) if name in fields else default.cast("string") for name, default in empty.items()}
    none, no = F.lit(None).cast("string"), F.lit(False)
    success, score = quality_values(
        got["label"], review_status if review_status is not None else none, status if status is not None else none,
        approved if approved is not None else no,
    )
    clean = {n: X.redact(c) if n in ("prompt", "asset_summary", "content") else c for n, c in got.items()}
    newest = fields["recorded_at"] if "recorded_at" in fields else F.lit(None)
    tie = fields["record_key"] if "record_key" in fields else F.lit("")
    return df.select(
        *[c.alias(n) for n, c in clean.items()], success.alias("assistant_success"), score.alias("assistant_quality_label"),
        newest.cast("timestamp").alias("recorded_at"), tie.cast("string").alias("record_key"),
    )


def newest_records(records: DataFrame, per_source: int | None = None) -> DataFrame:
    """All records of one source, or the newest ones: a bounded heap per task."""
    if per_source is None:
        return records
    return records.orderBy(F.desc_nulls_last("recorded_at"), F.desc("record_key")).limit(per_source)


def corpus_snapshot(sources: Sequence[DataFrame], per_source: int | None = None) -> DataFrame:
    """All or the newest records of every source in one table."""
    first, *rest = [newest_records(s, per_source) for s in sources]
    for frame in rest:
        first = first.unionByName(frame)
    return first


def curation_counts(records: DataFrame) -> DataFrame:
    """(group, name, n): records per label and per workflow type from one pass."""
    pairs = F.array(F.struct(F.lit("label").alias("group"), F.col("label").alias("name")),
                    F.struct(F.lit("workflow_type").alias("group"), F.col("workflow_type").alias("name")))
    return records.select(F.explode(pairs).alias("p")).groupBy("p.group", "p.name").agg(F.count(F.lit(1)).alias("n"))


def curation_manifest(records: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: kept and rejected counts and whether a positive record exists."""
    kept = records.agg(F.count(F.lit(1)).alias("record_count"), F.coalesce(F.bool_or(F.col("label") == "positive"), F.lit(False)).alias("ready_for_fine_tuning"))
    return kept.withColumn("rejected_records", rejected.agg(F.count(F.lit(1)).alias("n")).scalar())


def registry_asset_record(df: DataFrame, kind: str) -> DataFrame:
    """Registry rows of one kind as records. Expects the kind's columns; missing ones are skipped."""
    has = [c for c in df.columns]
    common = [c for c in ("id", "name", "description", "object_type", "path", "version") if c in has]
    extra = {
        "datasets": ("dataset_type", "shape", "features_list"),
        "learning_models": ("model_type", "parameters", "metrics", "input_features", "output_features", "is_trained"),
        "assistant_models": ("model_type", "parameters", "metrics", "input_features", "output_features", "is_trained"),
        "code_models": ("variables", "language"),
        "inference_models": ("learning_model_id", "dataset_id", "input_features", "output_features", "inference_params"),
        "study_models": ("learning_model_id", "dataset_id", "sampler", "objective", "best_params"),
    }[kind]
    meta = F.to_json(F.struct(*common, *[c for c in extra if c in has]), {"ignoreNullFields": "false"})
    workflow = {
        "datasets": "dataset_generation", "learning_models": "model_generation", "assistant_models": "assistant_model",
        "code_models": "code_asset", "inference_models": "inference", "study_models": "study",
    }[kind]
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in has if not isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))}

    def word(c: str) -> Column:
        return text.get(c, F.array_join(c, ",") if c in has else F.lit("None"))

    if kind == "datasets":
        summary = F.format_string("Dataset '%s' type=%s shape=%s features=%s", *[word(c) for c in ("name", "dataset_type", "shape", "features_list")])
    elif kind in ("learning_models", "assistant_models"):
        summary = F.format_string("Model '%s' type=%s inputs=%s outputs=%s", *[word(c) for c in ("name", "model_type", "input_features", "output_features")])
    elif kind == "code_models":
        summary = F.format_string("CodeModel '%s' with saved script content and variables.", word("name"))
    else:
        summary = word("name")
    content = F.coalesce(F.nullif(F.col("code"), F.lit("")), meta) if kind == "code_models" and "code" in has else meta
    return to_record(df, {
        "source_type": F.lit(f"registry_{kind.rstrip('s')}"), "label": F.lit("registry_asset"), "workflow_type": F.lit(workflow),
        "asset_summary": summary, "content": X.clip_record_text(X.redact(content)), "registry_metadata": meta,
        "source_path": F.col("path") if "path" in has else F.lit(None), "source_hash": F.sha2(meta, 256),
        "quality_signals": F.to_json(F.struct(F.lit(kind).alias("registry_source"), (content != "").alias("has_content"))),
        **({"recorded_at": F.col("date")} if "date" in has else {}), **({"record_key": F.col("id")} if "id" in has else {}),
    })


def catalog_example_record(objects: DataFrame) -> DataFrame:
    """(object_name, family, catalog_version, samples[tier, payload]) as one record per sample."""
    rows = objects.select("object_name", "family", "catalog_version", F.explode("samples").alias("s")).where("s.payload IS NOT NULL")
    key = F.to_json(F.struct("catalog_version", "object_name", F.col("s.tier").alias("tier"), X.redact(F.col("s.payload")).alias("payload")))
    meta = F.to_json(F.struct("catalog_version", "object_name", "family", F.col("s.tier").alias("tier")))
    return to_record(rows, {
        "source_type": F.lit("project_example_catalog"), "label": F.lit("positive"), "workflow_type": F.lit("project_example"),
        "prompt": F.format_string("Use this validated %s %s example as a schema, metadata, and workflow reference.", "object_name", "s.tier"),
        "context_pack_hash": F.lit(""), "asset_summary": F.format_string("%s.%s %s validated project example.", "family", "object_name", "s.tier"),
        "content": X.clip_record_text(X.redact(F.col("s.payload"))), "registry_metadata": meta,
        "source_path": F.lit("/examples/catalog"), "source_hash": F.sha2(key, 256), "record_key": F.concat_ws(":", "object_name", "s.tier"),
    })


def reference_record(references: DataFrame, text: str | None = None, text_limit: int | None = None) -> DataFrame:
    """References as records; without the text the excerpts stand in for it."""
    body = F.coalesce(F.nullif(F.col(text), F.lit("")), F.array_join("excerpts", "\n")) if text else F.array_join("excerpts", "\n")
    meta = F.to_json(F.struct("reference_id", F.col("source_type"), "name", "trust_level", "tags"))
    return to_record(references, {
        "source_type": F.lit("content_reference"), "label": F.lit("reference_asset"), "workflow_type": F.lit("reference"),
        "asset_summary": F.col("summary"), "content": X.clip_record_text(X.redact(body), text_limit), "registry_metadata": meta,
        "source_path": F.col("uri") if "uri" in references.columns else F.lit(None),
        "source_hash": F.coalesce("content_hash", F.sha2(meta, 256)),
        "quality_signals": F.to_json(F.struct("trust_level", F.size("tags").alias("tag_count"), (body != "").alias("has_content"))),
        "recorded_at": F.col("updated_at") if "updated_at" in references.columns else F.lit(None), "record_key": F.col("reference_id"),
    })


def tabular_rows(records: DataFrame, text_limit: int | None = None) -> DataFrame:
    """The 16 columns of the table form: no NULL text; with a limit, long text is cut with a note."""
    def cell(name: str) -> Column:
        dtype = records.schema[name].dataType
        if isinstance(dtype, T.BooleanType):
            return F.col(name).cast("int").alias(name)
        if isinstance(dtype, T.NumericType):
            return F.col(name)
        return X.clip_record_text(X.redact(F.col(name)), text_limit).alias(name)

    return records.select(*[cell(c) for c in RECORD_COLUMNS])


def instruction_examples(records: DataFrame, system: str = SYSTEM_MESSAGE, default_prompt: str = DEFAULT_PROMPT,
                         max_tokens: int = MAX_CONTEXT_TOKENS) -> DataFrame:
    """Three messages per record with a token estimate.

    The prompt joins the non-blank parts of four fields; the response is the first non-empty of
    draft, registry metadata, review and quality signals, else the whole record.
    """
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("prompt", "workflow_type", "asset_summary", "content")]
    parts = F.filter(F.array(*fields), lambda p: p.rlike(f"[^{X.SPACE_SET}]"))
    joined = F.regexp_replace(F.array_join(parts, "\n"), f"^{X.SPACES}|{X.SPACES}$", "")
    prompt = X.or_else(joined, default_prompt)

    def filled(name: str) -> Column:
        return F.when(~F.coalesce(F.col(name), F.lit("")).isin("", "{}", "[]", "null"), F.col(name))

    whole = F.to_json(F.struct(*[c for c in RECORD_COLUMNS if c in records.columns]))
    response = F.coalesce(*[filled(c) for c in ("draft", "registry_metadata", "review", "quality_signals")], whole)
    tokens = X.token_count(F.concat_ws("\n", F.lit(system), "user", "answer"))
    return (
        records.withColumns({"user": prompt, "answer": response})
        .withColumn("estimated_tokens", tokens.cast("bigint"))
        .select(
            F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in
                      (("system", F.lit(system)), ("user", F.col("user")), ("assistant", F.col("answer")))]).alias("messages"),
            "source_hash", "workflow_type", F.coalesce("label", F.lit("unlabeled")).alias("label"), "estimated_tokens",
            (F.col("estimated_tokens") > max_tokens).alias("truncated"), "record_key",
        )
    )


def token_statistics(examples: DataFrame) -> DataFrame:
    """One row: records, tokens, average, largest, over-long count and rate."""
    return examples.agg(
        F.count(F.lit(1)).alias("record_count"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("total_estimated_tokens"),
        F.coalesce(F.avg("estimated_tokens"), F.lit(0.0)).alias("average_estimated_tokens"),
        F.coalesce(F.max("estimated_tokens"), F.lit(0)).alias("max_observed_tokens"),
        F.count_if("truncated").alias("truncation_count"),
        F.coalesce(F.avg(F.col("truncated").cast("double")), F.lit(0.0)).alias("truncation_rate"),
    )


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(F.col(label), F.lit("")), F.lit("unlabeled")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def evaluate_drafts(drafts: DataFrame) -> DataFrame:
    """Contract checks of drafts: maps of base checks, alignment and quality, and ``passed``.

    A missing or empty registry payload gives way to ``form_payload``. Evidence of dependencies is the list of the
    provider (``dependencies``), that of the review (``review_dependencies``), or a known execution profile; an empty
    list gives way to the next. Columns that are absent are missing.
    """
    there = {c.lower() for c in drafts.columns}

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in there else F.lit(None).cast(kind)

    def given(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) != ""

    kind, title = F.col("draft_type"), F.trim(F.coalesce("title", F.lit("")))
    filled = lambda c: F.when(F.size(c) > 0, c)
    payload = F.coalesce(filled(F.col("registry_payload")), filled(column("form_payload", "map<string,string>")))
    profile = F.coalesce(F.nullif(column("execution_profile", "string"), F.lit("")), kind)
    evidence = F.coalesce(filled(F.col("dependencies")), filled(column("review_dependencies", "array<string>"))).isNotNull() | profile.isin(*PROFILES)
    base = {
        "valid_workflow_draft": given("draft_id") & given("draft_type") & given("title"),
        "has_context_pack": given("context_pack_id") & given("context_pack_hash"),
        "has_model_version": given("model_version"),
        "has_prompt_template_version": given("prompt_template_version"),
        "review_approved": F.coalesce("approved", F.lit(False)),
    }
    outputs = {
        "registry_payload": F.coalesce(F.size(payload) > 0, F.lit(False)),
        "training_request": given("training_request"), "study_request": given("study_request"),
    }
    required = F.lit(True)
    for draft_kind, name in REQUIRED_OUTPUTS.items():
        present = outputs.get(name, F.coalesce("code", F.lit("")).contains(name))
        required = F.when(kind == draft_kind, present).otherwise(required)
    registry_ok = F.lit(True)
    for key in ("name", "object_type", "path"):
        registry_ok = registry_ok & F.coalesce(F.try_element_at(payload, F.lit(key)) != "", F.lit(False))
    safe = F.coalesce("safety_ok", F.lit(False))
    alignment = {
        "output_alignment": base["valid_workflow_draft"] & required,
        "safety_alignment": safe,
        "registry_alignment": (kind != "registry_object") | registry_ok,
        "dependency_alignment": safe & evidence,
        "mlflow_alignment": given("model_version") & given("prompt_template_version") & given("context_pack_hash") & given("evaluation_profile"),
    }
    quality = {
        "title_quality": (F.length(title) >= 8) & ~F.lower(title).isin(*GENERIC_TITLES),
        "summary_quality": F.length(F.trim(F.coalesce("summary", F.lit("")))) >= 24,
        "risk_or_assumption_quality": (F.size(F.coalesce("risks", F.array())) > 0) | (F.size(F.coalesce("assumptions", F.array())) > 0),
        "next_action_quality": F.size(F.coalesce("next_actions", F.array())) > 0,
        "reference_traceability": given("context_pack_hash"),
    }

    def as_map(checks: Mapping[str, Column]) -> Column:
        return F.create_map(*[x for k, v in checks.items() for x in (F.lit(k), F.coalesce(v, F.lit(False)))])

    out = drafts.withColumns({
        "checks": F.map_concat(as_map(base), as_map({"required_outputs": required})),
        "alignment_contracts": as_map(alignment), "draft_quality": as_map(quality),
    })
    every = [F.forall(F.map_values(c), lambda v: v) for c in ("checks", "alignment_contracts", "draft_quality")]
    return out.select("draft_id", "draft_type", "checks", "alignment_contracts", "draft_quality", (every[0] & every[1] & every[2]).alias("passed"))


def suite_results(evaluations: DataFrame, suite: str = "suite") -> DataFrame:
    """A suite passes if all its cases pass."""
    return evaluations.groupBy(suite).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed_cases"), F.bool_and("passed").alias("passed")
    )


def recent(df: DataFrame, newest: str, key: str, rows: int) -> DataFrame:
    return df.orderBy(F.desc(newest), F.desc(key)).limit(max(1, rows))
