"""Registry tables: inheritance reads, dependencies, lookups, repairs and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions import values as V

# ---------------------------------------------------------------------------
# Spellings of the type words and the accepted word for each.
TYPE_ALIASES = {
    "object_type": {
        "code": "code_model", "codes": "code_model",
        "inference": "inference_model", "monitor": "inference_model",
        "model": "learning_model", "models": "learning_model",
        "study": "study_model",
        "panel": "panel_dashboard", "paneldashboard": "panel_dashboard",
    },
    "dataset_type": {
        "csv": "dataset", "tsv": "dataset", "json": "dataset", "parquet": "dataset", "excel": "dataset", "xlsx": "dataset",
        "xls": "dataset", "table": "dataset", "tabular": "dataset", "dataframe": "dataset",
        "assistant_training": "assistant_training_dataset", "assistant_dataset": "assistant_training_dataset",
        "assistanttrainingdataset": "assistant_training_dataset",
        "numerical": "numerical_dataset",
        "categorical": "categorical_dataset",
        "timeseries": "timeseries_dataset", "time_series": "timeseries_dataset", "time-series": "timeseries_dataset",
        "image": "image_dataset",
        "video_audio": "videoaudio_dataset", "video-audio": "videoaudio_dataset",
        "text": "text_dataset",
        "mixed": "mixed_dataset",
    },
    "model_type": {
        "assistant": "assistant_model", "assistant_llm": "assistant_model", "assistant_slm": "assistant_model",
        "assistant_llm_adapter": "assistant_model", "assistant_slm_adapter": "assistant_model", "llm": "assistant_model",
        "slm": "assistant_model",
        "supervised": "supervised_model",
        "unsupervised": "unsupervised_model",
        "reinforcement": "reinforcement_model",
        "deep": "deep_learning_model", "deep_learning": "deep_learning_model", "deep-learning": "deep_learning_model",
        "transformer": "transformative_model", "transformative": "transformative_model",
        "generative": "generative_model",
        "onnx": "learning_model", "sklearn": "learning_model", "torch": "learning_model", "pytorch": "learning_model",
        "tensorflow": "learning_model",
    },
}
# ---------------------------------------------------------------------------


def with_parent(objects: DataFrame, child: DataFrame) -> DataFrame:
    """Rows of a child table with the columns of their parent object."""
    shared = [c for c in child.columns if c in objects.columns and c != "id"]
    return objects.join(child.drop(*shared), "id")


def pairs_with_parents(pairs: DataFrame, models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Inference or study rows with the names of their model and dataset."""
    return pairs.join(
        models.select(F.col("id").alias("learning_model_id"), F.col("name").alias("model_name")), "learning_model_id", "left"
    ).join(datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset_name")), "dataset_id", "left")


def dependency_report(entries: DataFrame, studies: DataFrame, inferences: DataFrame, key: str) -> DataFrame:
    """(id, linked_studies, linked_inferences, can_delete) for models or datasets.

    Links are counted before the join, so a target of a third of all links is one row in it.
    """
    links = studies.select(F.col(key).alias("id"), F.lit(1).alias("s"), F.lit(0).alias("i")).unionAll(
        inferences.select(F.col(key).alias("id"), F.lit(0).alias("s"), F.lit(1).alias("i"))
    )
    counts = links.groupBy("id").agg(F.sum("s").alias("linked_studies"), F.sum("i").alias("linked_inferences"))
    return entries.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("linked_studies", F.lit(0)).alias("linked_studies"), F.coalesce("linked_inferences", F.lit(0)).alias("linked_inferences"),
    ).withColumn("can_delete", (F.col("linked_studies") == 0) & (F.col("linked_inferences") == 0))


def lookup(entries: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, id): each key as a numeric id, else as a name. A repeated name gives its smallest id."""
    asked = keys.select(F.trim(key).alias("key")).distinct()
    by_id = entries.select(F.col("id").alias("_by_id"), F.col("id").alias("_n"))
    by_name = entries.groupBy(F.col("name").alias("_name")).agg(F.min("id").alias("_by_name"))
    return (
        asked.withColumn("_n", F.col("key").try_cast("bigint")).join(by_id, "_n", "left")
        .join(by_name, F.col("key") == F.col("_name"), "left").select("key", F.coalesce("_by_id", "_by_name").alias("id"))
    )


def canonical_type(col: Column, key: str) -> Column:
    """The accepted word of a type column; unknown words stay, trimmed and lower case."""
    word = F.lower(F.trim(col))
    accepted = F.create_map(*[F.lit(w) for pair in TYPE_ALIASES[key].items() for w in pair])
    return F.coalesce(F.try_element_at(accepted, word), word)


def repair_types(df: DataFrame, column: str, key: str | None = None) -> DataFrame:
    """The table with canonical words and a ``repaired`` flag."""
    fixed = canonical_type(F.col(column), key or column)
    return df.withColumns({column: fixed, "repaired": F.coalesce(fixed != F.col(column), F.lit(False))})


def unwrap_container(col: Column, opener: str) -> Column:
    """A JSON container that was stored as a JSON string, unwrapped; anything else as it is."""
    inner = F.from_json(F.concat(F.lit('{"v":'), col, F.lit("}")), "v STRING")["v"]
    wrapped = F.ltrim(col).startswith('"') & F.ltrim(inner).startswith(opener)
    return F.when(F.coalesce(wrapped, F.lit(False)), inner).otherwise(col)


def repair_containers(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Unwraps several columns at once; ``repaired`` counts the changed cells of a row."""
    fixed = {c: unwrap_container(F.col(c), opener) for c, opener in columns.items()}
    changed = sum((F.coalesce(fixed[c] != F.col(c), F.lit(False)).cast("int") for c in columns), F.lit(0))
    return df.withColumns({**fixed, "repaired": changed})


def coerce_json(col: Column) -> Column:
    """Container text as canonical JSON text, NULL for empty or other text."""
    text = F.trim(col)
    value = F.try_parse_json(F.when(F.substring(text, 1, 1).isin("{", "["), text))
    return F.to_json(value)


def coerce_array(col: Column) -> Column:
    """JSON array text as array<string>."""
    text = F.trim(col)
    return F.from_json(F.when(text.startswith("["), text), "array<string>")


def coerce_datetime(col: Column) -> Column:
    """ISO text, with or without an offset, as a UTC time."""
    return V.as_timestamp(col)


def compact_context(df: DataFrame, lists: Sequence[str] = (), maps: Sequence[str] = (), features: int | None = None, entries: int | None = None) -> DataFrame:
    """Features and map entries of each row (the first ones, where a number is given) with the full feature count."""
    made = {}
    for c in lists:
        made[f"{c}_count"] = F.coalesce(F.size(c), F.lit(0))
        whole = F.coalesce(c, F.array().cast(df.schema[c].dataType))
        made[c] = whole if features is None else F.slice(whole, 1, features)
    for c in maps:
        made[c] = F.col(c) if entries is None else F.map_from_entries(F.slice(F.map_entries(c), 1, entries))
    return df.withColumns(made)


def append_history(df: DataFrame, entry: Column, column: str = "history") -> DataFrame:
    """Adds one entry to the history array; a missing history starts empty."""
    return df.withColumn(column, F.concat(F.coalesce(column, F.array().cast(df.schema[column].dataType)), F.array(entry)))


def upsert_pairs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Inference pairs keyed by (model, dataset).

    Incoming parameters win key by key, other incoming values win unless NULL, and the incoming
    history entry is appended. Both sides must hold one row per pair.

    Rows are dealt out by a hash of the keys, with all their columns: a side that was dealt by its bare keys before would
    else be taken as it lies, in pieces cut by the bytes of the keys, and a task sorts far more than a piece should hold.
    """
    keys = ["learning_model_id", "dataset_id"]
    old = stored.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in ("name", "path", "version", "params", "history")])
    new = incoming.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in ("name", "path", "version", "params", "entry")])
    deal = F.xxhash64(*keys)
    joined = old.withColumn("_deal", deal).join(new.withColumn("_deal", deal), ["_deal", *keys], "full")
    empty = F.create_map().cast("map<string,string>")
    fresh, past = F.coalesce("_n_params", empty), F.coalesce("_o_params", empty)
    kept = F.map_filter(past, lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    entry = F.when(F.col("_n_entry").isNotNull(), F.array("_n_entry")).otherwise(F.array().cast("array<string>"))
    return joined.select(
        *keys, F.coalesce("_o_name", "_n_name").alias("name"), F.coalesce("_n_path", "_o_path").alias("path"),
        F.coalesce("_o_version", "_n_version", F.lit(1)).alias("version"), F.map_concat(kept, fresh).alias("params"),
        F.concat(F.coalesce("_o_history", F.array().cast("array<string>")), entry).alias("history"),
    )
