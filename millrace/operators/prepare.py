"""Training-set preparation: task, feature encoding, target encoding, splits."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F, types as T, Window

from millrace.functions import values as V
from millrace.operators.distribution import exact_quantiles
from millrace.operators.ordered import positions
from millrace.session import durable

# Defaults and thresholds of preparation.
TEST_SIZE, SEED = 0.2, 42
PARSE_SHARE = 0.8
CLASS_METRICS = ("accuracy", "precision", "recall", "f1")
REGRESSION_METRICS = ("rmse", "mse", "mae", "r2")
# A split counts hashes by this many bits at a time until a range holds few rows; beyond this many classes it joins by shuffle.
RANGE_BITS, RANGE_ROWS, BROADCAST_CLASSES = 10, 10_000, 100_000


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def infer_task(df: DataFrame, target: str, explicit: str | None = None, metrics: Sequence[str] = ()) -> DataFrame:
    """One row (task, reason, rows, distinct_values): classification or regression."""
    known = {m.lower() for m in metrics}
    dtype = df.schema[target].dataType
    counted = df.where(_c(target).isNotNull()).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(_c(target)).alias("distinct_values"))
    limit = F.greatest(F.lit(10), F.floor(F.col("rows") * 0.05))
    few = (F.col("rows") > 0) & (F.col("distinct_values") <= limit)
    if explicit:
        task, reason = F.lit(explicit.strip().lower()), "explicit"
    elif known & set(CLASS_METRICS):
        task, reason = F.lit("classification"), "metrics"
    elif known & set(REGRESSION_METRICS):
        task, reason = F.lit("regression"), "metrics"
    elif isinstance(dtype, (T.BooleanType, T.StringType)):
        task, reason = F.lit("classification"), "type"
    elif isinstance(dtype, T.IntegralType):
        task, reason = F.when(few, "classification").otherwise("regression"), "distinct values"
    else:
        task, reason = F.lit("regression"), "type"
    return counted.select(task.alias("task"), F.lit(reason).alias("reason"), "rows", "distinct_values")


def infer_task_by_values(df: DataFrame, target: str) -> DataFrame:
    """The second rule: a target of whole numbers with few distinct values is a class."""
    if isinstance(df.schema[target].dataType, (T.BooleanType, T.StringType)):
        return df.agg(F.lit("classification").alias("task"), F.count(F.lit(1)).alias("rows"), F.count_distinct(_c(target)).alias("distinct_values"))
    number = V.as_double(_c(target), df.schema[target].dataType)
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(number).alias("distinct_values"),
        F.coalesce(F.sum((number != F.floor(number)).cast("bigint")), F.lit(0)).alias("broken"),
    )
    few = (F.col("rows") > 0) & (F.col("broken") == 0) & (F.col("distinct_values") <= F.greatest(F.lit(20), F.floor(F.col("rows") * 0.05)))
    return counted.select(F.when(few, "classification").otherwise("regression").alias("task"), "rows", "distinct_values")


@dataclass
class FeatureEncoding:
    """What was learnt from the training table, applied alike to any table.

    ``codes`` holds for every category column a written table (value, code) and the number of values. A
    column takes one position per value and one for missing cells; a value never seen fills none.
    """

    numeric: dict[str, float] = field(default_factory=dict)
    times: dict[str, float] = field(default_factory=dict)
    codes: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)

    def _numbers(self, df: DataFrame) -> list[tuple[str, Column]]:
        plain = [(c, F.coalesce(V.as_double(_c(c), df.schema[c].dataType), F.lit(mean))) for c, mean in self.numeric.items()]
        moments = [(c, F.coalesce(V.epoch_seconds(V.as_timestamp(_c(c), df.schema[c].dataType)), F.lit(mean))) for c, mean in self.times.items()]
        return plain + moments

    def _coded(self, df: DataFrame) -> DataFrame:
        """Adds ``_code_<column>``: code, then the number of values for missing cells, then one more for unseen values."""
        for c, (codes, size) in self.codes.items():
            known = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
            code = F.when(_c(c).isNull(), F.lit(size)).otherwise(F.coalesce("_code", F.lit(size + 1))).cast("double")
            df = df.join(F.broadcast(known) if size <= BROADCAST_CLASSES else known, _c(c) == F.col("_value"), "left").withColumn(f"_code_{c}", code).drop("_value", "_code")
        return df

    def transform(self, df: DataFrame, keep: Sequence[str] = (), max_columns: int = 1_000) -> DataFrame:
        """Double columns only: imputed numbers, epoch seconds and one column per category.

        The category names become column names; more than ``max_columns`` of them are an error, and
        ``assemble`` is the form for those.
        """
        count = sum(size + 1 for _, size in self.codes.values())
        if count > max_columns:
            raise ValueError(f"{count} category columns; up to {max_columns} are allowed here, assemble takes any number.")
        out: list[Column] = [_c(c) for c in keep]
        out += [value.alias(c) for c, value in self._numbers(df)]
        for c, (codes, _) in self.codes.items():
            values = [r["value"] for r in codes.orderBy("code").collect()]
            out += [F.coalesce((_c(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for v in values]
            out.append(_c(c).isNull().cast("double").alias(f"{c}_nan"))
        return df.select(*out)

    def entries(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """(keep, position, value): the non-zero positions of ``assemble``, as rows."""
        parts, place = [], 0
        for _, value in self._numbers(df):
            parts.append(F.struct(F.lit(place).cast("bigint").alias("position"), value.alias("value")))
            place += 1
        for c, (_, size) in self.codes.items():
            code = F.col(f"_code_{c}")
            spot = F.struct((code + place).cast("bigint").alias("position"), F.lit(1.0).alias("value"))
            parts.append(F.when(code <= size, spot))
            place += size + 1
        rows = self._coded(df).select(*[_c(c) for c in keep], F.explode(F.array_compact(F.array(*parts))).alias("_e"))
        return rows.select(*[_c(c) for c in keep], "_e.*").where("value <> 0")

    def assemble(self, df: DataFrame, keep: Sequence[str] = (), output: str = "features") -> DataFrame:
        """``keep`` and one vector column: numbers, times, then one sparse block per category column."""
        numbers = self._numbers(df)
        sized = [
            F.col(f"_code_{c}").alias(f"_code_{c}", metadata={"ml_attr": {"type": "nominal", "num_vals": size + 1}})
            for c, (_, size) in self.codes.items()
        ]
        plain = self._coded(df).select(*[_c(c) for c in keep], *[value.alias(f"_f_{c}") for c, value in numbers], *sized)
        blocks = [f"_hot_{c}" for c in self.codes]
        if blocks:
            # The sizes come with the columns, so nothing is learnt here; the last category is "unseen" and is dropped.
            encoder = OneHotEncoder(inputCols=[f"_code_{c}" for c in self.codes], outputCols=blocks, handleInvalid="keep", dropLast=True)
            plain = encoder.fit(plain).transform(plain)
        return VectorAssembler(inputCols=[*[f"_f_{c}" for c, _ in numbers], *blocks], outputCol=output).transform(plain).select(*keep, output)


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values in sorted order, numbered from 0 without a single-task sort."""
    values = df.where(_c(column).isNotNull()).select(_c(column).alias("value")).distinct()
    return positions(values, [], ["value"], "p").select("value", (F.col("p") - 1).alias("code"))


def fit_features(df: DataFrame, columns: Sequence[str]) -> FeatureEncoding:
    """Learn the encoding. One row of statistics and the number of categories reach the driver."""
    types = {c: df.schema[c].dataType for c in columns}
    texts = [c for c in columns if isinstance(types[c], T.StringType)]
    numbers = [c for c in columns if V.is_numeric(types[c])]
    clocks = [c for c in columns if V.is_datetime(types[c])]
    parts = [F.lit(1).alias("_one")]
    for c in numbers:
        parts.append(F.avg(V.as_double(_c(c), types[c])).alias(f"mean:{c}"))
    for c in clocks + texts:
        moment = V.as_timestamp(_c(c), types[c])
        parts += [F.avg(V.epoch_seconds(moment)).alias(f"mean:{c}"), F.avg(moment.isNotNull().cast("double")).alias(f"share:{c}")]
    stats = df.agg(*parts).first()
    found = FeatureEncoding()
    found.numeric = {c: stats[f"mean:{c}"] if stats[f"mean:{c}"] is not None else 0.0 for c in numbers}
    parsed = [c for c in clocks + texts if c in clocks or (stats[f"share:{c}"] or 0.0) >= PARSE_SHARE]
    found.times = {c: stats[f"mean:{c}"] if stats[f"mean:{c}"] is not None else 0.0 for c in parsed}
    for c in texts:
        if c not in parsed:
            codes = durable(category_codes(df, c))
            found.codes[c] = (codes, codes.count())
    return found


def encode_class(df: DataFrame, column: str, output: str) -> DataFrame:
    """Class code in sorted label order, -1 for a missing label.

    Up to ``BROADCAST_CLASSES`` codes are sent to the rows, so that a class of any size is not gathered in one task.
    """
    codes = durable(category_codes(df, column)).select(F.col("value").alias("_value"), F.col("code").cast("int").alias(output))
    if codes.count() <= BROADCAST_CLASSES:
        codes = F.broadcast(codes)
    joined = df.join(codes, _c(column) == F.col("_value"), "left").drop("_value")
    return joined.withColumn(output, F.coalesce(output, F.lit(-1)))


def encode_numbers(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Numeric targets: unreadable cells take the median of their column, 0 if it has none."""
    typed = df.withColumns({out: V.as_double(_c(c), df.schema[c].dataType) for c, out in columns.items()})
    medians = exact_quantiles(typed, list(columns.values()), [0.5])
    return typed.withColumns({
        out: F.coalesce(F.col(out), medians.where(F.col("column") == out).select("value").scalar(), F.lit(0.0))
        for out in columns.values()
    })


def encode_targets(df: DataFrame, columns: Sequence[str], task: str) -> DataFrame:
    """Several outputs, each by the rule of the task, as ``<column>_encoded``."""
    names = {c: f"{c}_encoded" for c in columns}
    if task != "classification":
        return encode_numbers(df, names)
    out = df
    for c, name in names.items():
        out = encode_class(out, c, name)
    return out


def check_test_size(value: Any) -> float:
    try:
        size = float(value)
    except (TypeError, ValueError):
        return TEST_SIZE
    if not 0 < size < 1 or math.isnan(size):
        raise ValueError("test_size must lie between 0 and 1.")
    return size


def hash_split(df: DataFrame, key: Sequence[str], test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Adds ``is_test``. A row's side depends only on its key and the seed, never on partitioning."""
    size = check_test_size(test_size)
    text = F.concat_ws("\u0001", F.lit(str(seed)), *[F.coalesce(_c(k).cast("string"), F.lit("\\N")) for k in key])
    share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return df.withColumn("is_test", share < size)


def can_stratify(df: DataFrame, label: str) -> DataFrame:
    """One row: more than one class, and no class of a single row."""
    sizes = df.groupBy(_c(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest")).withColumn(
        "stratified", (F.col("classes") > 1) & (F.col("smallest") > 1)
    )


def _class_cuts(rows: DataFrame, key: Sequence[str], size: float) -> DataFrame:
    """(_l, _cut): per class the (hash, key) of its last test row.

    Counts by leading bits of the hash name the one range in which a class reaches its number. That range alone is
    counted by its next bits, until it holds few rows, which are then put in order. Each count reads class, hash and key only.
    """
    names, spark = [f"_k{i}" for i in range(len(key))], rows.sparkSession
    slim = rows.select("_l", "_h", *[_c(k).alias(n) for k, n in zip(key, names)])
    by_class = Window.partitionBy("_l")
    inside, bits = slim.withColumn("_need", F.lit(None).cast("bigint")), 0
    while True:
        bits += RANGE_BITS
        counts = inside.groupBy("_l", F.shiftright("_h", 64 - bits).alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.max("_need").alias("_need"))
        total = F.coalesce("_need", F.ceil(F.sum("_n").over(by_class) * F.lit(size)))
        upto = F.sum("_n").over(by_class.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
        placed = counts.withColumns({"_need": total, "_upto": upto})
        reached = placed.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_n") < F.col("_need")))
        ranges = durable(reached.select("_l", "_p", "_n", (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_need")))
        facts = ranges.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.max("_n"), F.lit(0)).alias("largest")).first()
        few = facts["classes"] <= BROADCAST_CLASSES
        ranges = ranges.select("_l", "_p", "_need")
        inside = slim.withColumn("_p", F.shiftright("_h", 64 - bits)).join(F.broadcast(ranges) if few else ranges, ["_l", "_p"])
        if facts["largest"] <= RANGE_ROWS or bits + RANGE_BITS > 64:
            break
    point = F.struct("_h", *names)
    counts = inside.groupBy("_l", point.alias("_cut")).agg(F.count(F.lit(1)).alias("_n"), F.max("_need").alias("_need"))
    upto = counts.withColumn("_upto", F.sum("_n").over(by_class.orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)))
    cuts = durable(upto.where(F.col("_upto") >= F.col("_need")).groupBy("_l").agg(F.min("_cut").alias("_cut")))
    return F.broadcast(cuts) if few else cuts


def stratified_split(df: DataFrame, label: str, key: Sequence[str], test_size: float = TEST_SIZE, seed: int = SEED) -> DataFrame:
    """Adds ``is_test`` with exactly ceil(test_size * n) test rows in every class, the ones with the smallest hashes.

    ``key`` names each row; rows that share a key lie on one side, so a class with such rows may hold more test rows.
    One (hash, key) per class decides, found by counting hashes: the table itself is neither shuffled nor sorted while
    there are at most ``BROADCAST_CLASSES`` classes. Missing labels are a class.
    """
    size = check_test_size(test_size)
    hashed = df.withColumns({"_h": F.xxhash64(*[_c(k) for k in key], F.lit(seed)), "_l": F.coalesce(_c(label).cast("string"), F.lit("\u0000"))})
    cuts = _class_cuts(hashed, key, size)
    own = F.struct(F.col("_h"), *[_c(k).alias(f"_k{i}") for i, k in enumerate(key)])
    return hashed.join(cuts, "_l", "left").select(*[_c(c) for c in df.columns], F.coalesce(own <= F.col("_cut"), F.lit(False)).alias("is_test"))


def preflight(
    df: DataFrame, inputs: Sequence[str] = (), outputs: Sequence[str] = (), unsupervised: bool = False
) -> DataFrame:
    """Schema check before training, one row. Outputs never remain among the inputs."""
    available = df.columns
    chosen = list(outputs) or ([] if unsupervised else available[-1:])
    features = [c for c in (list(inputs) or available) if c not in chosen]
    missing = [c for c in [*features, *chosen] if c not in available]
    recommended = None if unsupervised else available[-1]
    facts = {
        "ok": not missing, "input_features": ",".join(features), "output_features": ",".join(chosen),
        "missing_columns": ",".join(missing), "recommended_output": recommended,
        "recommended_inputs": ",".join(c for c in available if c != recommended),
    }
    return df.sparkSession.range(1).select(*[(F.lit(v) if not isinstance(v, (str, type(None))) else F.lit(v).cast("string")).alias(k) for k, v in facts.items()])
