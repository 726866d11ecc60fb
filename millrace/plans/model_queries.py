"""Model, search and monitoring queries. Fits are checked by row counts, tables by SQL."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.operators import evaluate as E
from millrace.operators import models as M
from millrace.operators import prepare as R
from millrace.operators.networks import fit_network_regressor
from millrace.plans.registry import query, table
from millrace.session import durable

_INPUTS = ["l_quantity", "l_discount", "l_tax"]


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        *_INPUTS, "l_extendedprice", "l_returnflag", "l_shipdate", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line")
    )


def _regression(spark, sf_dir, keep=()):
    lines = _lines(spark, sf_dir).withColumn("label", F.col("l_extendedprice"))
    encoding = R.fit_features(lines, _INPUTS)
    wanted = list(dict.fromkeys(["line", "label", "l_shipdate", *keep]))
    ready = encoding.assemble(lines, keep=wanted)
    return R.hash_split(ready, ["line"])


def _sides(df):
    return df.where("NOT is_test").drop("is_test"), df.where("is_test").drop("is_test")


@query("model_regression", "ML-1 ML-5 EV-1 PREP-9")
def model_regression(spark, sf_dir):
    train, test = _sides(durable(_regression(spark, sf_dir).select("features", "label", "is_test")))  # every fit and every score reads them
    out = None
    for kind, params in (("LinearRegression", {}), ("Ridge", {}), ("RandomForestRegressor", {}), ("GradientBoostingRegressor", {})):
        found = M.fit_regressor(train, kind, **params)
        scores = E.evaluate(M.predict(found, test), "label", "prediction", "regression", "eval_").select(F.lit(kind).alias("model"), "metric", "value")
        out = scores if out is None else out.unionByName(scores)
    return out


@query(
    "model_line",
    "ML-1 ML-5 EV-1",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem),
    e AS (SELECT avg((l_extendedprice - a - b * l_quantity) ** 2) AS mse, avg(abs(l_extendedprice - a - b * l_quantity)) AS mae FROM lineitem, f)
    SELECT 'slope' AS metric, round(b, 3) AS value FROM f UNION ALL SELECT 'intercept', round(a, 3) FROM f UNION ALL SELECT 'r2', round(r2, 3) FROM f
    UNION ALL SELECT 'mse', round(mse / 1000, 3) FROM e UNION ALL SELECT 'rmse', round(sqrt(mse), 3) FROM e UNION ALL SELECT 'mae', round(mae, 3) FROM e""",
)
def model_line(spark, sf_dir):
    """Price by quantity: coefficients and metrics of a fit with one input, mse in thousands."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label"))
    rows = R.fit_features(lines, ["l_quantity"]).assemble(lines, keep=["label"])
    found = M.fit_regressor(rows)
    line = spark.createDataFrame([("slope", float(found.model.coefficients[0])), ("intercept", float(found.model.intercept))], "metric string, value double")
    scores = E.evaluate(M.predict(found, rows), "label", "prediction", "regression").where(F.col("metric").isin("r2", "mse", "rmse", "mae")).select("metric", "value")
    scaled = F.when(F.col("metric") == "mse", F.col("value") / 1000).otherwise(F.col("value"))
    return line.unionByName(scores).select("metric", F.round(scaled, 3).alias("value"))


def _classes(spark, sf_dir):
    """Return flag of a line as a class code."""
    lines = R.encode_class(_lines(spark, sf_dir), "l_returnflag", "code").withColumn("label", F.col("code").cast("double"))
    encoding = R.fit_features(lines, [*_INPUTS, "l_extendedprice"])
    return encoding.assemble(lines, keep=["line", "label", "l_returnflag"])


@query("model_classification", "ML-2 ML-5 EV-2 PREP-10")
def model_classification(spark, sf_dir):
    train, test = _sides(R.stratified_split(_classes(spark, sf_dir), "l_returnflag", ["line"]))
    found = M.fit_classifier(train, "LogisticRegression", classes=3)
    return E.evaluate(M.predict(found, test), "label", "prediction", "classification", "eval_")


@query("model_probabilities", "ML-6")
def model_probabilities(spark, sf_dir):
    """The two likeliest return flags of every line."""
    rows = _classes(spark, sf_dir)
    found = M.fit_classifier(rows, "RandomForestClassifier", classes=3)
    labels = R.category_codes(table(spark, sf_dir, "lineitem"), "l_returnflag")
    return M.class_probabilities(found.transform(rows), "line", labels, top=2)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )


@query("model_clusters", "ML-3")
def model_clusters(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    found = M.fit_unsupervised(rows, "outlier", clusters=10, share=0.95)
    return M.flag_outliers(found, rows).select("vec_id", "prediction", "distance", "is_outlier")


@query("model_cluster_distances", "ML-3", "SELECT vec_id, true AS nearest, true AS measured FROM embeddings")
def model_cluster_distances(spark, sf_dir):
    """Every vector lies in the cluster of its nearest centre, at the distance stated."""
    rows = _vectors(spark, sf_dir)
    found = M.fit_unsupervised(rows, "clustering", clusters=10)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in found.model.clusterCenters()])
    gaps = F.transform(centres, lambda c: F.sqrt(F.aggregate(F.zip_with(M.vector_to_array("features"), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)))
    scored = M.centre_distance(found, found.transform(rows)).withColumn("gaps", gaps)
    return scored.select("vec_id", (F.abs(F.array_min("gaps") - F.get("gaps", F.col("prediction"))) < 1e-9).alias("nearest"), (F.abs(F.array_min("gaps") - F.col("distance")) < 1e-9).alias("measured"))


@query(
    "model_probability_sums",
    "ML-6",
    """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS line, count(*) * 3 AS places, true AS whole, true AS falling, true AS known FROM lineitem GROUP BY 1""",
)
def model_probability_sums(spark, sf_dir):
    """Chances of all classes of a line add up to one, fall from place to place and carry known labels."""
    lines = _classes(spark, sf_dir)
    found = M.fit_classifier(lines, "LogisticRegression", classes=3)
    labels = R.category_codes(table(spark, sf_dir, "lineitem"), "l_returnflag")
    rows = M.class_probabilities(found.transform(lines), "line", labels)
    best = F.max(F.when(F.col("place") == 1, F.col("probability")))
    last = F.min(F.when(F.col("place") == 3, F.col("probability")))
    return rows.groupBy("line").agg(
        F.count(F.lit(1)).alias("places"), (F.abs(F.sum("probability") * 3 / F.count(F.lit(1)) - 1) < 1e-9).alias("whole"),
        (best >= last).alias("falling"), F.bool_and(F.col("label").isin("A", "N", "R")).alias("known"),
    )


@query("model_projection", "ML-3 ML-7")
def model_projection(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    scaled = M.fit_unsupervised(rows, "scaling").transform(rows).select("vec_id", F.col("output").alias("features"))
    shown = M.fit_unsupervised(scaled, "projection", components=2).transform(scaled)
    cells = M.vector_to_array("output")
    return E.output_summary(shown.select(cells[0].alias("x"), cells[1].alias("y")), ["x", "y"])


@query("model_network", "ML-4")
def model_network(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return M.loss_history(spark, M.fit_network(rows, [64, 16, 10]))


@query(
    "model_network_regression",
    "ML-4",
    """SELECT 30 AS epochs, true AS loss_falls, true AS beats_line, count(*) AS scored FROM lineitem""",
)
def model_network_regression(spark, sf_dir):
    """A network for the price of a line times its tax: loss per epoch falls, error below that of a straight line; every line is scored."""
    lines = table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_quantity") * F.col("l_discount") * F.col("l_tax"))
    ready = durable(VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(lines).select("features", "label"))
    network, line = fit_network_regressor(ready, (12,), epochs=30, step=0.08, merge=False), M.fit_regressor(ready, "LinearRegression")
    losses = network.details["loss"]
    scored = network.transform(ready).withColumnRenamed("prediction", "p")
    miss = lambda c: F.avg((F.col("label") - F.col(c)) ** 2)
    both = line.transform(scored).agg(miss("p").alias("n"), miss("prediction").alias("l"), F.count("p").alias("scored"))
    return both.select(F.lit(len(losses)).alias("epochs"), F.lit(losses[-1] < losses[0]).alias("loss_falls"), (F.col("n") < F.col("l")).alias("beats_line"), "scored")


@query("model_outputs", "ML-8 PREP-8")
def model_outputs(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    ready = R.fit_features(lines, _INPUTS).assemble(lines, keep=["line", "l_extendedprice", "net"])
    found = M.fit_outputs(ready, ["l_extendedprice", "net"], "LinearRegression", "regression")
    return M.predict_outputs(found, ready, ["line"])


@query(
    "model_output_lines",
    "ML-8 PREP-8",
    """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b1, regr_intercept(l_extendedprice, l_quantity) AS a1,
      regr_slope(l_extendedprice * (1 - l_discount), l_quantity) AS b2, regr_intercept(l_extendedprice * (1 - l_discount), l_quantity) AS a2 FROM lineitem)
    SELECT l_quantity, count(*) AS n, round(a1 + b1 * l_quantity, 3) AS price_prediction, round(a2 + b2 * l_quantity, 3) AS net_prediction
    FROM lineitem, f GROUP BY l_quantity, a1, b1, a2, b2""",
)
def model_output_lines(spark, sf_dir):
    """Price and net price, a model each, over one input: predictions are those of two straight lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    ready = durable(R.fit_features(lines, ["l_quantity"]).assemble(lines, keep=["l_quantity", "price", "net"]))
    found = M.fit_outputs(ready, ["price", "net"], "LinearRegression", "regression")
    rows = M.predict_outputs(found, ready, ["l_quantity"]).groupBy("l_quantity")
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in ("price_prediction", "net_prediction")])


@query(
    "model_boosted_classes",
    "ML-2 ML-5 EV-2",
    """SELECT least(CAST(floor(l_quantity / 20) AS INTEGER), 2) AS code, count(*) AS n, true AS mostly_right, true AS two_classes_right FROM lineitem GROUP BY 1""",
)
def model_boosted_classes(spark, sf_dir):
    """Gradient boosting, for three classes one against the rest and for two: the ranges of a column are found again."""
    lines = table(spark, sf_dir, "lineitem").withColumn("code", F.least(F.floor(F.col("l_quantity") / 20), F.lit(2)).cast("int"))
    made = VectorAssembler(inputCols=["l_quantity", "l_tax"], outputCol="features").transform(lines.withColumn("label", F.col("code").cast("double")))
    ready = durable(made.select("features", "label", "code"))
    three = M.fit_classifier(ready, "GradientBoostingClassifier", classes=3, max_depth=2, n_estimators=3)
    two = M.fit_classifier(ready.withColumn("label", (F.col("code") > 0).cast("double")), "GradientBoostingClassifier", max_depth=2, n_estimators=3)
    scored = M.predict(three, ready).withColumnRenamed("prediction", "p").drop("rawPrediction", "probability")
    both = M.predict(two, scored)
    return both.groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("p") == F.col("code")).cast("int")) > 0.8).alias("mostly_right"),
        (F.avg((F.col("prediction") == (F.col("code") > 0).cast("int")).cast("int")) > 0.8).alias("two_classes_right"),
    )


@query(
    "model_draws",
    "HP-1",
    """SELECT count(*) AS trials, count(*) AS inside, 8 AS hidden_dim, 4 AS hidden_layers, 5 AS dropout, 3 AS batch_size FROM orders""",
)
def model_draws(spark, sf_dir):
    """One trial per order from the default network space: every draw inside its bounds, every grid point reached."""
    drawn = M.draw_trials(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", M.SEARCH_SPACES["network"])
    inside = (
        F.col("hidden_dim").isin(*range(16, 129, 16)) & F.col("hidden_layers").isin(1, 2, 3, 4) & F.col("dropout").isin(0.0, 0.1, 0.2, 0.3, 0.4)
        & F.col("learning_rate").between(0.0005, 0.01) & F.col("batch_size").isin(16, 32, 64)
    )
    return drawn.agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(inside).alias("inside"),
        *[F.count_distinct(c).cast("int").alias(c) for c in ("hidden_dim", "hidden_layers", "dropout", "batch_size")],
    )


@query("model_search", "HP-2")
def model_search(spark, sf_dir):
    """Fifteen trials of the default space, halved after rounds on 4 % and 20 % of the training rows."""
    train, test = _sides(_regression(spark, sf_dir))
    train, test = durable(train), durable(test)  # every trial reads both
    return M.run_search(train, test, "regression", shares=(0.04, 0.2))


def _studies(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "PRUNED").otherwise("FAIL")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), (F.col("o_custkey") % 40).cast("string")).alias("study_name"), F.col("o_orderkey").alias("number"),
        F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("params"), state.alias("state"),
    )


_STUDIES = """t AS (SELECT 's' || (o_custkey % 40) AS study_name, o_orderkey AS number, o_totalprice AS value, o_orderpriority AS params,
    CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'PRUNED' ELSE 'FAIL' END AS state FROM orders)"""


@query(
    "model_study_summary",
    "HP-3",
    f"""WITH {_STUDIES} SELECT study_name, count(*) AS n_trials, count(*) FILTER (WHERE state = 'COMPLETE') AS completed_trials,
        count(*) FILTER (WHERE state = 'PRUNED') AS pruned_trials, count(*) FILTER (WHERE state = 'FAIL') AS failed_trials,
        min(value) FILTER (WHERE state = 'COMPLETE') AS best_value, arg_min(params, (value, number)) FILTER (WHERE state = 'COMPLETE') AS best_params,
        true AS has_best_trial FROM t GROUP BY study_name""",
)
def model_study_summary(spark, sf_dir):
    return M.study_summary(_studies(spark, sf_dir))


@query(
    "model_best_so_far",
    "HP-4",
    f"""WITH {_STUDIES} SELECT study_name, number, max(CASE WHEN state = 'COMPLETE' THEN value END) OVER (PARTITION BY study_name ORDER BY number) AS best_so_far FROM t""",
)
def model_best_so_far(spark, sf_dir):
    return M.best_so_far(_studies(spark, sf_dir), minimise=False).select("study_name", "number", "best_so_far")


def _watched(spark, sf_dir):
    rows = _regression(spark, sf_dir, keep=_INPUTS)
    day = F.lit("1999-01-01").cast("timestamp_ntz")
    before = rows.where(F.col("l_shipdate") < day)
    after = rows.where(F.col("l_shipdate") >= day).withColumn("l_quantity", F.col("l_quantity") + 2)
    return before.drop("l_shipdate"), after.drop("l_shipdate")


@query("model_monitoring", "DR-7")
def model_monitoring(spark, sf_dir):
    before, after = _watched(spark, sf_dir)
    shot = M.monitoring_snapshot(M.fit_regressor(before.where("NOT is_test")), before, after, _INPUTS)
    return shot.summary


@query("model_retraining", "DR-8")
def model_retraining(spark, sf_dir):
    before, after = _watched(spark, sf_dir)
    return M.monitor_and_retrain(M.fit_regressor(before), before, after, _INPUTS)[1]
