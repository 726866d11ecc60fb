"""Canonical scalars: their steps are computed once, their forms are as stated."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.values import canonical_scalar

FORMS = {
    None: "", " ": "", "0.0": "0", "-0": "0", "1d": "1d", "1e3": "1000", "1e400": "1e400", "NaN": "NaN", " TRUE": "true", "0.30000000000000004": "0.3", "12e-9": "0.000000012",
    "1234567.123456789": "1234567.12346", "1e18": "1000000000000000000", "7\t": "7", "abc": "abc",
}


def test_forms_and_size(spark):
    made = spark.createDataFrame([(v,) for v in FORMS], "v string").select("v", canonical_scalar(F.col("v")).alias("c"))
    assert {r["v"]: r["c"] for r in made.collect()} == FORMS
    # The number is read in one place, not once in every branch that uses it.
    assert made._jdf.queryExecution().analyzed().toString().count("RLIKE") == 1
