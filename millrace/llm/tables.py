"""Reading inputs and keeping intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import scratch_path, table_path
from millrace.sources.readers import spread_rows


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; one that comes in fewer pieces than task slots is spread."""
    return spread_rows(spark.read.parquet(table_path(sf_dir, name)))


def saved(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared scratch folder and read back: lineage ends here."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: Iterable[str], wish: str) -> str:
    """``wish``, lengthened until no column of the table has that name."""
    names = {c.lower() for c in taken}
    while wish.lower() in names:
        wish += "_"
    return wish
