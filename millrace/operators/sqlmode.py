"""SQL feature mode: one SELECT over ``source_dataset`` and, if given, ``secondary_dataset``.

The statement is guarded on the driver, then handed to Spark SQL as it is.
"""

from __future__ import annotations

import hashlib
import re
import threading

from pyspark.sql import DataFrame, SparkSession, functions as F

# Relation names and words that may not appear outside strings and comments.
SOURCE, SECONDARY = "source_dataset", "secondary_dataset"
BLOCKED = (
    "ALTER", "CALL", "COPY", "CREATE", "DELETE", "DO", "DROP", "EXEC", "EXECUTE", "GRANT",
    "INSERT", "MERGE", "REINDEX", "REVOKE", "TRUNCATE", "UPDATE", "VACUUM",
)
# Functions that leave the query.
REFLECTION = ("REFLECT", "TRY_REFLECT", "JAVA_METHOD")
_VIEWS = threading.Lock()
_HIDDEN = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)


def guard(statement: str) -> str:
    """The trimmed statement, or ValueError saying why it is refused."""
    if not statement.strip():
        raise ValueError("A SQL query is required.")
    visible = _HIDDEN.sub(lambda m: "''" if m.group()[0] in "'\"" else " ", statement)
    if len([part for part in visible.split(";") if part.strip()]) != 1:
        raise ValueError("Exactly one statement is accepted.")
    words = [w.upper() for w in re.findall(r"[A-Za-z_]\w*", visible)]
    if not words or words[0] not in {"SELECT", "WITH"}:
        raise ValueError("Only SELECT or WITH queries are accepted.")
    blocked = sorted({*BLOCKED, *REFLECTION} & set(words))
    if blocked:
        raise ValueError(f"Not allowed: {', '.join(blocked)}.")
    if SOURCE.upper() not in words:
        raise ValueError(f"The query must reference {SOURCE}.")
    return statement.strip().rstrip(";").strip()


def fingerprint(statement: str) -> str:
    return hashlib.sha256(statement.encode("utf-8")).hexdigest()[:12]


def relations(spark: SparkSession, statement: str) -> set[str]:
    """Names of the tables that a statement reads, without those that it defines itself, from Spark's parsed plan."""
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement).toString()
    read = {n.replace(", ", ".").lower() for n in re.findall(r"UnresolvedRelation \[([^\]]*)\]", tree)}
    own = {n.lower() for names in re.findall(r"CTE \[([^\]]*)\]", tree) for n in names.split(", ")}
    return read - own


def run_sql(
    statement: str, source: DataFrame, secondary: DataFrame | None = None, preview_rows: int | None = None
) -> DataFrame:
    """The lazy result of a guarded statement; a preview limit is pushed down by Spark.

    Only the two relations can be read: the parsed plan must name no other table or view of the session. The
    statement is analysed while the two views exist, so they can go right after; views of these names that
    the user had are put back. Files cannot be named as tables meanwhile.
    """
    text = guard(statement)
    spark = source.sparkSession
    others = sorted(relations(spark, text) - {SOURCE, *([SECONDARY] if secondary is not None else [])})
    if others:
        raise ValueError(f"Not available: {', '.join(others)}.")
    with _VIEWS:
        own = {t.name for t in spark.catalog.listTables() if t.isTemporary}
        before = {name: spark.table(name) for name in (SOURCE, SECONDARY) if name in own}
        by_path = spark.conf.get("spark.sql.runSQLOnFiles", "true")
        spark.conf.set("spark.sql.runSQLOnFiles", "false")
        source.createOrReplaceTempView(SOURCE)
        if secondary is not None:
            secondary.createOrReplaceTempView(SECONDARY)
        try:
            result = spark.sql(text)
        finally:
            spark.conf.set("spark.sql.runSQLOnFiles", by_path)
            for name in (SOURCE, SECONDARY):
                spark.catalog.dropTempView(name)
                if name in before:
                    before[name].createOrReplaceTempView(name)
    return result.limit(preview_rows) if preview_rows else result


def lineage_row(statement: str, source: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """One row for the dataset history: mode, relations and query hash."""
    text = guard(statement)
    return source.sparkSession.range(1).select(
        F.lit("sql").alias("mode"), F.lit(SOURCE).alias("source_relation"),
        F.lit(SECONDARY if secondary is not None else None).cast("string").alias("secondary_relation"),
        F.lit(text).alias("sql_query"), F.substring(F.sha2(F.lit(text), 256), 1, 12).alias("sql_hash"),
    )
