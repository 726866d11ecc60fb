"""SQL mode reads its two relations and nothing else of the session."""

from __future__ import annotations

import pytest

from millrace.operators.sqlmode import guard, relations, run_sql


@pytest.fixture
def frames(spark):
    spark.range(3).createOrReplaceTempView("other_view")
    yield spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string"), spark.createDataFrame([(1, 5)], "id long, q int")
    spark.catalog.dropTempView("other_view")


@pytest.mark.parametrize("statement", [
    "SELECT p FROM source_dataset JOIN other_view ON true",
    "SELECT p FROM source_dataset WHERE id IN (SELECT id FROM other_view)",
    "SELECT (SELECT max(id) FROM other_view) AS m FROM source_dataset",
    "WITH x AS (SELECT * FROM other_view) SELECT p FROM source_dataset, x",
    "SELECT p FROM source_dataset UNION ALL SELECT CAST(id AS STRING) FROM `other_view`",
    "SELECT p FROM source_dataset, parquet.`/tmp/x`",
    "SELECT p FROM source_dataset WHERE EXISTS (SELECT 1 FROM default.other_table)",
])
def test_other_tables_are_refused(frames, statement):
    with pytest.raises(ValueError, match="Not available"):
        run_sql(statement, *frames)


def test_second_relation_only_if_given(frames):
    with pytest.raises(ValueError, match="secondary_dataset"):
        run_sql("SELECT * FROM source_dataset JOIN secondary_dataset USING (id)", frames[0])
    assert run_sql("SELECT q FROM source_dataset JOIN secondary_dataset USING (id)", *frames).first().q == 5


def test_own_names_and_strings(frames):
    rows = run_sql('WITH a AS (SELECT * FROM Source_Dataset), b AS (SELECT * FROM a WHERE p <> "drop; delete") SELECT b.p FROM b JOIN a USING (id)', frames[0])
    assert sorted(r.p for r in rows.collect()) == ["a", "b"]
    nested = "SELECT * FROM (WITH c AS (SELECT id FROM source_dataset) SELECT * FROM c) t JOIN LATERAL (SELECT explode(array(1, 2)) AS e)"
    assert run_sql(nested, frames[0]).count() == 4
    assert run_sql("SELECT s.id FROM source_dataset s, range(2)", frames[0]).count() == 4
    with pytest.raises(ValueError, match="DROP"):
        guard('SELECT "x" FROM source_dataset; DROP TABLE t'.replace(";", " "))


def test_relations(spark):
    assert relations(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a JOIN source_dataset s ON s.x IN (SELECT y FROM b.c)") == {"source_dataset", "b.c"}
