"""Queries that once did less than the whole job, against the whole question."""

from __future__ import annotations

from millrace.plans import QUERIES


def test_range_overlap_counts_whole_intervals(spark, duck, sf_dir):
    want = duck.execute(
        """
        WITH spans AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey)
        SELECT w.l_orderkey, count(*), round(sum(o.o_totalprice), 2)
        FROM spans w JOIN orders o ON o.o_orderdate BETWEEN w.first_ship AND w.last_ship GROUP BY w.l_orderkey
        """
    ).fetchall()
    got = QUERIES["sql_range_overlap"](spark, sf_dir).select("l_orderkey", "orders_inside", "value_inside").collect()
    assert len(got) == len(want) and {tuple(r)[:2] for r in got} == {r[:2] for r in want}
    value = {r[0]: r[2] for r in want}
    assert all(abs(r.value_inside - value[r.l_orderkey]) < 0.02 for r in got)
