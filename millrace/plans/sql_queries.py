"""SQL feature mode: one query per area of the surface a submitted SELECT can reach.

Each statement names only ``source_dataset`` and ``secondary_dataset``; the check runs the same
question over the base tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators.sqlmode import lineage_row, run_sql
from millrace.operators.intervals import overlap_join
from millrace.operators.ordered import carry_last, running_totals
from millrace.plans.registry import query, table


def _register(name: str, covers: str, source: str, statement: str, secondary: str | None = None, check: str | None = None):
    """The same text is the check where both dialects agree."""
    base = check or statement
    sql = base.replace("source_dataset", source) if check is None else base
    if secondary and check is None:
        sql = sql.replace("secondary_dataset", secondary)

    @query(name, covers, sql)
    def run(spark, sf_dir):
        other = table(spark, sf_dir, secondary) if secondary else None
        return run_sql(statement, table(spark, sf_dir, source), other)

    return run


_register(
    "sql_joins", "SQL-2 SQL-10", "customer",
    """
    SELECT 'inner' AS kind, count(*) AS n, count(s.c_custkey) AS lefts, count(o.o_orderkey) AS rights
    FROM source_dataset s JOIN secondary_dataset o ON s.c_custkey = o.o_custkey AND o.o_totalprice > 400000
    UNION ALL SELECT 'left', count(*), count(s.c_custkey), count(o.o_orderkey)
    FROM source_dataset s LEFT JOIN secondary_dataset o ON s.c_custkey = o.o_custkey AND o.o_totalprice > 400000
    UNION ALL SELECT 'right', count(*), count(s.c_custkey), count(o.o_orderkey)
    FROM (SELECT * FROM source_dataset WHERE c_acctbal > 5000) s RIGHT JOIN secondary_dataset o ON s.c_custkey = o.o_custkey
    UNION ALL SELECT 'full', count(*), count(s.c_custkey), count(o.o_orderkey)
    FROM (SELECT * FROM source_dataset WHERE c_acctbal > 5000) s
    FULL JOIN (SELECT * FROM secondary_dataset WHERE o_totalprice > 400000) o ON s.c_custkey = o.o_custkey
    """,
    "orders",
)

_register(
    "sql_theta_join", "SQL-11", "customer",
    """
    SELECT s.c_custkey, count(*) AS richer_segments
    FROM source_dataset s
    JOIN (SELECT c_mktsegment, avg(c_acctbal) AS mean_balance FROM source_dataset GROUP BY c_mktsegment) m
      ON s.c_acctbal < m.mean_balance AND s.c_mktsegment <> m.c_mktsegment
    GROUP BY s.c_custkey
    """,
)

_register(
    "sql_semi_anti", "SQL-12", "orders",
    """
    SELECT o_orderpriority,
           count(*) AS late_orders
    FROM source_dataset o
    WHERE EXISTS (SELECT 1 FROM secondary_dataset l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')
      AND NOT EXISTS (SELECT 1 FROM secondary_dataset l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 7)
      AND o.o_orderkey IN (SELECT l_orderkey FROM secondary_dataset WHERE l_quantity > 25)
      AND o.o_orderkey NOT IN (SELECT l_orderkey FROM secondary_dataset WHERE l_discount > 0.09)
    GROUP BY o_orderpriority
    """,
    "lineitem",
)

@query(
    "sql_range_overlap",
    "SQL-13",
    """
    WITH spans AS (
      SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey)
    SELECT w.l_orderkey, count(*) AS orders_inside, round(CAST(sum(CAST(o.o_totalprice AS DECIMAL(28, 6))) AS DOUBLE), 2) AS value_inside
    FROM spans w JOIN orders o ON o.o_orderdate BETWEEN w.first_ship AND w.last_ship
    GROUP BY w.l_orderkey
    """,
)
def sql_range_overlap(spark, sf_dir):
    """Orders and value inside the whole shipping time of each order, from running totals over the order date."""
    spans = run_sql(
        """
        SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
        FROM source_dataset WHERE l_shipdate IS NOT NULL GROUP BY l_orderkey
        """,
        table(spark, sf_dir, "lineitem"),
    )
    orders = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL")
    # Decimals, so that the difference of two large totals is exact.
    price = F.col("o_totalprice").cast("decimal(28,6)")
    nothing = F.lit(0).cast("decimal(38,6)")
    sold = orders.groupBy(F.col("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("priced"), F.coalesce(F.sum(price), nothing).alias("value")
    )
    # The ends of the intervals are days without orders of their own.
    ends = spans.select(F.explode(F.array("first_ship", "last_ship")).alias("day")).distinct()
    empty = ends.select("day", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("priced"), nothing.alias("value"))
    days = sold.union(empty).groupBy("day").agg(*[F.sum(c).alias(c) for c in ("n", "priced")], F.sum("value").cast("decimal(38,6)").alias("value"))
    upto = running_totals(days, [], ["day"], {"n_upto": F.col("n"), "priced_upto": F.col("priced"), "value_upto": F.col("value")})
    start = upto.select(F.col("day").alias("first_ship"), *[(F.col(f"{c}_upto") - F.col(c)).alias(f"{c}_before") for c in ("n", "priced", "value")])
    end = upto.select(F.col("day").alias("last_ship"), "n_upto", "priced_upto", "value_upto")
    value = F.round((F.col("value_upto") - F.col("value_before")).cast("double"), 2)
    return spans.join(start, "first_ship").join(end, "last_ship").where("n_upto > n_before").select(
        "l_orderkey", (F.col("n_upto") - F.col("n_before")).alias("orders_inside"),
        F.when(F.col("priced_upto") > F.col("priced_before"), value).alias("value_inside"),
    )


_OPEN = """SELECT o_custkey, o_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""


@query(
    "sql_overlap_pairs",
    "SQL-13",
    f"""
    WITH spans AS ({_OPEN})
    SELECT a.o_custkey, a.o_orderkey AS order_a, b.o_orderkey AS order_b, greatest(a.first_ship, b.first_ship) AS shared_from, least(a.last_ship, b.last_ship) AS shared_to
    FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.first_ship <= b.last_ship AND b.first_ship <= a.last_ship
    """,
)
def sql_overlap_pairs(spark, sf_dir):
    """All pairs of a customer's orders that were shipped over a common time."""
    spans = run_sql(
        _OPEN.replace("FROM orders JOIN lineitem", "FROM source_dataset JOIN secondary_dataset"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    )
    sides = [spans.withColumnsRenamed({"o_orderkey": f"order_{n}", "first_ship": f"from_{n}", "last_ship": f"to_{n}"}) for n in "ab"]
    pairs = overlap_join(*sides, ("from_a", "to_a"), ("from_b", "to_b"), ["o_custkey"])
    return pairs.where("order_a < order_b").select(
        "o_custkey", "order_a", "order_b", F.greatest("from_a", "from_b").alias("shared_from"), F.least("to_a", "to_b").alias("shared_to")
    )


@query(
    "sql_overlap_counts",
    "SQL-13",
    f"""
    WITH spans AS ({_OPEN}),
    nations AS (SELECT n_nationkey, min(o_orderdate) AS a, max(o_orderdate) AS z FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1)
    SELECT n_nationkey, count(*) AS orders_met, min(o_orderkey) AS first_order FROM nations JOIN spans ON first_ship <= z AND a <= last_ship GROUP BY 1
    """,
)
def sql_overlap_counts(spark, sf_dir):
    """Orders shipped while a nation had pending ones: few long intervals against many short ones, no key in common."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    spans = run_sql(_OPEN.replace("FROM orders JOIN lineitem", "FROM source_dataset JOIN secondary_dataset"), orders, lines)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    pending = orders.where("o_orderstatus = 'P'").join(people, "o_custkey").join(nations, "n_nationkey")
    times = pending.groupBy("n_nationkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    met = overlap_join(times, spans, ("a", "z"), ("first_ship", "last_ship"))
    return met.groupBy("n_nationkey").agg(F.count(F.lit(1)).alias("orders_met"), F.min("o_orderkey").alias("first_order"))


@query(
    "sql_as_of",
    "SQL-13",
    """
    SELECT e.event_id, p.value AS last_purchase
    FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') e
    ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') p
      ON e.user_id = p.user_id AND e.ts >= p.ts
    """,
)
def sql_as_of(spark, sf_dir):
    """Last purchase value at each view: union of both sides, value carried along time."""
    both = run_sql(
        """
        SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'purchase' THEN value END AS purchase
        FROM source_dataset WHERE event_type IN ('view', 'purchase')
        """,
        table(spark, sf_dir, "events"),
    )
    carried = carry_last(both, ["user_id"], ["ts", "event_id"], "purchase", "last_purchase")
    return carried.where("event_type = 'view'").select("event_id", "last_purchase")


_register(
    "sql_group_by", "SQL-14", "lineitem",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
           round(avg(l_discount), 6) AS mean_discount, count(DISTINCT l_suppkey) AS suppliers,
           count(*) FILTER (WHERE l_quantity > 40) AS large_lines, min(l_shipdate) AS first_ship
    FROM source_dataset GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
    """,
)

_register(
    "sql_grouping_sets", "SQL-15", "lineitem",
    """
    SELECT 'sets' AS kind, l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INT) AS g
    FROM source_dataset GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())
    UNION ALL SELECT 'cube', l_returnflag, l_linestatus, count(*), CAST(grouping(l_returnflag) AS INT)
    FROM source_dataset GROUP BY CUBE (l_returnflag, l_linestatus)
    UNION ALL SELECT 'rollup', l_returnflag, l_linestatus, count(*), CAST(grouping(l_returnflag) AS INT)
    FROM source_dataset GROUP BY ROLLUP (l_returnflag, l_linestatus)
    """,
)

_register(
    "sql_rank_windows", "SQL-16", "lineitem",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
      CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER q AS BIGINT) AS rk, CAST(dense_rank() OVER q AS BIGINT) AS dr,
      CAST(ntile(3) OVER w AS BIGINT) AS third, round(percent_rank() OVER q, 6) AS pr, round(cume_dist() OVER q, 6) AS cd
    FROM source_dataset
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice), q AS (PARTITION BY l_orderkey ORDER BY l_quantity)
    """,
)

_register(
    "sql_analytic_windows", "SQL-17", "lineitem",
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
      lag(l_quantity, 1) OVER w AS before, lead(l_quantity, 1, 0) OVER w AS after,
      first_value(l_quantity) OVER w AS first_q,
      last_value(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_q,
      nth_value(l_quantity, 2) OVER w AS second_q,
      sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving_q,
      count(*) OVER (PARTITION BY l_orderkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near_q
    FROM source_dataset WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)
    """,
)

_register(
    "sql_set_operations", "SQL-18", "orders",
    """
    SELECT 'union' AS kind, count(*) AS n FROM (SELECT o_custkey AS k FROM source_dataset UNION SELECT c_custkey FROM secondary_dataset) a
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey AS k FROM source_dataset INTERSECT SELECT c_custkey FROM secondary_dataset) b
    UNION ALL SELECT 'intersect all', count(*) FROM (SELECT o_custkey AS k FROM source_dataset WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM source_dataset WHERE o_orderstatus = 'P') c
    UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey AS k FROM secondary_dataset EXCEPT SELECT o_custkey FROM source_dataset WHERE o_orderstatus = 'F') d
    UNION ALL SELECT 'except all', count(*) FROM (SELECT o_custkey AS k FROM source_dataset EXCEPT ALL SELECT c_custkey FROM secondary_dataset) e
    """,
    "customer",
)

_register(
    "sql_subqueries", "SQL-19", "orders",
    """
    WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS spent, count(*) AS n FROM source_dataset GROUP BY o_custkey)
    SELECT c.c_custkey, round(s.spent, 2) AS spent,
           (SELECT max(o.o_totalprice) FROM source_dataset o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS largest_f,
           x.mean_price AS mean_price
    FROM secondary_dataset c JOIN spend s ON s.o_custkey = c.c_custkey,
    LATERAL (SELECT round(avg(o.o_totalprice), 6) AS mean_price FROM source_dataset o WHERE o.o_custkey = c.c_custkey) x
    WHERE s.spent > (SELECT avg(spent) FROM spend)
    """,
    "customer",
)

_register(
    "sql_order_offset", "SQL-3 SQL-20", "orders",
    """
    SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS priority FROM source_dataset
    ORDER BY priority ASC NULLS LAST, o_orderkey DESC NULLS FIRST LIMIT 40 OFFSET 20
    """,
)

_register(
    "sql_strings", "SQL-21", "part",
    """
    SELECT p_partkey, upper(p_name) AS up, substring(p_name, 1, 4) AS head, length(p_name) AS len, trim(concat('  ', p_brand, ' ')) AS brand,
      replace(p_type, 'M', 'm') AS kind, split_part(p_name, ' ', 2) AS noun, p_name ILIKE '%RING%' AS is_ring,
      regexp_replace(p_brand, '[0-9]+', '#') AS family, lpad(CAST(p_size AS STRING), 3, '0') AS size_text, reverse(p_type) AS back,
      position('e' IN p_name) AS first_e
    FROM source_dataset
    """,
    check="""
    SELECT p_partkey, upper(p_name) AS up, substring(p_name, 1, 4) AS head, CAST(length(p_name) AS INTEGER) AS len, trim('  ' || p_brand || ' ') AS brand,
      replace(p_type, 'M', 'm') AS kind, split_part(p_name, ' ', 2) AS noun, p_name ILIKE '%RING%' AS is_ring,
      regexp_replace(p_brand, '[0-9]+', '#') AS family, lpad(CAST(p_size AS VARCHAR), 3, '0') AS size_text, reverse(p_type) AS back,
      CAST(position('e' IN p_name) AS INTEGER) AS first_e
    FROM part
    """,
)

_register(
    "sql_dates", "SQL-22", "orders",
    """
    SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y,
      CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(extract(DOY FROM o_orderdate) AS BIGINT) AS doy,
      o_orderdate + INTERVAL '30' DAY AS due, CAST(datediff(DATE'2002-01-01', o_orderdate) AS BIGINT) AS age,
      to_timestamp('2001-02-03 04:05:06') > o_orderdate AS earlier
    FROM source_dataset
    """,
    check="""
    SELECT o_orderkey, date_trunc('month', o_orderdate) AS month_start, extract(YEAR FROM o_orderdate) AS y,
      extract(QUARTER FROM o_orderdate) AS q, extract(DOY FROM o_orderdate) AS doy,
      o_orderdate + INTERVAL 30 DAY AS due, date_diff('day', o_orderdate, TIMESTAMP '2002-01-01') AS age,
      TIMESTAMP '2001-02-03 04:05:06' > o_orderdate AS earlier FROM orders
    """,
)

_register(
    "sql_numbers", "SQL-23", "lineitem",
    """
    SELECT l_orderkey, l_linenumber, CAST(l_partkey div 7 AS BIGINT) AS whole, l_partkey % 7 AS rest, round(sqrt(l_extendedprice), 4) AS root,
      round(ln(l_quantity + 1), 6) AS nat, CASE WHEN l_quantity > 30 THEN 'big' WHEN l_quantity > 10 THEN 'mid' ELSE 'small' END AS size,
      coalesce(nullif(l_returnflag, 'N'), '-') AS flag, CAST(floor(l_quantity / 7) AS BIGINT) AS fl, CAST(ceil(l_tax * 100) AS BIGINT) AS ce,
      sign(l_quantity - 25) AS sg, greatest(l_discount, l_tax) AS larger, CAST('12' AS INT) + l_linenumber AS plus
    FROM source_dataset
    """,
    check="""
    SELECT l_orderkey, l_linenumber, l_partkey // 7 AS whole, l_partkey % 7 AS rest, round(sqrt(l_extendedprice), 4) AS root,
      round(ln(l_quantity + 1), 6) AS nat, CASE WHEN l_quantity > 30 THEN 'big' WHEN l_quantity > 10 THEN 'mid' ELSE 'small' END AS size,
      coalesce(nullif(l_returnflag, 'N'), '-') AS flag, CAST(floor(l_quantity / 7) AS BIGINT) AS fl, CAST(ceil(l_tax * 100) AS BIGINT) AS ce,
      CAST(sign(l_quantity - 25) AS DOUBLE) AS sg, greatest(l_discount, l_tax) AS larger, 12 + l_linenumber AS plus FROM lineitem
    """,
)

_register(
    "sql_arrays_json", "SQL-24", "events",
    """
    SELECT user_id, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k_sum,
      array_join(sort_array(collect_set(event_type)), ',') AS kinds,
      listagg(DISTINCT event_type, '|') WITHIN GROUP (ORDER BY event_type) AS listed,
      CAST(size(array_distinct(collect_set(event_type))) AS BIGINT) AS kind_count,
      max(from_json(props, 'k BIGINT').k) AS k_max, bool_or(array_contains(array('error', 'signup'), event_type)) AS notable
    FROM source_dataset GROUP BY user_id
    """,
    check="""
    SELECT user_id, count(*) AS n, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k_sum,
      string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS listed,
      count(DISTINCT event_type) AS kind_count, max(CAST(props->>'$.k' AS BIGINT)) AS k_max,
      bool_or(event_type IN ('error', 'signup')) AS notable
    FROM events GROUP BY user_id
    """,
)


@query(
    "sql_lineage",
    "SQL-1 SQL-4",
    """
    SELECT 'sql' AS mode, 'source_dataset' AS source_relation, 'secondary_dataset' AS secondary_relation,
      substr(sha256('SELECT o_orderstatus, count(*) AS n FROM source_dataset GROUP BY o_orderstatus'), 1, 12) AS sql_hash,
      o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus
    """,
)
def sql_lineage(spark, sf_dir):
    """Result of a statement next to its lineage facts."""
    statement = "SELECT o_orderstatus, count(*) AS n FROM source_dataset GROUP BY o_orderstatus"
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    facts = lineage_row(statement, orders, customers)
    result = run_sql(statement + " ;", orders, customers)
    return result.withColumns({
        name: facts.select(name).scalar() for name in ("mode", "source_relation", "secondary_relation", "sql_hash")
    })
