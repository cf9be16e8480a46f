"""sql_*: the SQL surface of the question corpora, run natively by Spark SQL.

Each entry is (Spark SQL, DuckDB SQL); most are the same text.  Every ORDER
BY carries a unique tie-break and explicit NULL order, so LIMIT results are
engine-independent.  Latest-state-per-user uses ``max_by`` (a partial
aggregate) instead of a per-user window, so a hot user never lands in one task.
"""

from __future__ import annotations

from arbiter.sources.tables import TABLES, read_table

_SAME = None

SQL = {
    # PQ1-PQ10: the verified payments questions re-cast on the star schema.
    "sql_pq01_filtered_count": ("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'", _SAME),
    "sql_pq02_filter_project_order": ("SELECT s_name FROM supplier WHERE s_nationkey = 7 ORDER BY s_name", _SAME),
    "sql_pq03_top1": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1", _SAME),
    "sql_pq04_sum_two_filters": (
        "SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
        _SAME),
    "sql_pq05_error_events": ("SELECT count(*) AS n FROM events WHERE event_type = 'error'", _SAME),
    "sql_pq06_point_lookup_join": (
        "SELECT c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey = 7", _SAME),
    "sql_pq07_group_sum_order": (
        "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey "
        "GROUP BY c_mktsegment ORDER BY total DESC", _SAME),
    "sql_pq08_group_top1": (
        "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F' "
        "GROUP BY o_custkey ORDER BY total DESC, o_custkey LIMIT 1", _SAME),
    "sql_pq09_filtered_sum": (
        "SELECT round(sum(l_extendedprice), 2) AS returned_value FROM lineitem WHERE l_returnflag = 'R'", _SAME),
    "sql_pq10_latest_by_id": (
        "SELECT user_id, max_by(event_type, event_id) AS last_event, max(event_id) AS last_event_id FROM events GROUP BY user_id",
        _SAME),
    # Q1-Q11: constructs found in the benchmark gold SQL.
    "sql_q01_inner_join": (
        "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders "
        "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", _SAME),
    "sql_q01_left_join": (
        "SELECT count(*) AS customers_without_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey "
        "WHERE o_orderkey IS NULL", _SAME),
    "sql_q02_group_having": (
        "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > "
        "(SELECT count(*) / count(DISTINCT l_suppkey) FROM lineitem)", _SAME),
    "sql_q03_aggregates": (
        "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS avg_disc, "
        "min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(DISTINCT l_partkey) AS parts "
        "FROM lineitem GROUP BY l_returnflag", _SAME),
    "sql_q04_order_limit_offset": (
        "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5", _SAME),
    "sql_q05_in_subquery": (
        "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')",
        _SAME),
    "sql_q05_scalar_subquery": (
        "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)", _SAME),
    "sql_q05_cte_derived": (
        "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) "
        "SELECT d.n AS orders_per_customer, count(*) AS customers FROM (SELECT n FROM t) d GROUP BY d.n", _SAME),
    "sql_q06_union": (
        "SELECT s_name AS name FROM supplier WHERE s_nationkey = 1 UNION SELECT c_name FROM customer WHERE c_nationkey = 1",
        _SAME),
    "sql_q07_rank": (
        "SELECT c_nationkey, c_custkey, c_acctbal, rk FROM (SELECT c_nationkey, c_custkey, c_acctbal, "
        "rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS rk FROM customer) WHERE rk <= 3", _SAME),
    "sql_q08_case_iif_cast": (
        "SELECT CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size, count(*) AS n, "
        "CAST(sum(if(o_orderstatus = 'F', 1, 0)) AS BIGINT) AS finished, "
        "CAST(sum(try_cast(o_orderpriority AS INT)) AS BIGINT) AS bad_casts "
        "FROM orders GROUP BY 1", _SAME),
    "sql_q09_strings": (
        "SELECT p_partkey, substr(p_name, 1, 5) AS head, instr(p_name, 'gear') AS pos, p_brand || '/' || p_type AS bt, "
        "length(p_name) AS len FROM part WHERE p_name ILIKE '%GEAR%' OR p_type LIKE 'SMALL%'", _SAME),
    "sql_q10_dates": (
        "SELECT year(o_orderdate) AS yr, month(o_orderdate) AS mo, count(*) AS n FROM orders GROUP BY 1, 2", _SAME),
    "sql_q10_date_diff": (
        "SELECT l_returnflag, round(avg(datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))), 6) AS avg_days "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag",
        "SELECT l_returnflag, round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 6) AS avg_days "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_returnflag"),
    "sql_q10_date_format": (
        "SELECT date_format(o_orderdate, 'yyyy-MM') AS ym, count(*) AS n FROM orders GROUP BY 1",
        "SELECT strftime(o_orderdate, '%Y-%m') AS ym, count(*) AS n FROM orders GROUP BY 1"),
    "sql_q11_predicates": (
        "SELECT DISTINCT p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_size NOT IN (13, 17) "
        "AND p_name IS NOT NULL", _SAME),
    "sql_q11_int_div_round": (
        "SELECT p_size div 10 AS bucket, round(avg(p_retailprice), 2) AS avg_price, count(*) AS n FROM part GROUP BY 1",
        "SELECT p_size // 10 AS bucket, round(avg(p_retailprice), 2) AS avg_price, count(*) AS n FROM part GROUP BY 1"),
}


def _register(spark, sf_dir):
    for t in TABLES:
        read_table(spark, sf_dir, t).createOrReplaceTempView(t)


def _query(spark_sql):
    def q(spark, sf_dir):
        _register(spark, sf_dir)
        return spark.sql(spark_sql)
    return q


QUERIES = {name: _query(s) for name, (s, _) in SQL.items()}
ORACLES = {name: (d if d is not None else s) for name, (s, d) in SQL.items()}
