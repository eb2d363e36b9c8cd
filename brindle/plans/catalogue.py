"""Registered queries of the relational engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import encodings, udfs
from brindle.operators import relational as R
from brindle.operators import graph, vector
from brindle.plans.sql import run_group_query, run_sql
from brindle.sources import shared, tables
from brindle.sources.tables import partition_id, scan
from brindle.streaming.events import sessions, windowed_totals

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def both(name: str, sql: str) -> None:
    """Register SQL that reads the same in both engines."""
    QUERIES[name] = lambda spark, d, sql=sql: run_sql(spark, d, sql)
    ORACLE_SQL[name] = sql


LINE = ["l_orderkey", "l_linenumber", "l_quantity"]


# Scans and projections.


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_all(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "nation")


@query("SELECT c_custkey, c_name FROM customer")
def project_cols(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "customer", ["c_custkey", "c_name"])


@query("SELECT * FROM supplier")
def select_star(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "supplier").select("*")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS more, l_quantity - 1 AS less, l_extendedprice / l_quantity AS unit FROM lineitem")
def project_arith(spark: SparkSession, d: str) -> DataFrame:
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    return scan(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (price * (1 - F.col("l_discount"))).alias("net"),
        (quantity + 1).alias("more"), (quantity - 1).alias("less"), (price / quantity).alias("unit"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def alias(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("SELECT r_regionkey, 7 AS i, CAST(0.5 AS DOUBLE) AS x, 'it''s' AS s FROM region")
def literals(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "region").select("r_regionkey", F.lit(7).alias("i"), F.lit(0.5).alias("x"), F.lit("it's").alias("s"))


# Filters.

_OPS = {"gt": ">", "lt": "<", "ge": ">=", "le": "<=", "eq": "=", "ne": "<>"}
for _name, _op in _OPS.items():
    QUERIES[f"filter_{_name}"] = lambda spark, d, op=_op: scan(spark, d, "lineitem", LINE, R.compare("l_quantity", op, 25.0))
    ORACLE_SQL[f"filter_{_name}"] = f"SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity {_op} 25.0"


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_discount < 0.05")
def filter_and(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "lineitem", LINE, (F.col("l_quantity") > 10) & (F.col("l_discount") < 0.05))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 OR l_discount >= 0.09")
def filter_or(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "lineitem", LINE, (F.col("l_quantity") < 3) | (F.col("l_discount") >= 0.09))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE NOT l_quantity > 5 AND l_linenumber = 1")
def filter_not(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "lineitem", LINE, ~(F.col("l_quantity") > 5) & (F.col("l_linenumber") == 1))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def filter_between(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "lineitem", LINE, F.col("l_quantity").between(10, 12))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "orders", ["o_orderkey", "o_orderpriority"], F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_string_eq(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "customer", ["c_custkey", "c_mktsegment"], R.compare("c_mktsegment", "=", "BUILDING"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_brand IS NOT NULL")
def filter_like_null(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "part", ["p_partkey", "p_name"], F.col("p_name").like("%a%") & F.col("p_brand").isNotNull())


@query("SELECT count(*) AS n, sum(l_extendedprice) AS total FROM lineitem WHERE l_orderkey <= 1000")
def pushdown_scan_agg(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "lineitem", where="l_orderkey <= 1000"), {"n": ("count", "*"), "total": ("sum", "l_extendedprice")})


# Joins.


@query("SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inner_join(spark: SparkSession, d: str) -> DataFrame:
    return R.equi_join(scan(spark, d, "orders"), scan(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "o_totalprice", "c_custkey", "c_name")


@query("SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_custkey < 100")
def inner_join_1n(spark: SparkSession, d: str) -> DataFrame:
    orders = R.equi_join(scan(spark, d, "customer", where="c_custkey < 100"), scan(spark, d, "orders"), "c_custkey", "o_custkey")
    return R.equi_join(orders, scan(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("c_custkey", "o_orderkey", "l_linenumber")


@query("SELECT o_orderkey, c_custkey FROM orders JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON o_custkey = c_custkey")
def join_unmatched_dropped(spark: SparkSession, d: str) -> DataFrame:
    rich = scan(spark, d, "customer", where="c_acctbal > 5000")
    return R.equi_join(scan(spark, d, "orders"), rich, "o_custkey", "c_custkey").select("o_orderkey", "c_custkey")


@query("""
WITH a AS (SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS k FROM nation),
     b AS (SELECT r_name, CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END AS k FROM region)
SELECT n_nationkey, r_name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k
""")
def join_null_safe(spark: SparkSession, d: str) -> DataFrame:
    a = scan(spark, d, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("ka"))
    b = scan(spark, d, "region").select("r_name", F.nullif("r_regionkey", F.lit(2)).alias("kb"))
    return R.equi_join(a, b, "ka", "kb", null_safe=True).select("n_nationkey", "r_name")


@query("""
SELECT n_name, count(*) AS n_lines, sum(l_extendedprice * (1 - l_discount)) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name
""")
def multiway_join(spark: SparkSession, d: str) -> DataFrame:
    j = R.equi_join(scan(spark, d, "customer"), scan(spark, d, "nation"), "c_nationkey", "n_nationkey")
    j = R.equi_join(scan(spark, d, "orders"), j, "o_custkey", "c_custkey")
    j = R.equi_join(scan(spark, d, "lineitem"), j, "l_orderkey", "o_orderkey")
    return j.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def join_salted(spark: SparkSession, d: str) -> DataFrame:
    return R.salted_join(scan(spark, d, "orders", where="o_totalprice > 100000"), scan(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


for _how, _sql in {"left": "LEFT", "right": "RIGHT", "full": "FULL"}.items():
    QUERIES[f"join_{_how}"] = lambda spark, d, how=_how: R.equi_join(
        scan(spark, d, "supplier", where="s_acctbal > 0"), scan(spark, d, "nation", where="n_regionkey < 4"), "s_nationkey", "n_nationkey", how
    ).select("s_suppkey", "n_name")
    ORACLE_SQL[f"join_{_how}"] = f"SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s {_sql} JOIN (SELECT * FROM nation WHERE n_regionkey < 4) n ON s_nationkey = n_nationkey"


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    return R.equi_join(scan(spark, d, "customer", ["c_custkey"]), scan(spark, d, "orders", where="o_totalprice > 200000"), "c_custkey", "o_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    return R.equi_join(scan(spark, d, "customer", ["c_custkey"]), scan(spark, d, "orders"), "c_custkey", "o_custkey", "left_anti")


@query("""
SELECT e.event_id, p.value AS asof_value FROM (SELECT * FROM events WHERE event_type = 'error') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p
ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def join_asof(spark: SparkSession, d: str) -> DataFrame:
    events = scan(spark, d, "events")
    bought = events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    found = R.asof_join(events.filter("event_type = 'error'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "ts", "value")
    return found.select("event_id", "asof_value")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    return R.theta_join(scan(spark, d, "nation"), scan(spark, d, "region"), F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey AND (o_totalprice > 20 * c_acctbal OR c_mktsegment = 'BUILDING')")
def join_condition(spark: SparkSession, d: str) -> DataFrame:
    met = (F.col("o_custkey") == F.col("c_custkey")) & ((F.col("o_totalprice") > 20 * F.col("c_acctbal")) | (F.col("c_mktsegment") == "BUILDING"))
    return R.theta_join(scan(spark, d, "orders"), scan(spark, d, "customer"), met).select("o_orderkey", "c_name")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    return R.cross_join(scan(spark, d, "region", ["r_name"]), scan(spark, d, "nation", ["n_name"]))


_BANDS = "SELECT s_suppkey, s_acctbal - 25 AS low, s_acctbal + 25 AS high FROM supplier"


@query(f"SELECT c_custkey, s_suppkey FROM customer JOIN ({_BANDS}) b ON c_acctbal BETWEEN low AND high")
def join_range(spark: SparkSession, d: str) -> DataFrame:
    bands = scan(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") - 25).alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return R.range_join(scan(spark, d, "customer", ["c_custkey", "c_acctbal"]), bands, "c_acctbal", "low", "high", 50).select("c_custkey", "s_suppkey")


_SPANS = "SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t0, epoch_us(ts) // 1000000 + 600 AS t1 FROM events"


@query(f"SELECT e.event_id AS error_id, p.event_id AS purchase_id FROM ({_SPANS}) e JOIN ({_SPANS}) p ON e.user_id = p.user_id AND greatest(e.t0, p.t0) <= least(e.t1, p.t1) WHERE e.event_type = 'error' AND p.event_type = 'purchase'")
def join_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Errors and purchases of a user whose ten minutes touch."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = scan(spark, d, "events").select("event_id", "user_id", "event_type", F.floor(t / 1_000_000).alias("t0"), (F.floor(t / 1_000_000) + 600).alias("t1"))
    found = R.overlap_join(spans.filter("event_type = 'error'"), spans.filter("event_type = 'purchase'"), "user_id", "t0", "t1", 600)
    return found.select(F.col("l.event_id").alias("error_id"), F.col("r.event_id").alias("purchase_id"))


# Aggregates.


@query("SELECT l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY l_returnflag")
def group_sum(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "lineitem"), {"total": ("sum", "l_quantity")}, ["l_returnflag"])


@query("SELECT o_orderpriority, count(*) AS n, count(o_custkey) AS n_cust FROM orders GROUP BY o_orderpriority")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "orders"), {"n": ("count", "*"), "n_cust": ("count", "o_custkey")}, ["o_orderpriority"])


@query("SELECT c_mktsegment, min(c_acctbal) AS low FROM customer GROUP BY c_mktsegment")
def group_min(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "customer"), {"low": ("min", "c_acctbal")}, ["c_mktsegment"])


@query("SELECT c_mktsegment, max(-abs(c_acctbal)) AS high FROM customer GROUP BY c_mktsegment")
def group_max(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "customer").withColumn("v", -F.abs("c_acctbal")), {"high": ("max", "v")}, ["c_mktsegment"])


@query("SELECT l_returnflag, sum(l_quantity) AS q, sum(l_extendedprice) AS p, count(*) AS n, avg(l_discount) AS a FROM lineitem GROUP BY l_returnflag")
def group_multi_agg(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "lineitem"), {"q": ("sum", "l_quantity"), "p": ("sum", "l_extendedprice"), "n": ("count", "*"), "a": ("avg", "l_discount")}, ["l_returnflag"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_two_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "lineitem"), {"n": ("count", "*")}, ["l_returnflag", "l_linestatus"])


@query("SELECT sum(o_totalprice) AS total, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def global_agg(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "orders"), {"total": ("sum", "o_totalprice"), "n": ("count", "*"), "low": ("min", "o_totalprice"), "high": ("max", "o_totalprice")})


@query("SELECT o_orderstatus, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM orders GROUP BY o_orderstatus")
def conditional_agg(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "orders").groupBy("o_orderstatus").agg(R.conditional_sum(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1000000")
def having(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "orders"), {"total": ("sum", "o_totalprice")}, ["o_custkey"], "total > 1000000")


@query("SELECT o_custkey, count(*) AS value FROM orders WHERE o_totalprice > 150000 GROUP BY o_custkey")
def distributed_count(spark: SparkSession, d: str) -> DataFrame:
    return run_group_query(spark, d, "SELECT count(o_orderkey) FROM orders WHERE o_totalprice > 150000 GROUP BY o_custkey")


@query("SELECT o_orderpriority, sum(o_totalprice) AS value FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderpriority")
def filter_group_sum(spark: SparkSession, d: str) -> DataFrame:
    return run_group_query(spark, d, "SELECT sum(o_totalprice) FROM orders WHERE o_totalprice > 50000 GROUP BY o_orderpriority")


@query("SELECT n_regionkey, max(n_nationkey) AS value FROM nation GROUP BY n_regionkey")
def distributed_no_where(spark: SparkSession, d: str) -> DataFrame:
    return run_group_query(spark, d, "select max(n_nationkey) from nation group by n_regionkey")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS n_supp FROM lineitem GROUP BY l_returnflag")
def group_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "lineitem"), {"n_supp": ("count_distinct", "l_suppkey")}, ["l_returnflag"])


@query("SELECT true AS close")
def approx_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Whether the estimate of distinct orders is within a tenth of their number."""
    both_ = R.aggregate(scan(spark, d, "lineitem"), {"about": ("approx_distinct", "l_orderkey"), "n": ("count_distinct", "l_orderkey")})
    return both_.select((F.abs(F.col("about") - F.col("n")) <= 0.1 * F.col("n")).alias("close"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return R.grouping_sets(scan(spark, d, "lineitem"), [["l_returnflag", "l_linestatus"], ["l_linestatus"], []], {"n": ("count", "*"), "q": ("sum", "l_quantity")})


# Sort, limit, top.


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def sort_asc(spark: SparkSession, d: str) -> DataFrame:
    return R.sort(scan(spark, d, "customer", ["c_custkey", "c_acctbal"]), ("c_acctbal", True), ("c_custkey", True))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sort_desc(spark: SparkSession, d: str) -> DataFrame:
    return R.sort(scan(spark, d, "customer", ["c_custkey", "c_acctbal"]), ("c_acctbal", False), ("c_custkey", True))


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey LIMIT 20")
def sort_multi(spark: SparkSession, d: str) -> DataFrame:
    return R.top(scan(spark, d, "supplier", ["s_nationkey", "s_suppkey", "s_acctbal"]), 20, ("s_nationkey", True), ("s_acctbal", False), ("s_suppkey", True))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS k FROM nation ORDER BY k NULLS FIRST, n_nationkey LIMIT 8")
def sort_nulls(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, d, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("k"))
    return R.top(rows, 8, ("k", True), ("n_nationkey", True))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
def limit_n(spark: SparkSession, d: str) -> DataFrame:
    return R.top(scan(spark, d, "orders", ["o_orderkey"]), 7, ("o_orderkey", True))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark: SparkSession, d: str) -> DataFrame:
    return R.top(scan(spark, d, "orders", ["o_orderkey", "o_totalprice"]), 10, ("o_totalprice", False), ("o_orderkey", True))


# Report queries that read the same in both engines.

both("tpch_q1", """
SELECT l_returnflag, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_price, count(*) AS cnt
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag
""")
both("tpch_q6", """
SELECT sum(l_extendedprice * l_discount) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01'
  AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24
""")
both("tpch_q12", """
SELECT l_linestatus,
  CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01' GROUP BY l_linestatus
""")
both("tpch_q14", """
SELECT 100.0 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
       / sum(l_extendedprice * (1 - l_discount)) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-10-01'
""")
both("tpch_q3", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10
""")
both("tpch_q5", """
SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name
""")
both("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind FROM part")
both("exists_subquery", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
both("correlated_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 2 FROM orders i WHERE i.o_custkey = o.o_custkey)")
both("date_arith", "SELECT CAST(year(l_shipdate) AS BIGINT) AS y, CAST(month(l_shipdate) AS BIGINT) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2")
both("arith_of_aggs", "SELECT l_linestatus, sum(l_extendedprice) / sum(l_quantity) AS unit FROM lineitem GROUP BY l_linestatus")
both("hidden_sort_key", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5")
both("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
both("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
both("distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
both("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
both("rollup_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")


both("cube_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) AS n FROM orders GROUP BY o_orderstatus")
both("agg_stats", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 6) AS sd, round(var_pop(c_acctbal), 4) AS var, round(corr(c_acctbal, c_custkey), 9) AS r FROM customer GROUP BY c_mktsegment")
both("agg_extremes", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest, bool_or(o_totalprice > 200000) AS any_large FROM orders GROUP BY o_custkey")
both("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
both("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
both("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
both("window_neighbours", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS later, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("window_ranks", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)")
both("window_frames", """
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near,
  round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
  max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS high
FROM orders
""")
both("string_functions", """
SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, substring(p_name, 2, 4) AS part, replace(p_name, 'e', '_') AS r, concat(p_brand, '/', p_type) AS c,
  instr(p_name, 'r') AS at, reverse(p_type) AS rev, lpad(p_type, 12, '.') AS padded, trim(concat('  ', p_type, ' ')) AS t, left(p_brand, 3) AS l3
FROM part
""")
both("number_functions", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS f, ceil(l_discount * 100) AS c, round(l_tax, 1) AS r, CAST(l_orderkey % 7 AS BIGINT) AS m, greatest(l_quantity, 25.0) AS g, least(l_quantity, 25.0) AS l, sign(l_quantity - 25) AS s FROM lineitem")
both("null_functions", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS k, CASE WHEN nullif(n_regionkey, 1) IS NULL THEN 'none' ELSE CAST(n_regionkey AS VARCHAR(10)) END AS s FROM nation")
both("date_functions", "SELECT o_orderkey, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(day(o_orderdate) AS BIGINT) AS d, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, datediff(DATE '2001-12-31', CAST(o_orderdate AS DATE)) AS left_days FROM orders")
ORACLE_SQL["date_functions"] = ORACLE_SQL["date_functions"].replace("datediff(DATE '2001-12-31', CAST(o_orderdate AS DATE))", "CAST(DATE '2001-12-31' - CAST(o_orderdate AS DATE) AS INTEGER)")
both("with_recursive_free_cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), m AS (SELECT avg(t) AS a FROM big) SELECT o_custkey FROM big, m WHERE t > 1.5 * a")
both("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)")
both("text_tables", "SELECT source, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY source")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN 'high' ELSE 'low' END AS level FROM events")
def json_functions(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return scan(spark, d, "events").select("event_id", k.alias("k"), F.when(k > 50, "high").otherwise("low").alias("level"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, embedding[1] AS first, list_max(embedding) AS high, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive FROM embeddings")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return scan(spark, d, "embeddings").select("vec_id", F.size(e).alias("dim"), F.get(e, F.lit(0)).alias("first"), F.array_max(e).alias("high"), F.size(F.filter(e, lambda x: x > 0)).alias("positive"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def explode_words(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(CASE WHEN c_nationkey = 1 THEN 1 END) AS n1, count(CASE WHEN c_nationkey = 2 THEN 1 END) AS n2 FROM customer GROUP BY c_mktsegment")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    out = scan(spark, d, "customer").groupBy("c_mktsegment").pivot("c_nationkey", [1, 2]).agg(F.count("c_custkey")).na.fill(0)
    return out.withColumnsRenamed({"1": "n1", "2": "n2"})


@query("SELECT c_custkey, upper(left(c_mktsegment, 1)) || regexp_replace(upper(substring(c_mktsegment, 2)), '[^BCDFGHJKLMNPQRSTVWXZ]', '', 'g') AS code FROM customer")
def udf_scalar(spark: SparkSession, d: str) -> DataFrame:
    udfs.register_all(spark)
    return run_sql(spark, d, "SELECT c_custkey, consonants(c_mktsegment) AS code FROM customer")


@query("SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS width FROM customer GROUP BY c_nationkey")
def udf_aggregate(spark: SparkSession, d: str) -> DataFrame:
    udfs.register_all(spark)
    return run_sql(spark, d, "SELECT c_nationkey, value_range(c_acctbal) AS width FROM customer GROUP BY c_nationkey")


@query("SELECT s_suppkey, CAST(i AS INTEGER) AS place, CAST(substring(CAST(s_suppkey AS VARCHAR), i + 1, 1) AS INTEGER) AS digit FROM (SELECT s_suppkey, unnest(range(length(CAST(s_suppkey AS VARCHAR)))) AS i FROM supplier)")
def udf_table(spark: SparkSession, d: str) -> DataFrame:
    udfs.register_all(spark)
    return run_sql(spark, d, "SELECT s_suppkey, place, digit FROM supplier, LATERAL digits(s_suppkey)")


# Whole results of queries that are given above with a fixed range of ids or a limit.


@query("SELECT count(*) AS n, sum(l_extendedprice) AS total FROM lineitem WHERE l_quantity < 24")
def pushdown_scan_agg_value(spark: SparkSession, d: str) -> DataFrame:
    return R.aggregate(scan(spark, d, "lineitem", where="l_quantity < 24"), {"n": ("count", "*"), "total": ("sum", "l_extendedprice")})


@query("SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey")
def inner_join_1n_whole(spark: SparkSession, d: str) -> DataFrame:
    orders = R.equi_join(scan(spark, d, "customer"), scan(spark, d, "orders"), "c_custkey", "o_custkey")
    return R.equi_join(orders, scan(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("c_custkey", "o_orderkey", "l_linenumber")


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def sort_multi_whole(spark: SparkSession, d: str) -> DataFrame:
    return R.sort(scan(spark, d, "supplier", ["s_nationkey", "s_suppkey", "s_acctbal"]), ("s_nationkey", True), ("s_acctbal", False), ("s_suppkey", True))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS k FROM nation ORDER BY k NULLS FIRST, n_nationkey")
def sort_nulls_whole(spark: SparkSession, d: str) -> DataFrame:
    return R.sort(scan(spark, d, "nation").select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("k")), ("k", True), ("n_nationkey", True))


both("hidden_sort_key_whole", "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey")


# Layout and encodings.


@query("SELECT CAST(o_custkey % 4 AS INTEGER) AS pid, count(*) AS n FROM orders GROUP BY 1")
def hash_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d, "orders").groupBy(partition_id(F.col("o_custkey"), 4).alias("pid")).agg(F.count("*").alias("n"))


# Tables written and read again.

for _codec in tables.CODECS:

    def _through_codec(spark: SparkSession, d: str, codec: str = _codec) -> DataFrame:
        path = shared.new_path(spark, "codec")
        tables.write(scan(spark, d, "orders"), path, codec)
        return spark.read.parquet(path)

    QUERIES[f"parquet_{_codec.lower()}"] = _through_codec
    ORACLE_SQL[f"parquet_{_codec.lower()}"] = "SELECT * FROM orders"

for _form in tables.FORMATS:

    def _through_format(spark: SparkSession, d: str, form: str = _form) -> DataFrame:
        path, rows = shared.new_path(spark, form), scan(spark, d, "events")
        tables.save(rows, path, form)
        return tables.load(spark, path, form, rows.schema)

    QUERIES[f"{_form}_round_trip"] = _through_format
    ORACLE_SQL[f"{_form}_round_trip"] = "SELECT * FROM events"


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 1 THEN NULL ELSE n_regionkey END AS k, CASE WHEN n_regionkey = 2 THEN NULL WHEN n_regionkey = 3 THEN '' ELSE n_name END AS s FROM nation")
def parquet_nulls(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("n_regionkey") == 2, None).when(F.col("n_regionkey") == 3, "").otherwise(F.col("n_name"))
    rows = scan(spark, d, "nation").select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(1)).alias("k"), name.alias("s"))
    path = shared.new_path(spark, "nulls")
    tables.write(rows, path)
    return spark.read.parquet(path)


@query("SELECT CAST(o_custkey % 4 AS INTEGER) AS partition_id, count(*) AS n, sum(o_orderkey) AS keys, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def partitioned_write(spark: SparkSession, d: str) -> DataFrame:
    path = shared.new_path(spark, "parts")
    tables.write_partitioned(scan(spark, d, "orders"), path, "o_custkey", 4)
    found = spark.read.parquet(path).groupBy("partition_id")
    return found.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.count_distinct("o_custkey").alias("customers"))


def _grouped(spark: SparkSession, d: str) -> str:
    """Line items in small row groups, in files by range and sorted inside them."""
    path = shared.new_path(spark, "groups")
    tables.write_ranges(scan(spark, d, "lineitem"), path, "l_orderkey", "SNAPPY", row_group_bytes=1 << 18)
    return path


@query("SELECT 'l_orderkey' AS \"column\", min(l_orderkey) AS low, max(l_orderkey) AS high, count(*) AS n, CAST(0 AS BIGINT) AS nulls, 'SNAPPY' AS codec FROM lineitem")
def row_group_footers(spark: SparkSession, d: str) -> DataFrame:
    """A table's bounds and rows as its footers give them."""
    groups = tables.row_groups(spark, _grouped(spark, d)).filter("column = 'l_orderkey'")
    return groups.groupBy("column").agg(F.min(F.col("low").cast("bigint")).alias("low"), F.max(F.col("high").cast("bigint")).alias("high"), F.sum("n_rows").alias("n"), F.sum("nulls").alias("nulls"), F.max("codec").alias("codec"))


@query("SELECT true AS some_skipped, count(*) AS n FROM lineitem WHERE l_orderkey < (SELECT max(l_orderkey) // 10 FROM lineitem)")
def zone_map_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Whether bounds rule row groups out, and what the others and the filter give."""
    path, top = _grouped(spark, d), scan(spark, d, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0
    pruned = tables.pruned_groups(spark, path, "l_orderkey", "<", top // 10).select((F.col("skipped") > 0).alias("some_skipped"))
    n = spark.read.parquet(path).filter(F.col("l_orderkey") < top // 10).agg(F.count("*").alias("n"))
    return R.cross_join(pruned, n)  # a row each


_FIRSTS = "SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY o_orderpriority"


@query(f"SELECT o_orderkey, CAST(code AS INTEGER) AS code FROM orders JOIN ({_FIRSTS}) c USING (o_orderpriority)")
def dict_encode(spark: SparkSession, d: str) -> DataFrame:
    return encodings.dictionary_encode(scan(spark, d, "orders"), "o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, o_orderpriority FROM orders")
def dict_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = scan(spark, d, "orders")
    codes = encodings.dictionary(rows, "o_orderkey", "o_orderpriority")
    return encodings.dictionary_decode(encodings.dictionary_encode(rows, "o_orderkey", "o_orderpriority"), codes, "o_orderkey", "o_orderpriority")


_RUNS = """
WITH m AS (
  SELECT user_id, event_id, event_type,
    CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS length FROM r GROUP BY user_id, run, event_type
"""


@query(_RUNS)
def rle_encode(spark: SparkSession, d: str) -> DataFrame:
    return encodings.rle_encode(scan(spark, d, "events"), "event_id", "event_type", "user_id")


@query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, event_type FROM events")
def rle_decode(spark: SparkSession, d: str) -> DataFrame:
    return encodings.rle_decode(rle_encode(spark, d), "event_type", "user_id")


@query("SELECT o_custkey, o_orderkey, o_orderkey - coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 0) AS delta FROM orders")
def delta_encode(spark: SparkSession, d: str) -> DataFrame:
    return encodings.delta_encode(scan(spark, d, "orders").withColumn("value", F.col("o_orderkey")), "o_orderkey", "value", "o_custkey")


@query("SELECT o_custkey, o_orderkey, o_orderkey AS value FROM orders")
def delta_decode(spark: SparkSession, d: str) -> DataFrame:
    return encodings.delta_decode(delta_encode(spark, d), "o_orderkey", "value", "o_custkey")


# Vectors.


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return list(scan(spark, d, "embeddings", ["embedding"], "vec_id = 0").first()[0])


_KNN = "SELECT CAST(row_number() OVER (ORDER BY dist, vec_id) AS INTEGER) AS rank, vec_id FROM (SELECT b.vec_id, {} AS dist FROM embeddings b, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 10"
for _metric, _call in {"l2": "list_distance(b.embedding, q.embedding)", "cosine": "list_cosine_distance(b.embedding, q.embedding)", "dot": "list_negative_inner_product(b.embedding, q.embedding)"}.items():
    QUERIES[f"knn_{_metric}"] = lambda spark, d, m=_metric: vector.knn(scan(spark, d, "embeddings"), _first_vector(spark, d), 10, m).select("rank", "vec_id")
    ORACLE_SQL[f"knn_{_metric}"] = _KNN.format(_call)

_KNN_MANY = """
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id FROM (
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, b.vec_id, {} AS dist FROM embeddings b, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)
) WHERE rank <= 10
"""


def _knn_many(spark: SparkSession, d: str, metric: str) -> DataFrame:
    base = scan(spark, d, "embeddings")
    return vector.knn_join(base, base.filter("vec_id % 50 = 0"), 10, metric).select("query_id", "rank", "vec_id")


# The same searches for every fiftieth vector, against all rows.
for _metric, _call in {"l2": "list_distance(b.embedding, q.embedding)", "cosine": "list_cosine_distance(b.embedding, q.embedding)", "dot": "list_negative_inner_product(b.embedding, q.embedding)"}.items():
    QUERIES[f"knn_many_{_metric}"] = lambda spark, d, m=_metric: _knn_many(spark, d, m)
    ORACLE_SQL[f"knn_many_{_metric}"] = _KNN_MANY.format(_call)


@query("""
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id FROM (
  SELECT q.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(b.embedding, q.embedding), b.vec_id) AS rank
  FROM embeddings b, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q
) WHERE rank <= 5
""")
def knn_many(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth vector is a query, against all rows."""
    base = scan(spark, d, "embeddings")
    return vector.knn_join(base, base.filter("vec_id % 50 = 0"), 5).select("query_id", "rank", "vec_id")


def _ann(spark: SparkSession, d: str, metric: str) -> DataFrame:
    base = scan(spark, d, "embeddings")
    return vector.build_ivf(base, metric=metric).search_many(base.filter("vec_id % 50 = 0"), 10).select("query_id", "rank", "vec_id", "distance")


@query()
def ann_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every fiftieth vector by the inverted file."""
    return _ann(spark, d, "l2")


@query()
def ann_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _ann(spark, d, "cosine")


@query()
def ann_dot(spark: SparkSession, d: str) -> DataFrame:
    return _ann(spark, d, "dot")


@query("SELECT metric, CAST(10 * n AS BIGINT) AS rows, true AS enough FROM (SELECT unnest(['l2', 'cosine', 'dot']) AS metric), (SELECT count(*) AS n FROM embeddings WHERE vec_id % 50 = 0)")
def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the index finds for every fiftieth vector, and whether 0.9 of the exact ones are among them."""
    out = None
    for metric in ("l2", "cosine", "dot"):
        found = _ann(spark, d, metric).select("query_id", "vec_id", F.lit(1).alias("found"))
        exact = _knn_many(spark, d, metric).select("query_id", "vec_id", F.lit(1).alias("exact"))
        both_ = found.join(exact, ["query_id", "vec_id"], "full").agg(F.count("found").alias("rows"), (F.count(F.expr("found + exact")) >= 0.9 * F.count("exact")).alias("enough"))
        both_ = both_.select(F.lit(metric).alias("metric"), "rows", "enough")
        out = both_ if out is None else out.unionByName(both_)
    return out


@query()
def graph_knn(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every fiftieth vector by layered proximity graphs."""
    base = scan(spark, d, "embeddings")
    return graph.build_graph(base).search_many(base.filter("vec_id % 50 = 0"), 10, ef=300)


@query("SELECT CAST(10 * count(*) AS BIGINT) AS rows, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def graph_recall(spark: SparkSession, d: str) -> DataFrame:
    """Rows that the graphs find, and whether 0.9 of the exact ones are among them."""
    found, exact = (df.select("query_id", "vec_id", F.lit(1).alias(name)) for df, name in ((graph_knn(spark, d), "found"), (_knn_many(spark, d, "l2"), "exact")))
    met = found.join(exact, ["query_id", "vec_id"], "full")
    return met.agg(F.count("found").alias("rows"), (F.count(F.expr("found + exact")) >= 0.9 * F.count("exact")).alias("enough"))


# Event windows, the batch side of the streaming plan.


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_totals(scan(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
SELECT window_start, event_type, count(*) AS n, sum(value) AS total FROM (
  SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS window_start, event_type, value FROM events
) GROUP BY 1, 2
""")
def event_sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return windowed_totals(scan(spark, d, "events"), slide="30 minutes").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
WITH m AS (
  SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k
""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions(scan(spark, d, "events")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
