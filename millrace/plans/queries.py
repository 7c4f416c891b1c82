"""One query for each kind of operator, on the driver's tables."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalar
from millrace.operators import aggregates, dml, joins, paths, scan, sketches, sorting, windows
from millrace.plans.registry import query, sql_query
from millrace.sources import generators
from millrace.sources.tables import load

# ---- scans, values, projection ----------------------------------------------------------------------------------------------

sql_query("seq_scan", "SELECT r_regionkey, r_name FROM region")
sql_query("select_const", "SELECT 1 AS one, 'text' AS word, CAST(NULL AS INT) AS nothing, 2 + 3 AS five")
sql_query("values_list", "SELECT id, name FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)")
sql_query("project_star", "SELECT * FROM nation")
sql_query("project_expr", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 2) AS spend FROM lineitem")
sql_query("project_alias", "SELECT n.n_name AS nation_name, n.n_regionkey AS region FROM nation AS n")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 3, 5, 100, 999)")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return scan.lookup(orders, "o_orderkey", [1, 3, 5, 100, 999]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 10 AND o_orderkey <= 200")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return scan.key_range(orders, "o_orderkey", 10, 200).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def composite_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lineitem,) = load(spark, sf_dir, "lineitem")
    return scan.prefix_lookup(lineitem, l_orderkey=7, l_linenumber=1).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderkey")
def ordered_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return scan.ordered_scan(orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")


@query("SELECT CAST(i AS INT) AS \"colA\", CAST(i * 100 AS INT) AS \"colB\" FROM range(100) t(i)")
def mock_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.mock(spark, "mock_table_1")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(p) AS BIGINT) AS lo, CAST(max(p) AS BIGINT) AS hi, CAST(sum(p) AS BIGINT) AS total FROM (SELECT i % 10 AS p FROM range(5000) t(i))")
def generated_cyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generators.generated(spark, 5000, {"p": generators.cyclic(0, 9)})
    return rows.agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.sum("p").alias("total"))


@query("SELECT 'INSERT INTO region (r_regionkey, r_name) VALUES (' || r_regionkey || ', ''' || r_name || ''');' AS statement FROM region")
def dump_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources import sinks

    (region,) = load(spark, sf_dir, "region")
    value = F.concat(F.lit("INSERT INTO region (r_regionkey, r_name) VALUES ("), F.concat_ws(", ", *[sinks._literal(f.name, f.dataType) for f in region.schema]), F.lit(");"))
    return region.select(value.alias("statement"))


# ---- predicates and scalar expressions --------------------------------------------------------------------------------------

sql_query("filter_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR o_orderpriority = '1-URGENT'")
sql_query("filter_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000)")
sql_query("filter_comparisons", "SELECT p_partkey, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge, p_size = 10 AS eq FROM part")
sql_query(
    "logic_3vl",
    "SELECT a, b, a AND b AS both_hold, a OR b AS one_holds, NOT a AS negated FROM (VALUES (true, true), (true, false), (true, NULL), (false, false), (false, NULL), (NULL, NULL)) AS t(a, b)",
    "SELECT a, b, a AND b AS both_hold, a OR b AS one_holds, NOT a AS negated FROM (VALUES (true, true), (true, false), (true, NULL::BOOLEAN), (false, false), (false, NULL), (NULL::BOOLEAN, NULL)) AS t(a, b)",
)
sql_query("filter_null_3vl", "SELECT event_id FROM events WHERE nullif(event_type, 'error') <> 'click'")
sql_query("in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
sql_query("not_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
sql_query("not_in_null", "SELECT event_id FROM events WHERE nullif(event_type, 'error') NOT IN ('click', 'view')")
sql_query("like_prefix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'p%'")
sql_query("like_suffix", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1'")
sql_query("like_infix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_brand LIKE 'Brand#_%'")
sql_query("not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%A%'")
sql_query("ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%PART%' OR p_type ILIKE '%brass%'")
sql_query("between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15")
sql_query("not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 15")
sql_query("is_null", "SELECT event_id, nullif(event_type, 'error') IS NULL AS no_type, nullif(event_type, 'error') IS NOT NULL AS has_type FROM events")
sql_query("null_safe_eq", "SELECT event_id, nullif(event_type, 'error') IS DISTINCT FROM 'click' AS differs, nullif(event_type, 'error') IS NOT DISTINCT FROM NULL AS absent FROM events")
sql_query("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS word FROM part")
sql_query("coalesce_values", "SELECT event_id, coalesce(nullif(event_type, 'error'), 'none') AS kind FROM events")
sql_query("cast_values", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size_d, CAST(p_partkey AS VARCHAR(20)) AS key_text, CAST('12' AS INT) AS twelve FROM part")
sql_query("unary_minus", "SELECT p_partkey, -p_size AS minus_size, -(p_size - 5) AS minus_more FROM part")
sql_query("arith", "SELECT p_partkey, CAST(p_size + 1 AS BIGINT) AS plus, CAST(p_size - 1 AS BIGINT) AS minus, CAST(p_size * 2 AS BIGINT) AS times, p_size / 4 AS quarter, CAST(p_size % 7 AS BIGINT) AS rest FROM part")
sql_query("concat_strings", "SELECT c_custkey, c_name || '/' || c_mktsegment AS label FROM customer")
sql_query("upper_lower", "SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low FROM customer")
sql_query("order_of_values", "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS high, least(l_discount, l_tax) AS low, round(sqrt(l_quantity), 6) AS root FROM lineitem")
sql_query("ts_vs_string", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00'")
sql_query("parameterised", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_totalprice > 1000.0")


@query("SELECT p_partkey, p_size / nullif(p_size % 3, 0) AS ratio, CAST(p_partkey % nullif(p_size % 3, 0) AS BIGINT) AS rest FROM part")
def safe_div_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = load(spark, sf_dir, "part")
    by = F.col("p_size") % 3
    return part.select("p_partkey", scalar.safe_div(F.col("p_size"), by).alias("ratio"), scalar.safe_mod(F.col("p_partkey"), by.cast("long")).alias("rest"))


@query("SELECT o_orderkey FROM orders WHERE epoch(o_orderdate) >= 800000000")
def ts_vs_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return orders.where(F.col("o_orderdate") >= scalar.epoch(F.lit(800_000_000))).select("o_orderkey")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day_text, CAST(NULL AS TIMESTAMP) AS no_date FROM orders")
def ts_format_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return orders.select("o_orderkey", scalar.format_timestamp(F.col("o_orderdate")).alias("day_text"), scalar.parse_timestamp(F.lit("not a date")).alias("no_date"))


@query("SELECT p_partkey FROM part WHERE CAST(p_partkey AS VARCHAR) LIKE '1%'")
def like_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = load(spark, sf_dir, "part")
    return part.where(scalar.like(F.col("p_partkey"), "1%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15")
def between_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = load(spark, sf_dir, "part")
    return part.where(scalar.between_symmetric(F.col("p_size"), F.lit(15), F.lit(5))).select("p_partkey")


@query("SELECT vec_id, len(embedding) AS dims, round(CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE), 6) AS two FROM embeddings")
def array_ctor(spark: SparkSession, sf_dir: str) -> DataFrame:
    (embeddings,) = load(spark, sf_dir, "embeddings")
    pair = scalar.vector(F.col("embedding")[0], F.col("embedding")[1])
    return embeddings.select("vec_id", F.size("embedding").cast("long").alias("dims"), F.round(pair[0] + pair[1], 6).alias("two"))


# ---- joins ------------------------------------------------------------------------------------------------------------------

sql_query("join_inner", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
sql_query("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 200000")
sql_query("join_full", "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM (SELECT n_nationkey FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey")
sql_query("join_cross", "SELECT r_name, n_name FROM region, nation")
sql_query("join_natural", "SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM nation) b")
sql_query("join_using", "SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) a JOIN (SELECT n_regionkey AS k, n_name FROM nation) b USING (k)")
sql_query("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > n_nationkey * 300")
sql_query("join_theta_left", "SELECT a.r_regionkey AS a_key, b.r_regionkey AS b_key FROM region a LEFT JOIN region b ON a.r_regionkey > b.r_regionkey + 1")
sql_query("join_comma_where", "SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 0")
sql_query("join_multiway", "SELECT c_custkey, o_orderkey, l_linenumber, r_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_quantity > 45")
sql_query("join_bushy", "SELECT c.c_custkey, c.n_name, o.o_orderkey, o.n_lines FROM (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) c JOIN (SELECT o_orderkey, o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey) o ON c.c_custkey = o.o_custkey")
sql_query("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_chained_left", "SELECT r.r_name, n.n_name, s.s_suppkey FROM region r LEFT JOIN (SELECT * FROM nation WHERE n_nationkey > 20) n ON r.r_regionkey = n.n_regionkey LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey")
sql_query("join_empty_side", "SELECT r_name, n_name FROM region LEFT JOIN (SELECT * FROM nation WHERE 1 = 2) n ON r_regionkey = n_regionkey")
sql_query("join_null_keys", "SELECT a.event_id, b.k, b.n FROM (SELECT event_id, nullif(event_type, 'click') AS k FROM events) a JOIN (SELECT nullif(event_type, 'click') AS k, count(*) AS n FROM events GROUP BY nullif(event_type, 'click')) b ON a.k = b.k")
sql_query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
sql_query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")


@query("SELECT a.l_orderkey, a.l_linenumber, a.l_quantity AS q, b.l_tax AS t FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_quantity > 30")
def join_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    (lineitem,) = load(spark, sf_dir, "lineitem")
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a = lineitem.select(*keys, F.col("l_quantity").alias("q"))
    b = lineitem.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("l_tax").alias("t"))
    return joins.equi_join(a, b, [(k, f"b_{k}") for k in keys], residual=F.col("q") > 30).select("l_orderkey", "l_linenumber", "q", "t")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 10")
def index_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, part = load(spark, sf_dir, "lineitem", "part")
    chosen = part.where("p_size = 10").select("p_partkey", "p_name")
    return joins.equi_join(lineitem, chosen, [("l_partkey", "p_partkey")]).select("l_orderkey", "l_linenumber", "p_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = load(spark, sf_dir, "orders", "customer")
    left = orders.select("o_orderkey", F.col("o_custkey").alias("k"))
    right = customer.select(F.col("c_custkey").alias("k"), "c_name")
    return joins.salted_join(left, right, ["k"], 4).select("o_orderkey", "c_name")


@query("SELECT p_partkey, lo FROM part JOIN (VALUES (0, 9), (5, 20), (45, 50)) AS r(lo, hi) ON p_size BETWEEN lo AND hi")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    (part,) = load(spark, sf_dir, "part")
    ranges = spark.createDataFrame([(0, 9), (5, 20), (45, 50)], "lo int, hi int")
    return joins.range_join(part, ranges, "p_size", "lo", "hi", 10).select("p_partkey", "lo")


# ---- aggregation ------------------------------------------------------------------------------------------------------------

sql_query("agg_global", "SELECT count(*) AS n, CAST(min(l_linenumber) AS INT) AS lo, CAST(max(l_linenumber) AS INT) AS hi, CAST(sum(l_linenumber) AS BIGINT) AS total, round(avg(l_quantity), 6) AS mean FROM lineitem")
sql_query("agg_empty", "SELECT count(*) AS n, count(l_tax) AS n_tax, min(l_tax) AS lo, max(l_tax) AS hi, sum(l_tax) AS total FROM lineitem WHERE l_quantity < 0")
sql_query("agg_group_empty", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag")
sql_query("agg_group", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql_query("agg_group_expr", "SELECT p_size % 5 AS bucket, count(*) AS n, min(p_retailprice) AS lo FROM part GROUP BY p_size % 5")
sql_query("agg_expr_of_aggs", "SELECT o_orderstatus, CAST(max(o_custkey) - min(o_custkey) AS BIGINT) + 1 AS span, round(sum(o_totalprice) / count(*), 4) AS mean FROM orders GROUP BY o_orderstatus")
sql_query("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND max(o_totalprice) > 1000")
sql_query("agg_distinct_count", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus")
sql_query("agg_sum_distinct", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS total FROM part")
sql_query("agg_avg", "SELECT nullif(event_type, 'error') AS kind, round(avg(value), 6) AS mean, count(nullif(event_type, 'click')) AS n FROM events GROUP BY nullif(event_type, 'error')")
sql_query("agg_null_group", "SELECT nullif(event_type, 'error') AS kind, count(*) AS n FROM events GROUP BY nullif(event_type, 'error')")
sql_query("agg_nested_subquery", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n")
sql_query("select_distinct", "SELECT DISTINCT p_brand, p_size % 3 AS m FROM part")
sql_query("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
sql_query("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY o_custkey")
def agg_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return aggregates.aggregate(orders, ["o_custkey"], first_price=aggregates.first_by("o_totalprice", "o_orderkey"), last_price=aggregates.last_by("o_totalprice", "o_orderkey"))


@query("SELECT nullif(count(nullif(event_type, event_type)), 0) AS n FROM events")
def agg_count_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return events.select(F.nullif("event_type", "event_type").alias("x")).agg(aggregates.count_or_null("x").alias("n"))


# ---- windows ----------------------------------------------------------------------------------------------------------------

sql_query("win_total", "SELECT n_nationkey, count(*) OVER () AS n, CAST(sum(n_nationkey) OVER () AS BIGINT) AS total, min(n_nationkey) OVER () AS lo, max(n_nationkey) OVER () AS hi FROM nation")
sql_query("win_running", "SELECT n_nationkey, CAST(sum(n_regionkey) OVER (ORDER BY n_nationkey) AS BIGINT) AS running, count(n_regionkey) OVER (ORDER BY n_nationkey) AS n FROM nation")
sql_query("win_partition", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi FROM orders")
sql_query("win_partition_order", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS running FROM orders")
sql_query("win_rank_ties", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS place, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS dense FROM orders")
sql_query("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders")
sql_query("win_mixed_partitions", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS a, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS b FROM orders")
sql_query("win_frame_rows", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near FROM orders")
sql_query("win_frame_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS near FROM orders")
sql_query("win_lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders")
sql_query("win_rank_filter", "SELECT o_custkey, o_orderkey, CAST(place AS BIGINT) AS place FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS place FROM orders) t WHERE place <= 3 ORDER BY o_custkey, t.place, o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return windows.top_per_group(orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)


# ---- order and limits -------------------------------------------------------------------------------------------------------

sql_query("sort_multi", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey")
sql_query("sort_nulls", "SELECT event_id, nullif(event_type, 'error') AS kind FROM events ORDER BY kind DESC NULLS FIRST, event_id")
sql_query("sort_nulls_last", "SELECT event_id, nullif(event_type, 'error') AS kind FROM events ORDER BY kind ASC NULLS LAST, event_id DESC")
sql_query("sort_expr", "SELECT p_partkey, p_size FROM part ORDER BY p_size % 7, p_partkey")
sql_query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35")
sql_query("topn", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
sql_query("topn_nested", "SELECT l_orderkey, l_extendedprice FROM (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50) t ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 5")
sql_query("topn_join", "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) a JOIN (SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5) b ON a.o_orderstatus = b.o_orderstatus")


@query("SELECT event_id, nullif(event_type, 'error') AS kind FROM events ORDER BY kind ASC NULLS FIRST, event_id")
def sort_default_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return events.select("event_id", F.nullif("event_type", F.lit("error")).alias("kind")).orderBy(sorting.order_key("kind"), "event_id")


# ---- subqueries, common tables, sets ----------------------------------------------------------------------------------------

sql_query("subquery_from", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n > 10")
sql_query("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT p.o_custkey, p.n, c.c_name FROM per p JOIN customer c ON p.o_custkey = c.c_custkey")
sql_query("cte_twice", "WITH t AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) SELECT a.k AS a_key, b.k AS b_key FROM t a JOIN t b ON a.k = b.r")
sql_query("cte_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
sql_query("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
sql_query("correlated_subquery", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql_query("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
sql_query("exists_subquery", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
sql_query("set_union", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
sql_query("set_union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
sql_query("set_intersect", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey AS k FROM region")
sql_query("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey AS k FROM region")


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS src, CAST((s_nationkey * 7 + 3) % 25 AS INT) AS dst, CAST(1 + s_nationkey % 4 AS INT) AS d FROM supplier),
one AS (SELECT src, dst, min(d) AS d, 1 AS steps FROM e GROUP BY src, dst),
two AS (SELECT o.src, e.dst, o.d + e.d AS d, 2 AS steps FROM one o JOIN e ON o.dst = e.src),
three AS (SELECT o.src, e.dst, o.d + e.d AS d, 3 AS steps FROM two o JOIN e ON o.dst = e.src),
a AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three),
r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY d, steps) AS n FROM a)
SELECT src, dst, CAST(d AS INT) AS distance, CAST(steps AS INT) AS steps FROM r WHERE n = 1""")
def khop_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    (supplier,) = load(spark, sf_dir, "supplier")
    edges = supplier.select(F.col("s_nationkey").alias("src"), ((F.col("s_nationkey") * 7 + 3) % 25).alias("dst"), (1 + F.col("s_nationkey") % 4).alias("distance")).distinct()
    return paths.k_hops(edges, 3)


# ---- changes ----------------------------------------------------------------------------------------------------------------


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(n_nationkey + 100 AS INT), n_name FROM nation WHERE n_regionkey = 1")
def insert_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = load(spark, sf_dir, "region", "nation")
    return dml.insert(region, nation.where("n_regionkey = 1").select(F.col("n_nationkey") + 100, "n_name"))


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST((SELECT max(r_regionkey) FROM region) + row_number() OVER (ORDER BY n_name) AS INT), n_name FROM nation")
def insert_autoinc(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = load(spark, sf_dir, "region", "nation")
    new = nation.select(F.lit(None).cast("int").alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return region.unionByName(dml.with_keys(region, new, "r_regionkey", ["r_name"]))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    (orders,) = load(spark, sf_dir, "orders")
    return dml.update(orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderstatus") == "P", o_orderstatus=F.lit("X"), o_totalprice=F.col("o_totalprice") + 1)


@query("SELECT event_id, event_type FROM events WHERE coalesce(nullif(event_type, 'error') <> 'click', FALSE) = FALSE")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    (events,) = load(spark, sf_dir, "events")
    return dml.delete(events.select("event_id", "event_type"), F.nullif("event_type", F.lit("error")) != "click")


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)), l AS (SELECT 1 FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
SELECT 'customer' AS table_name, (SELECT count(*) FROM c) AS gone, (SELECT count(*) FROM customer) - (SELECT count(*) FROM c) AS left_over UNION ALL SELECT 'orders', (SELECT count(*) FROM o), (SELECT count(*) FROM orders) - (SELECT count(*) FROM o) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l), (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM l)""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("customer", "orders", "lineitem")
    keys = [dml.ForeignKey("customer", "c_custkey", "orders", "o_custkey"), dml.ForeignKey("orders", "o_orderkey", "lineitem", "l_orderkey")]
    after, gone = dml.delete_cascade(dict(zip(names, load(spark, sf_dir, *names))), keys, "customer", F.col("c_nationkey") == 3)
    parts = [gone[n].agg(F.count("*").alias("gone")).crossJoin(after[n].agg(F.count("*").alias("left_over"))).select(F.lit(n).alias("table_name"), "gone", "left_over") for n in names]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- sketches ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(DISTINCT user_id) AS n_users, TRUE AS is_close, (SELECT count(DISTINCT user_id) FROM events) AS all_users, TRUE AS all_close FROM events GROUP BY event_type")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates of 2^12 registers (a standard error of 1.6 %) are within a tenth of the exact counts, by group and merged."""
    (events,) = load(spark, sf_dir, "events")
    sketch = sketches.distinct_sketch(events, ["event_type"], "user_id")
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_users"))
    near = lambda estimate, n: F.abs(estimate - n) <= 0.1 * n + 1
    merged = sketches.merge_distinct(sketch).crossJoin(events.agg(F.countDistinct("user_id").alias("all_users")))  # a row each
    by_group = sketches.merge_distinct(sketch, ["event_type"]).join(exact, "event_type").select("event_type", "n_users", near(F.col("n_distinct"), F.col("n_users")).alias("is_close"))
    return by_group.crossJoin(merged.select("all_users", near(F.col("n_distinct"), F.col("all_users")).alias("all_close")))


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS never_below, TRUE AS mostly_close FROM events")
def cms_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a count-min sketch promises: no estimate is below the count, and few are above it by more than e / width of all rows."""
    (events,) = load(spark, sf_dir, "events")
    sketch = sketches.CountMin.of(events, "user_id", width=1 << 12, depth=6)
    exact = events.groupBy("user_id").agg(F.count("*").alias("exact"))
    total = events.where("user_id is not null").count()
    both = sketch.count(events.where("user_id is not null"), "user_id").join(exact, "user_id")
    close = F.count_if(F.col("n") - F.col("exact") <= math.ceil(math.e / sketch.width * total)) >= 0.99 * F.count("*")
    return both.agg(F.count("*").alias("users"), F.count_if(F.col("n") >= F.col("exact")).alias("never_below"), close.alias("mostly_close"))


# ---- headline queries -------------------------------------------------------------------------------------------------------

sql_query("leaderboard_join_max", "SELECT count(*) AS n, max(o_totalprice) AS top_price, max(l_extendedprice) AS top_line, min(c_acctbal) AS low_balance FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_acctbal > 100 AND l_quantity < 40")
sql_query("leaderboard_pruned_agg", "SELECT v, a + b AS d FROM (SELECT p_size AS v, CAST(max(p_partkey) AS BIGINT) AS a, CAST(min(p_partkey) AS BIGINT) AS b, round(max(p_retailprice), 2) AS unused FROM part LEFT JOIN (SELECT s_suppkey FROM supplier WHERE 1 = 2) s ON p_partkey < s_suppkey GROUP BY p_size) t")
sql_query("leaderboard_rank_topk", "SELECT p_brand, l_extendedprice, CAST(place AS BIGINT) AS place FROM (SELECT p_brand, l_extendedprice, l_orderkey, l_linenumber, rank() OVER (PARTITION BY p_brand ORDER BY l_extendedprice DESC) AS place FROM lineitem JOIN part ON l_partkey = p_partkey) t WHERE place <= 3 ORDER BY p_brand, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
sql_query("leaderboard_index", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey >= 90 AND l_linenumber = 1")
sql_query("leaderboard_empty_join", "SELECT count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey AND c_custkey = -o_orderkey - 1")
sql_query("retail_inventory_lookup", "SELECT p_partkey, p_name, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS quantity FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_size < 5 GROUP BY p_partkey, p_name")
sql_query("retail_customer_spend", "SELECT c_custkey, c_name, round(sum(l_quantity * l_extendedprice), 2) AS spend, count(*) AS n_lines FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_custkey, c_name ORDER BY spend DESC, c_custkey LIMIT 20")
sql_query("retail_order_trace", "SELECT o_orderkey, o_orderdate, c_name, n_name, p_name, s_name, l_shipdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
