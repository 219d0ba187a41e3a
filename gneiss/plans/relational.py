"""Queries by operator: scans, expressions, joins, aggregates, windows, sorts, set operations,
functions and subqueries.  Where both dialects agree one text serves as query and as oracle."""

from __future__ import annotations

#: name -> SQL that Spark and the oracle both run
SHARED: dict[str, str] = {}
#: name -> (Spark SQL, oracle SQL)
TWO: dict[str, tuple[str, str]] = {}

SHARED["scan_project_filter"] = """
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= date '1996-01-01' AND l_shipdate < date '1997-01-01' AND l_discount > 0.02"""
SHARED["filter_between_in_like"] = """
SELECT p_partkey, p_brand, p_type, p_size FROM part
WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#1', 'Brand#3', 'Brand#12') AND p_type LIKE 'P%' AND p_name NOT LIKE '%zzz%'"""
SHARED["filter_is_null"] = """
SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) t
WHERE x IS NULL OR (x IS NOT NULL AND o_orderkey % 11 = 0)"""
SHARED["filter_or_common_factor"] = """
SELECT l_orderkey, l_partkey, l_quantity, p_brand FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
   OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)"""
SHARED["case_pivot"] = """
SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_count,
       CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_count
FROM orders GROUP BY o_orderstatus"""
SHARED["constant_empty"] = "SELECT r_regionkey, r_name FROM region WHERE 1 = 0"
SHARED["constant_row"] = "SELECT CAST(1 AS BIGINT) AS one, 'x' AS letter"
SHARED["arithmetic"] = "SELECT l_orderkey, l_linenumber, l_quantity, round(-l_quantity + 2 * l_discount - l_tax / 3, 6) AS a, CAST(l_orderkey % 7 AS BIGINT) AS m FROM lineitem WHERE l_orderkey < 3000"
SHARED["date_interval"] = """
SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= date '1997-07-01' AND o_orderdate < date '1997-07-01' + interval '3' month
UNION ALL SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= date '1999-01-01' AND o_orderdate < date '1999-01-01' + interval '5' day"""
SHARED["string_date_coercion"] = "SELECT o_orderkey FROM orders WHERE o_orderdate >= '2000-06-01' AND o_orderdate < '2000-07-01'"
SHARED["derived_column_aliases"] = "SELECT c_count, count(*) AS custdist FROM (SELECT o_custkey, count(o_orderkey) FROM orders GROUP BY o_custkey) AS t(custkey, c_count) GROUP BY c_count"
SHARED["group_by_alias_literal"] = "SELECT 1 AS one, extract(year FROM o_orderdate) + 0 AS yr, count(*) AS n FROM orders GROUP BY 1, 2".replace("1 AS one", "CAST(1 AS BIGINT) AS one").replace("extract(year FROM o_orderdate) + 0", "CAST(extract(year FROM o_orderdate) AS BIGINT)")
SHARED["having"] = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12"

# joins
SHARED["join_left"] = "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"
SHARED["join_right"] = "SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c RIGHT JOIN orders ON c_custkey = o_custkey"
SHARED["join_full"] = """
SELECT a.c_custkey AS left_key, b.o_custkey AS right_key, b.n FROM (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) a
FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey) b ON a.c_custkey = b.o_custkey"""
SHARED["join_full_theta"] = "SELECT n_name, r_name FROM nation FULL JOIN region ON n_regionkey < r_regionkey AND r_regionkey > 2"
SHARED["join_nested_loop"] = "SELECT s.s_suppkey AS s1, t.s_suppkey AS s2 FROM supplier s JOIN supplier t ON s.s_acctbal < t.s_acctbal - 9000"
SHARED["join_cross"] = "SELECT n_name, r_name FROM nation CROSS JOIN region"
SHARED["join_residual"] = "SELECT l_orderkey, l_linenumber, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate > o_orderdate + interval '1000' day"
SHARED["join_semi_in"] = "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)"
SHARED["join_semi_exists"] = "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"
SHARED["join_anti_exists"] = "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"
SHARED["join_anti_not_in"] = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
SHARED["join_anti_not_in_null"] = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT CASE WHEN l_orderkey = 1 THEN NULL ELSE l_orderkey END FROM lineitem)"
SHARED["join_exists_or_exists"] = """
SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus = 'P' AND o_totalprice > 350000)
OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice < 5000)"""
SHARED["join_self_nonequi"] = """
SELECT DISTINCT l1.l_orderkey, l1.l_suppkey FROM lineitem l1 WHERE l1.l_returnflag = 'R'
AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')"""

# aggregates
SHARED["agg_two_phase"] = "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p FROM lineitem GROUP BY l_suppkey"
SHARED["agg_global"] = "SELECT count(*) AS n, count(l_tax) AS m, round(sum(l_extendedprice), 2) AS s, round(avg(l_quantity), 6) AS a FROM lineitem"
SHARED["agg_global_empty"] = "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_shipdate) AS d FROM lineitem WHERE l_quantity < 0"
SHARED["agg_distinct"] = "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type"
SHARED["agg_multi_distinct"] = "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p, count(DISTINCT l_orderkey) AS o, count(*) AS n FROM lineitem GROUP BY l_returnflag"
SHARED["agg_minmax"] = "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day, min(o_orderstatus) AS st FROM orders GROUP BY o_orderpriority"
SHARED["agg_stddev"] = "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cov FROM lineitem GROUP BY l_returnflag"
TWO["agg_first_value"] = (
    "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order, min_by(o_totalprice, struct(o_orderdate, o_orderkey)) AS first_price FROM orders GROUP BY o_custkey",
    "SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER w AS first_order, first_value(o_totalprice) OVER w AS first_price FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
SHARED["agg_filter"] = "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, round(sum(value) FILTER (WHERE value <= 50), 4) AS small FROM events GROUP BY event_type"
SHARED["agg_rollup"] = """
SELECT r_name, n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS bal
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP(r_name, n_name, c_mktsegment)"""
SHARED["agg_grouping_id"] = """
SELECT r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS lochierarchy, count(*) AS n
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP(r_name, n_name)"""
SHARED["agg_cube"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE(o_orderstatus, o_orderpriority)"
SHARED["agg_grouping_sets"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"
SHARED["agg_limit"] = "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10"
SHARED["select_distinct"] = "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"
SHARED["agg_no_columns"] = "SELECT (SELECT count(*) FROM region) AS n FROM nation GROUP BY n_regionkey"

# windows
SHARED["win_rank"] = "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk FROM orders"
SHARED["win_row_number"] = "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders"
SHARED["win_total_share"] = """
SELECT p_brand, p_type, round(sum(p_retailprice), 2) AS rev, round(sum(p_retailprice) * 100 / sum(sum(p_retailprice)) OVER (PARTITION BY p_brand), 6) AS share
FROM part GROUP BY p_brand, p_type"""
SHARED["win_running_rows"] = """
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS run,
       max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM orders"""
SHARED["win_avg_of_sum"] = """
SELECT yr, mon, o_orderpriority, total, round(avg(total) OVER (PARTITION BY o_orderpriority, yr ORDER BY mon ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 2) AS avg_monthly FROM (
  SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS yr, CAST(extract(month FROM o_orderdate) AS BIGINT) AS mon, o_orderpriority, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY 1, 2, 3) t"""
SHARED["win_rank_rollup"] = """
SELECT r_name, n_name, lochierarchy, bal, CAST(rank() OVER (PARTITION BY lochierarchy, CASE WHEN lochierarchy = 0 THEN r_name END ORDER BY bal DESC) AS BIGINT) AS rk FROM (
  SELECT r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS lochierarchy, round(sum(s_acctbal), 2) AS bal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP(r_name, n_name)) t"""
SHARED["win_rank_filter"] = "SELECT o_custkey, o_orderkey, rk FROM (SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS BIGINT) AS rk FROM orders) t WHERE rk <= 2"
SHARED["win_more"] = """
SELECT o_custkey, o_orderkey, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, lag(o_orderkey) OVER w AS before, lead(o_orderkey) OVER w AS after
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""

# sorts and limits
SHARED["sort_full"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"
SHARED["topk"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"
SHARED["limit_offset"] = "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 100"
SHARED["limit_of_union"] = "SELECT k FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier) t ORDER BY k DESC LIMIT 20"
SHARED["sort_nulls"] = """
SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) t
ORDER BY x ASC NULLS LAST, o_orderkey DESC NULLS FIRST LIMIT 50"""
SHARED["sort_nulls_first"] = """
SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) t
ORDER BY x DESC NULLS FIRST, o_orderkey LIMIT 50"""

# set operations
SHARED["union_all"] = "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"
SHARED["union_distinct"] = "SELECT c_nationkey AS k FROM customer WHERE c_custkey < 40 UNION SELECT s_nationkey FROM supplier WHERE s_suppkey < 10"
SHARED["union_nested"] = "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL (SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation)) t GROUP BY k"
SHARED["intersect"] = "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000"
SHARED["except_chain"] = """
SELECT o_custkey FROM orders WHERE o_totalprice > 100000 EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"""
SHARED["intersect_all"] = "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"
SHARED["except_all"] = "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"

# functions
SHARED["fn_substring"] = "SELECT c_custkey, substring(c_name FROM 1 FOR 4) AS a, substring(c_name, 3, 5) AS b FROM customer"
TWO["fn_concat_coalesce"] = (
    "SELECT c_custkey, concat_ws('', 'c-', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END) AS a, coalesce(CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END, 'none') AS b FROM customer",
    "SELECT c_custkey, concat('c-', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END) AS a, coalesce(CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END, 'none') AS b FROM customer",
)
SHARED["fn_upper_lower_length"] = "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, CAST(length(p_name) AS BIGINT) AS n FROM part"
TWO["fn_regexp_replace"] = (
    "SELECT page_id, regexp_replace(url, '^https?://(?:www[.])?([^/]+)/.*$', '$1') AS host FROM pages",
    r"SELECT page_id, regexp_replace(url, '^https?://(?:www[.])?([^/]+)/.*$', '\1') AS host FROM pages",
)
SHARED["fn_extract_trunc"] = """
SELECT event_id, CAST(extract(year FROM ts) AS BIGINT) AS y, CAST(extract(minute FROM ts) AS BIGINT) AS m, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS t FROM events"""
TWO["fn_extract_trunc"] = (SHARED.pop("fn_extract_trunc").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)"), "SELECT event_id, extract(year FROM ts) AS y, extract(minute FROM ts) AS m, date_trunc('minute', ts) AS t FROM events")
TWO["fn_date_bin"] = (
    "SELECT bin, event_type, max(value) AS top FROM (SELECT date_bin(INTERVAL '30 seconds', ts) AS bin, event_type, value FROM events) t GROUP BY bin, event_type",
    "SELECT time_bucket(INTERVAL '30 seconds', ts) AS bin, event_type, max(value) AS top FROM events GROUP BY 1, 2",
)
TWO["fn_date_bin_origin"] = (
    "SELECT date_bin(INTERVAL '7 days', ts, TIMESTAMP_NTZ '2001-01-03 05:00:00') AS bin, count(*) AS n FROM events GROUP BY 1",
    "SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '2001-01-03 05:00:00') AS bin, count(*) AS n FROM events GROUP BY 1",
)
TWO["fn_date_bin_months"] = (
    "SELECT date_bin(INTERVAL '3 months', o_orderdate, TIMESTAMP_NTZ '1999-02-01 00:00:00') AS bin, count(*) AS n FROM (SELECT CAST(o_orderdate AS TIMESTAMP_NTZ) AS o_orderdate FROM orders) o GROUP BY 1",
    "SELECT time_bucket(INTERVAL '3 months', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '1999-02-01') AS bin, count(*) AS n FROM orders GROUP BY 1",
)
TWO["fn_to_timestamp_seconds"] = (
    "SELECT o_orderkey, to_timestamp_seconds(o_orderkey * 3600) AS t FROM orders",
    "SELECT o_orderkey, make_timestamp(o_orderkey * 3600 * 1000000) AS t FROM orders",
)
TWO["dialect_division"] = (
    "SELECT o_orderkey / 7 AS q, 7 / 2 AS three, 7 / 2.0 AS more, o.o_orderkey / o.o_custkey AS ratio, o_totalprice / 2 AS half FROM orders o WHERE o_custkey > 0",
    "SELECT o_orderkey // 7 AS q, 7 // 2 AS three, 7 / 2.0 AS more, o.o_orderkey // o.o_custkey AS ratio, o_totalprice / 2 AS half FROM orders o WHERE o_custkey > 0",
)
TWO["dialect_null_order_asc"] = (
    "SELECT k, v FROM (SELECT n_nationkey AS k, nullif(n_nationkey % 5, 0) AS v FROM nation) t ORDER BY v, k LIMIT 22",
    "SELECT k, v FROM (SELECT n_nationkey AS k, nullif(n_nationkey % 5, 0) AS v FROM nation) t ORDER BY v NULLS LAST, k LIMIT 22",
)
TWO["dialect_null_order_desc"] = (
    "SELECT k, v FROM (SELECT n_nationkey AS k, nullif(n_nationkey % 5, 0) AS v FROM nation) t ORDER BY v DESC, k LIMIT 7",
    "SELECT k, v FROM (SELECT n_nationkey AS k, nullif(n_nationkey % 5, 0) AS v FROM nation) t ORDER BY v DESC NULLS FIRST, k LIMIT 7",
)
SHARED["dialect_quoted_identifiers"] = 'SELECT "n_name" AS "The Name", "t"."K 1" AS k FROM (SELECT n_name, n_nationkey AS "K 1" FROM nation) AS "t" WHERE "K 1" < 9'
SHARED["dialect_concat_nulls"] = "SELECT n_nationkey, concat('<', nullif(n_name, 'NATION_3'), NULL, '>') AS c, concat(n_name, n_regionkey) AS d FROM nation"
SHARED["lenient_casts"] = "SELECT try_cast(substring(c_name, 10, 3) AS INTEGER) AS a, try_cast(c_mktsegment AS INTEGER) AS b, count(*) AS n FROM customer GROUP BY 1, 2"
SHARED["agg_limit_unordered"] = "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey LIMIT 10) t"
TWO["agg_approx_distinct"] = (
    "SELECT event_type, abs(approx_count_distinct(user_id, 0.02) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS near FROM events GROUP BY event_type",
    "SELECT DISTINCT event_type, true AS near FROM events",
)
TWO["agg_approx_percentile"] = (
    "SELECT l_returnflag, abs(percentile_approx(l_quantity, 0.5, 10000) - percentile(l_quantity, 0.5)) <= 1 AS near FROM lineitem GROUP BY l_returnflag",
    "SELECT DISTINCT l_returnflag, true AS near FROM lineitem",
)
SHARED["fn_round_abs"] = "SELECT s_suppkey, round(abs(s_acctbal - 5000), 2) AS a FROM supplier"
SHARED["fn_cast_decimal"] = "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(15, 4)) AS DOUBLE) AS d, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey AS INTEGER) AS i FROM orders"
TWO["fn_integer_division"] = (
    "SELECT o_orderkey, o_orderkey div 7 AS q, o_orderkey % 7 AS r FROM orders",
    "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r FROM orders",
)
TWO["fn_json_property"] = (
    "SELECT event_id, CAST(length(props) AS BIGINT) AS n, get_json_object(props, '$.k') AS k FROM events",
    "SELECT event_id, CAST(length(props) AS BIGINT) AS n, json_extract_string(props, '$.k') AS k FROM events",
)
TWO["fn_array_fold"] = (
    "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, round(sqrt(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm FROM embeddings",
    "SELECT vec_id, len(embedding) AS n, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings",
)

# subqueries
SHARED["sub_scalar"] = "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders)"
SHARED["sub_scalar_select_case"] = "SELECT s_suppkey, CASE WHEN s_acctbal > (SELECT avg(s_acctbal) FROM supplier) THEN 'above' ELSE 'below' END AS side, (SELECT count(*) FROM region) AS n FROM supplier"
SHARED["sub_correlated"] = "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)"
SHARED["sub_in_nested"] = """
SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey IN
 (SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50)) AND l_quantity > 45)"""
SHARED["sub_having"] = """
SELECT l_suppkey, round(sum(l_extendedprice), 2) AS v FROM lineitem GROUP BY l_suppkey
HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.0105 FROM lineitem)"""
SHARED["cte_multi_ref"] = """
WITH spent AS (SELECT o_custkey AS k, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey)
SELECT c_custkey, round(total, 2) AS total FROM spent JOIN customer ON k = c_custkey WHERE total > (SELECT avg(total) * 1.5 FROM spent)"""
SHARED["cte_chain"] = """
WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT n_regionkey, count(*) AS n FROM a GROUP BY n_regionkey), c AS (SELECT r_name, n FROM b JOIN region ON r_regionkey = n_regionkey)
SELECT x.r_name, x.n, y.n AS m FROM c x JOIN c y ON x.r_name = y.r_name"""
