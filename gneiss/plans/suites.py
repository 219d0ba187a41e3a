"""Suites in the shape of the public decision-support and click-stream benchmarks, on our tables."""

from __future__ import annotations

PS = "partsupp"

TPCH: dict[str, str] = {
    "tpch_q1": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= date '2001-08-05' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q2": f"""
SELECT s_acctbal, s_name, n_name, p_partkey, round(ps_supplycost, 4) AS cost FROM part, supplier, {PS} ps, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type LIKE '%O' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
AND ps_supplycost = (SELECT min(ps2.ps_supplycost) FROM {PS} ps2, supplier, nation, region WHERE p_partkey = ps2.ps_partkey AND s_suppkey = ps2.ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q3": """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < date '1998-03-15' AND l_shipdate > date '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": """
SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= date '1997-07-01' AND o_orderdate < date '1997-07-01' + interval '3' month
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q5": """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
AND r_name = 'ASIA' AND o_orderdate >= date '1996-01-01' AND o_orderdate < date '1996-01-01' + interval '1' year GROUP BY n_name ORDER BY revenue DESC""",
    "tpch_q6": """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= date '1997-01-01' AND l_shipdate < date '1997-01-01' + interval '1' year AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q7": """
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(year FROM l_shipdate) AS BIGINT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
  AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1')) AND l_shipdate BETWEEN date '1996-01-01' AND date '1997-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q8": """
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
  AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN date '1996-01-01' AND date '1999-12-31' AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""",
    "tpch_q9": f"""
SELECT nation, o_year, round(sum(amount), 2) AS sum_profit FROM (
  SELECT n_name AS nation, CAST(extract(year FROM o_orderdate) AS BIGINT) AS o_year, l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity AS amount
  FROM part, supplier, lineitem, {PS} ps, orders, nation WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_type LIKE 'P%') profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "tpch_q10": """
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= date '1997-10-01' AND o_orderdate < date '1997-10-01' + interval '3' month AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 2) AS value FROM {PS} ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_2'
GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.002 FROM {PS} ps, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_2')
ORDER BY value DESC, ps_partkey""",
    "tpch_q12": """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= date '1997-01-01' AND l_shipdate < date '1998-01-01' GROUP BY l_linestatus ORDER BY l_linestatus""",
    "tpch_q13": """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders(c_custkey, c_count)
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": """
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= date '1997-09-01' AND l_shipdate < date '1997-09-01' + interval '1' month""",
    "tpch_q15": """
WITH revenue(supplier_no, total_revenue) AS (SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) FROM lineitem WHERE l_shipdate >= date '1998-01-01' AND l_shipdate < date '1998-01-01' + interval '3' month GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": f"""
SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM {PS} ps, part WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'PRO%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": """
SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    "tpch_q18": """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": """
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, part
WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 25)
OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 30) OR (p_partkey = l_partkey AND p_brand = 'Brand#4' AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 35)""",
    "tpch_q20": f"""
SELECT s_name, s_acctbal FROM supplier, nation WHERE s_suppkey IN (SELECT ps_suppkey FROM {PS} ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'P%')
AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= date '1997-01-01' AND l_shipdate < date '1997-01-01' + interval '1' year))
AND s_nationkey = n_nationkey AND n_name = 'NATION_2' ORDER BY s_name""",
    "tpch_q21": """
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_shipdate > o_orderdate
AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
AND s_nationkey = n_nationkey AND n_regionkey = 1 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (SELECT substring(c_name, 12, 2) AS cntrycode, c_acctbal, c_custkey FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)) custsale GROUP BY cntrycode ORDER BY cntrycode""",
}

CLICKS: dict[str, str] = {
    "cb_0": "SELECT count(*) AS n FROM events",
    "cb_1": "SELECT count(*) AS n FROM events WHERE value <> 0",
    "cb_2": "SELECT round(sum(value), 2) AS s, count(*) AS n, round(avg(user_id), 6) AS a FROM events",
    "cb_3": "SELECT round(avg(user_id), 6) AS a FROM events",
    "cb_4": "SELECT count(DISTINCT user_id) AS n FROM events",
    "cb_5": "SELECT count(DISTINCT event_type) AS n FROM events",
    "cb_6": "SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events",
    "cb_7": "SELECT event_type, count(*) AS n FROM events WHERE value > 1 GROUP BY event_type ORDER BY n DESC, event_type",
    "cb_8": "SELECT event_type, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "cb_9": "SELECT event_type, round(sum(value), 2) AS s, count(*) AS n, round(avg(value), 4) AS a, count(DISTINCT user_id) AS u FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10",
    "cb_10": "SELECT event_type, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "cb_11": "SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT user_id) AS u FROM events WHERE props <> '' GROUP BY event_type, CAST(ts AS DATE) ORDER BY u DESC, event_type, day LIMIT 10",
    "cb_13": "SELECT event_type, count(DISTINCT user_id) AS u FROM events WHERE event_type <> '' GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "cb_15": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "cb_16": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 15",
    "cb_17": "SELECT count(*) AS n FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type) t",
    "cb_22": "SELECT event_type, min(props) AS p, min(user_id) AS u, count(*) AS n, count(DISTINCT user_id) AS d FROM events WHERE props LIKE '%2%' AND props NOT LIKE '%.9%' AND event_type <> '' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10",
    "cb_25": "SELECT event_type FROM events WHERE event_type <> '' ORDER BY event_type, event_id LIMIT 10",
    "cb_31": "SELECT event_id, user_id, count(*) AS c, round(sum(value), 4) AS s, round(avg(value), 4) AS a FROM events WHERE event_type <> '' GROUP BY event_id, user_id ORDER BY c DESC, event_id, user_id LIMIT 10",
    "cb_32": "SELECT event_id, user_id, count(*) AS c, round(sum(value), 4) AS s, round(avg(value), 4) AS a FROM events GROUP BY event_id, user_id ORDER BY c DESC, event_id, user_id LIMIT 10",
    "cb_37": "SELECT props, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= '2024-01-05' AND CAST(ts AS DATE) <= '2024-01-25' AND value > 5 AND props <> '' GROUP BY props ORDER BY n DESC, props LIMIT 10",
    "cb_41": "SELECT CAST(extract(hour FROM ts) AS BIGINT) AS w, CAST(extract(day FROM ts) AS BIGINT) AS h, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= '2024-01-02' AND value < 80 GROUP BY 1, 2 ORDER BY n DESC, w, h LIMIT 10 OFFSET 20",
    "cb_12": "SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "cb_14": "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10",
    "cb_18": "SELECT user_id, CAST(extract(minute FROM ts) AS BIGINT) AS m, event_type, count(*) AS n FROM events GROUP BY user_id, m, event_type ORDER BY n DESC, user_id, m, event_type LIMIT 10",
    "cb_19": "SELECT event_id FROM events WHERE user_id = 42",
    "cb_20": "SELECT count(*) AS n FROM pages WHERE url LIKE '%example.com%'",
    "cb_21": "SELECT event_type, min(props) AS p, count(*) AS n FROM events WHERE props LIKE '%1%' AND event_type <> '' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10",
    "cb_23": "SELECT event_id, ts, user_id, event_type, value, props FROM events WHERE props LIKE '%7%' ORDER BY ts, event_id LIMIT 10",
    "cb_24": "SELECT event_type, event_id FROM events ORDER BY ts, event_id LIMIT 10",
    "cb_26": "SELECT event_type, event_id FROM events ORDER BY ts, event_type, event_id LIMIT 10",
    "cb_27": "SELECT user_id, round(avg(length(props)), 6) AS l, count(*) AS c FROM events WHERE props <> '' GROUP BY user_id HAVING count(*) > 8 ORDER BY l DESC, user_id LIMIT 25",
    "cb_29": "SELECT " + ", ".join(f"CAST(sum(user_id + {i}) AS BIGINT) AS s{i}" for i in range(30)) + " FROM events",
    "cb_30": "SELECT event_type, user_id, count(*) AS c, round(sum(value), 4) AS s, round(avg(value), 4) AS a FROM events GROUP BY event_type, user_id ORDER BY c DESC, event_type, user_id LIMIT 10",
    "cb_33": "SELECT url, count(*) AS c FROM pages GROUP BY url ORDER BY c DESC, url LIMIT 10",
    "cb_34": "SELECT CAST(1 AS BIGINT) AS one, url, count(*) AS c FROM pages GROUP BY 1, url ORDER BY c DESC, url LIMIT 10",
    "cb_35": "SELECT user_id, user_id - 1 AS u1, user_id - 2 AS u2, user_id - 3 AS u3, count(*) AS c FROM events GROUP BY user_id, user_id - 1, user_id - 2, user_id - 3 ORDER BY c DESC, user_id LIMIT 10",
    "cb_36": "SELECT user_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= '2024-01-05' AND CAST(ts AS DATE) <= '2024-01-25' AND value > 5 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "cb_38": "SELECT user_id, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= '2024-01-02' GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10 OFFSET 50",
    "cb_39": "SELECT event_type, CASE WHEN value > 50 AND user_id > 100 THEN event_type ELSE '' END AS src, count(*) AS n FROM events GROUP BY event_type, CASE WHEN value > 50 AND user_id > 100 THEN event_type ELSE '' END ORDER BY n DESC, event_type, src LIMIT 10",
    "cb_40": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id, CAST(ts AS DATE) ORDER BY n DESC, user_id, day LIMIT 10 OFFSET 10",
}
CLICKS_TWO: dict[str, tuple[str, str]] = {
    "cb_28": (
        "SELECT regexp_replace(url, '^https?://(?:www[.])?([^/]+)/.*$', '$1') AS k, round(avg(length(url)), 4) AS l, count(*) AS c, min(url) AS u FROM pages GROUP BY 1 HAVING count(*) > 1 ORDER BY l DESC, k LIMIT 25",
        r"SELECT regexp_replace(url, '^https?://(?:www[.])?([^/]+)/.*$', '\1') AS k, round(avg(length(url)), 4) AS l, count(*) AS c, min(url) AS u FROM pages GROUP BY 1 HAVING count(*) > 1 ORDER BY l DESC, k LIMIT 25",
    ),
    "cb_42": (
        "SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP_NTZ) AS m, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= '2024-01-14' AND CAST(ts AS DATE) <= '2024-01-15' GROUP BY 1 ORDER BY m LIMIT 10 OFFSET 100",
        "SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= '2024-01-14' AND CAST(ts AS DATE) <= '2024-01-15' GROUP BY 1 ORDER BY m LIMIT 10 OFFSET 100",
    ),
}

_SALES = "(SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, o_custkey, o_orderdate, CAST(extract(year FROM o_orderdate) AS BIGINT) AS d_year, CAST(extract(month FROM o_orderdate) AS BIGINT) AS d_moy FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

STAR: dict[str, str] = {
    "ds_q1": f"""
WITH r AS (SELECT o_custkey AS k, l_suppkey AS s, sum(l_extendedprice) AS total FROM {_SALES} x WHERE d_year = 1998 GROUP BY o_custkey, l_suppkey)
SELECT c_name, s, round(total, 2) AS total FROM r r1, customer WHERE total > (SELECT avg(total) * 2.2 FROM r r2 WHERE r1.s = r2.s) AND r1.k = c_custkey ORDER BY c_name, s LIMIT 100""",
    "ds_q2": f"""
WITH w AS (SELECT d_year, d_moy, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS hi, round(sum(CASE WHEN l_discount <= 0.05 THEN l_extendedprice ELSE 0 END), 2) AS lo FROM {_SALES} x GROUP BY d_year, d_moy)
SELECT a.d_moy, round(a.hi / b.hi, 2) AS r1, round(a.lo / b.lo, 2) AS r2 FROM w a, w b WHERE a.d_year = 1997 AND b.d_year = 1998 AND a.d_moy = b.d_moy ORDER BY a.d_moy NULLS FIRST""",
    "ds_q5": """
SELECT channel, id, round(sum(sales), 2) AS sales FROM (
 SELECT 'customer' AS channel, concat('c', CAST(o_custkey % 5 AS VARCHAR(10))) AS id, o_totalprice AS sales FROM orders
 UNION ALL SELECT 'supplier', concat('s', CAST(l_suppkey % 5 AS VARCHAR(10))), l_extendedprice FROM lineitem) t GROUP BY ROLLUP(channel, id) ORDER BY channel NULLS FIRST, id NULLS FIRST LIMIT 100""",
    "ds_q9": """
SELECT CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) > 100 THEN (SELECT round(avg(l_extendedprice), 4) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) ELSE (SELECT round(avg(l_tax), 6) FROM lineitem WHERE l_quantity BETWEEN 1 AND 20) END AS bucket1,
CASE WHEN (SELECT count(*) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) > 1000000000 THEN (SELECT round(avg(l_extendedprice), 4) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) ELSE (SELECT round(avg(l_tax), 6) FROM lineitem WHERE l_quantity BETWEEN 21 AND 40) END AS bucket2
FROM region WHERE r_regionkey = 1""",
    "ds_q10": f"""
SELECT c_mktsegment, count(*) AS cnt FROM customer c WHERE EXISTS (SELECT 1 FROM {_SALES} x WHERE c.c_custkey = o_custkey AND d_year = 1997 AND d_moy BETWEEN 1 AND 4)
AND (EXISTS (SELECT 1 FROM {_SALES} x WHERE c.c_custkey = o_custkey AND d_year = 1998 AND d_moy < 3) OR EXISTS (SELECT 1 FROM {_SALES} x WHERE c.c_custkey = o_custkey AND d_year = 1999 AND l_quantity > 49))
GROUP BY c_mktsegment ORDER BY c_mktsegment LIMIT 100""",
    "ds_q12": f"""
SELECT p_brand, p_type, round(sum(l_extendedprice), 2) AS itemrevenue, round(sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_type), 6) AS revenueratio
FROM {_SALES} x, part WHERE l_partkey = p_partkey AND d_year = 1999 AND d_moy = 2 GROUP BY p_brand, p_type ORDER BY p_type, p_brand LIMIT 100""",
    "ds_q14": """
WITH cross_items AS (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'),
avg_sales AS (SELECT avg(l_quantity * l_extendedprice) AS average FROM lineitem)
SELECT l_returnflag, p_brand, round(sum(l_quantity * l_extendedprice), 2) AS sales, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey IN (SELECT k FROM cross_items)
GROUP BY ROLLUP(l_returnflag, p_brand) HAVING sum(l_quantity * l_extendedprice) > (SELECT average FROM avg_sales) ORDER BY l_returnflag NULLS FIRST, p_brand NULLS FIRST LIMIT 100""",
    "ds_q17": f"""
SELECT p_type, count(l_quantity) AS n, round(avg(l_quantity), 4) AS a, round(stddev_samp(l_quantity), 4) AS sd, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cov FROM {_SALES} x JOIN part ON l_partkey = p_partkey GROUP BY p_type ORDER BY p_type NULLS FIRST LIMIT 100""",
    "ds_q18": """
SELECT r_name, n_name, round(avg(CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS DOUBLE)), 4) AS agg1, count(*) AS n FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ROLLUP(r_name, n_name) ORDER BY r_name NULLS FIRST, n_name NULLS FIRST LIMIT 100""",
    "ds_q36": """
WITH results AS (SELECT p_brand, p_type, sum(p_retailprice) / sum(p_size) AS margin, 0 AS t FROM part GROUP BY p_brand, p_type), merged AS (
SELECT margin, p_brand, p_type, t FROM results UNION SELECT sum(p_retailprice) / sum(p_size), p_brand, NULL, 1 FROM part GROUP BY p_brand)
SELECT round(margin, 6) AS margin, p_brand, p_type, CAST(t AS BIGINT) AS lochierarchy, CAST(rank() OVER (PARTITION BY t, CASE WHEN t = 0 THEN p_brand END ORDER BY margin) AS BIGINT) AS rk FROM merged ORDER BY lochierarchy DESC, p_brand NULLS FIRST, rk, p_type LIMIT 100""",
    "ds_q38": """
SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_totalprice > 50000 INTERSECT SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus <> 'P') t""",
    "ds_q39": f"""
WITH inv AS (SELECT l_suppkey, d_moy, mean, CASE WHEN mean = 0 THEN NULL ELSE sd / mean END AS cov FROM (SELECT l_suppkey, d_moy, stddev_samp(l_quantity) AS sd, avg(l_quantity) AS mean FROM {_SALES} x WHERE d_year = 1998 GROUP BY l_suppkey, d_moy) t WHERE CASE WHEN mean = 0 THEN 0 ELSE sd / mean END > 0.55)
SELECT a.l_suppkey, a.d_moy AS m1, b.d_moy AS m2, round(a.cov, 6) AS c1, round(b.cov, 6) AS c2 FROM inv a, inv b WHERE a.l_suppkey = b.l_suppkey AND a.d_moy = 1 AND b.d_moy = 2""",
    "ds_q44": """
SELECT a.rnk, a.p AS best, b.p AS worst FROM (SELECT p, rnk FROM (SELECT p, CAST(rank() OVER (ORDER BY v, p) AS BIGINT) AS rnk FROM (SELECT l_partkey AS p, avg(l_extendedprice) AS v FROM lineitem GROUP BY l_partkey HAVING avg(l_extendedprice) > 0.9 * (SELECT avg(l_extendedprice) FROM lineitem WHERE l_discount IS NOT NULL)) v1) v11 WHERE rnk < 11) a,
(SELECT p, rnk FROM (SELECT p, CAST(rank() OVER (ORDER BY v DESC, p) AS BIGINT) AS rnk FROM (SELECT l_partkey AS p, avg(l_extendedprice) AS v FROM lineitem GROUP BY l_partkey) v2) v21 WHERE rnk < 11) b WHERE a.rnk = b.rnk ORDER BY a.rnk""",
    "ds_q47": f"""
WITH v1 AS (SELECT p_brand, d_year, d_moy, sum(l_extendedprice) AS s, avg(sum(l_extendedprice)) OVER (PARTITION BY p_brand, d_year) AS a, CAST(rank() OVER (PARTITION BY p_brand ORDER BY d_year, d_moy) AS BIGINT) AS rn
 FROM {_SALES} x JOIN part ON l_partkey = p_partkey GROUP BY p_brand, d_year, d_moy)
SELECT v1.p_brand, v1.d_year, v1.d_moy, round(v1.a, 0) AS a, round(v1.s, 2) AS s, round(lg.s, 2) AS psum, round(ld.s, 2) AS nsum FROM v1, v1 lg, v1 ld
WHERE v1.p_brand = lg.p_brand AND v1.p_brand = ld.p_brand AND v1.rn = lg.rn + 1 AND v1.rn = ld.rn - 1 AND v1.d_year = 1998 AND CASE WHEN v1.a > 0 THEN abs(v1.s - v1.a) / v1.a ELSE NULL END > 0.1 ORDER BY v1.p_brand, v1.d_moy LIMIT 100""",
    "ds_q51": f"""
WITH a AS (SELECT o_custkey AS k, d_year AS y, round(sum(sum(l_quantity)) OVER (PARTITION BY o_custkey ORDER BY d_year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS cume FROM {_SALES} x WHERE l_discount > 0.06 GROUP BY o_custkey, d_year),
b AS (SELECT o_custkey AS k, d_year AS y, round(sum(sum(l_quantity)) OVER (PARTITION BY o_custkey ORDER BY d_year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS cume FROM {_SALES} x WHERE l_discount < 0.03 GROUP BY o_custkey, d_year)
SELECT k, y, ac, bc FROM (SELECT k, y, ac, bc, max(ac) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS am, max(bc) OVER (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bm FROM (
 SELECT CASE WHEN a.k IS NOT NULL THEN a.k ELSE b.k END AS k, CASE WHEN a.y IS NOT NULL THEN a.y ELSE b.y END AS y, a.cume AS ac, b.cume AS bc FROM a FULL OUTER JOIN b ON a.k = b.k AND a.y = b.y) x) y WHERE am > bm ORDER BY k NULLS FIRST, y NULLS FIRST LIMIT 100""",
    "ds_q67": f"""
SELECT * FROM (SELECT p_type, p_brand, d_year, sumsales, CAST(rank() OVER (PARTITION BY p_type ORDER BY sumsales DESC) AS BIGINT) AS rk FROM (
 SELECT p_type, p_brand, d_year, round(sum(coalesce(l_extendedprice * l_quantity, 0)), 2) AS sumsales FROM {_SALES} x, part WHERE l_partkey = p_partkey GROUP BY ROLLUP(p_type, p_brand, d_year)) dw1) dw2
WHERE rk <= 5 ORDER BY p_type NULLS FIRST, p_brand NULLS FIRST, d_year NULLS FIRST, sumsales NULLS FIRST, rk LIMIT 100""",
    "ds_q70": """
SELECT round(sum(c_acctbal), 2) AS total, r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS BIGINT) AS lochierarchy,
CAST(rank() OVER (PARTITION BY grouping(r_name) + grouping(n_name), CASE WHEN grouping(n_name) = 0 THEN r_name END ORDER BY sum(c_acctbal) DESC) AS BIGINT) AS rk
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN (SELECT r_name FROM region WHERE r_regionkey < 4) GROUP BY ROLLUP(r_name, n_name)""",
    "ds_q3": f"""
SELECT d_year, p_brand, round(sum(l_extendedprice), 2) AS sum_agg FROM {_SALES} x, part WHERE l_partkey = p_partkey AND p_size = 28 AND d_moy = 11 GROUP BY d_year, p_brand ORDER BY d_year, sum_agg DESC, p_brand LIMIT 100""",
    "ds_q4": f"""
WITH yt AS (SELECT o_custkey AS k, d_year, sum(l_extendedprice) AS total, 's' AS kind FROM {_SALES} x GROUP BY o_custkey, d_year UNION ALL SELECT o_custkey, d_year, sum(l_extendedprice * (1 - l_discount)), 'c' FROM {_SALES} x GROUP BY o_custkey, d_year)
SELECT a.k FROM yt a, yt b, yt c, yt d WHERE a.k = b.k AND a.k = c.k AND a.k = d.k AND a.kind = 's' AND b.kind = 's' AND c.kind = 'c' AND d.kind = 'c' AND a.d_year = 1997 AND b.d_year = 1998 AND c.d_year = 1997 AND d.d_year = 1998
AND a.total > 0 AND c.total > 0 AND CASE WHEN c.total > 0 THEN d.total / c.total ELSE NULL END > CASE WHEN a.total > 0 THEN b.total / a.total ELSE NULL END ORDER BY a.k NULLS FIRST LIMIT 100""",
    "ds_q6": f"""
SELECT n_name, count(*) AS cnt FROM customer, nation, {_SALES} s, part i WHERE c_nationkey = n_nationkey AND c_custkey = o_custkey AND l_partkey = p_partkey AND d_year = (SELECT DISTINCT CAST(extract(year FROM o_orderdate) AS BIGINT) FROM orders WHERE o_orderdate >= date '1998-01-01' AND o_orderdate < date '1998-02-01')
AND i.p_retailprice > 1.02 * (SELECT avg(j.p_retailprice) FROM part j WHERE j.p_brand = i.p_brand) GROUP BY n_name HAVING count(*) >= 10 ORDER BY cnt NULLS FIRST, n_name LIMIT 100""",
    "ds_q7": f"""
SELECT p_brand, round(avg(l_quantity), 4) AS agg1, round(avg(l_extendedprice), 4) AS agg2, round(avg(l_discount), 4) AS agg3 FROM {_SALES} x, customer, part WHERE o_custkey = c_custkey AND l_partkey = p_partkey AND c_mktsegment = 'BUILDING' AND d_year = 1999 GROUP BY p_brand ORDER BY p_brand LIMIT 100""",
    "ds_q8": f"""
SELECT n_name, round(sum(l_extendedprice), 2) AS total FROM {_SALES} x, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND d_year = 1998 AND substring(s_name, 10, 2) IN (SELECT z FROM (SELECT substring(s_name, 10, 2) AS z FROM supplier WHERE s_suppkey < 60 INTERSECT SELECT z FROM (SELECT substring(s_name, 10, 2) AS z, count(*) AS cnt FROM supplier GROUP BY substring(s_name, 10, 2) HAVING count(*) > 1) a1) a2) GROUP BY n_name ORDER BY n_name LIMIT 100""",
    "ds_q13": f"""
SELECT round(avg(l_quantity), 4) AS a, round(avg(l_extendedprice), 4) AS b, round(sum(l_discount), 4) AS c FROM {_SALES} x, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND d_year = 1998
AND ((c_mktsegment = 'BUILDING' AND l_quantity BETWEEN 10 AND 20) OR (c_mktsegment = 'MACHINERY' AND l_quantity BETWEEN 30 AND 40)) AND ((n_regionkey IN (0, 1) AND l_extendedprice BETWEEN 100 AND 60000) OR (n_regionkey IN (2, 3) AND l_extendedprice BETWEEN 50 AND 50000))""",
    "ds_q16": f"""
SELECT count(DISTINCT l_orderkey) AS order_count, round(sum(l_extendedprice), 2) AS total FROM lineitem a WHERE l_shipdate >= date '1998-02-01' AND l_shipdate < date '1998-04-01' AND EXISTS (SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE a.l_orderkey = c.l_orderkey AND c.l_returnflag = 'R')""",
    "ds_q21": f"""
SELECT l_suppkey, bef, aft FROM (SELECT l_suppkey, round(sum(CASE WHEN o_orderdate < date '1998-03-11' THEN l_quantity ELSE 0 END), 2) AS bef, round(sum(CASE WHEN o_orderdate >= date '1998-03-11' THEN l_quantity ELSE 0 END), 2) AS aft FROM {_SALES} x WHERE o_orderdate BETWEEN date '1998-02-10' AND date '1998-04-10' GROUP BY l_suppkey) t
WHERE CASE WHEN bef > 0 THEN aft / bef ELSE NULL END BETWEEN 2.0 / 3.0 AND 3.0 / 2.0 ORDER BY l_suppkey NULLS FIRST LIMIT 100""",
    "ds_q22": f"""
SELECT p_brand, p_type, round(avg(l_quantity), 4) AS qoh FROM {_SALES} x, part WHERE l_partkey = p_partkey AND d_year = 1999 GROUP BY ROLLUP(p_brand, p_type) ORDER BY qoh NULLS FIRST, p_brand NULLS FIRST, p_type NULLS FIRST LIMIT 100""",
    "ds_q23": f"""
WITH frequent AS (SELECT l_partkey AS k, count(*) AS cnt FROM {_SALES} x GROUP BY l_partkey HAVING count(*) > 34), best AS (SELECT o_custkey AS c, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 0.5 * (SELECT max(t) FROM (SELECT sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) m))
SELECT round(sum(sales), 2) AS total FROM (SELECT l_quantity * l_extendedprice AS sales FROM {_SALES} x WHERE l_partkey IN (SELECT k FROM frequent) AND o_custkey IN (SELECT c FROM best) UNION ALL SELECT o_totalprice FROM orders WHERE o_custkey IN (SELECT c FROM best)) t""",
    "ds_q28": """
SELECT b1.lp AS lp1, b1.cnt AS cnt1, b1.cntd AS cntd1, b2.lp AS lp2, b2.cnt AS cnt2, b2.cntd AS cntd2 FROM (SELECT round(avg(l_extendedprice), 4) AS lp, count(l_extendedprice) AS cnt, count(DISTINCT l_extendedprice) AS cntd FROM lineitem WHERE l_quantity BETWEEN 0 AND 5 AND (l_discount BETWEEN 0.08 AND 0.09 OR l_tax BETWEEN 0.01 AND 0.02)) b1,
(SELECT round(avg(l_extendedprice), 4) AS lp, count(l_extendedprice) AS cnt, count(DISTINCT l_extendedprice) AS cntd FROM lineitem WHERE l_quantity BETWEEN 6 AND 10 AND l_discount < 0.05) b2""",
    "ds_q31": f"""
WITH ss AS (SELECT p_brand, d_year, d_moy, sum(l_extendedprice) AS v FROM {_SALES} x, part WHERE l_partkey = p_partkey GROUP BY p_brand, d_year, d_moy)
SELECT a.p_brand, round(b.v / a.v, 6) AS r1, round(c.v / b.v, 6) AS r2 FROM ss a, ss b, ss c WHERE a.p_brand = b.p_brand AND b.p_brand = c.p_brand AND a.d_year = 1998 AND b.d_year = 1998 AND c.d_year = 1998 AND a.d_moy = 1 AND b.d_moy = 2 AND c.d_moy = 3 AND CASE WHEN a.v > 0 THEN b.v / a.v ELSE NULL END < CASE WHEN b.v > 0 THEN c.v / b.v ELSE NULL END ORDER BY a.p_brand""",
    "ds_q33": """
WITH a AS (SELECT p_brand, sum(l_extendedprice) AS t FROM lineitem, part WHERE l_partkey = p_partkey AND p_brand IN (SELECT p_brand FROM part WHERE p_type = 'PROMO') AND l_returnflag = 'A' GROUP BY p_brand), b AS (SELECT p_brand, sum(l_extendedprice) AS t FROM lineitem, part WHERE l_partkey = p_partkey AND l_returnflag = 'R' GROUP BY p_brand)
SELECT p_brand, round(sum(t), 2) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x GROUP BY p_brand ORDER BY total, p_brand LIMIT 100""",
    "ds_q34": """
SELECT c_name, cnt FROM (SELECT o_custkey, count(*) AS cnt FROM orders WHERE CAST(extract(day FROM o_orderdate) AS BIGINT) BETWEEN 1 AND 3 AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_custkey) dn, customer WHERE o_custkey = c_custkey AND cnt BETWEEN 2 AND 20 ORDER BY c_name NULLS FIRST""",
    "ds_q40": f"""
SELECT p_brand, round(sum(CASE WHEN o_orderdate < date '1998-03-11' THEN l_extendedprice - coalesce(v, 0) ELSE 0 END), 2) AS bef, round(sum(CASE WHEN o_orderdate >= date '1998-03-11' THEN l_extendedprice - coalesce(v, 0) ELSE 0 END), 2) AS aft
FROM {_SALES} x LEFT OUTER JOIN (SELECT l_orderkey AS ok, l_suppkey AS sk, max(l_tax) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_suppkey) r ON l_orderkey = ok AND l_suppkey = sk, part WHERE l_partkey = p_partkey AND d_year = 1998 GROUP BY p_brand ORDER BY p_brand LIMIT 100""",
    "ds_q41": "SELECT DISTINCT p_brand FROM part i1 WHERE p_size BETWEEN 1 AND 30 AND (SELECT count(*) FROM part WHERE p_brand = i1.p_brand AND ((p_type = 'PROMO' AND p_size IN (1, 2, 3)) OR (p_type = 'ECONOMY' AND p_size IN (4, 5)))) > 2 ORDER BY p_brand LIMIT 100",
    "ds_q43": f"""
SELECT s_name, round(sum(CASE WHEN d_moy = 1 THEN l_extendedprice ELSE NULL END), 2) AS m1, round(sum(CASE WHEN d_moy = 2 THEN l_extendedprice ELSE NULL END), 2) AS m2, round(sum(CASE WHEN d_moy = 3 THEN l_extendedprice ELSE NULL END), 2) AS m3 FROM {_SALES} x, supplier WHERE l_suppkey = s_suppkey AND d_year = 1998 GROUP BY s_name ORDER BY s_name LIMIT 100""",
    "ds_q49": f"""
SELECT channel, k, rr, r FROM (SELECT 's' AS channel, k, rr, CAST(rank() OVER (ORDER BY rr, k) AS BIGINT) AS r FROM (SELECT l_suppkey AS k, round(CAST(CAST(sum(coalesce(l_quantity, 0)) AS DECIMAL(15, 4)) AS DOUBLE) / count(*), 6) AS rr FROM {_SALES} x WHERE d_year = 1998 AND d_moy = 12 GROUP BY l_suppkey) a) t WHERE r <= 10
UNION SELECT channel, k, rr, r FROM (SELECT 'p' AS channel, k, rr, CAST(rank() OVER (ORDER BY rr, k) AS BIGINT) AS r FROM (SELECT l_partkey AS k, round(CAST(CAST(sum(coalesce(l_quantity, 0)) AS DECIMAL(15, 4)) AS DOUBLE) / count(*), 6) AS rr FROM {_SALES} x WHERE d_year = 1998 AND d_moy = 12 GROUP BY l_partkey) a) t WHERE r <= 10 ORDER BY 1 NULLS FIRST, 4 NULLS FIRST, 2 LIMIT 100""",
    "ds_q50": """
SELECT l_suppkey, CAST(sum(CASE WHEN datediff_days <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS d30, CAST(sum(CASE WHEN datediff_days > 30 AND datediff_days <= 60 THEN 1 ELSE 0 END) AS BIGINT) AS d60, CAST(sum(CASE WHEN datediff_days > 60 THEN 1 ELSE 0 END) AS BIGINT) AS more
FROM (SELECT l_suppkey, CASE WHEN l_shipdate <= o_orderdate + interval '30' day THEN 30 WHEN l_shipdate <= o_orderdate + interval '60' day THEN 60 ELSE 90 END AS datediff_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate) t GROUP BY l_suppkey ORDER BY l_suppkey LIMIT 100""",
    "ds_q53": f"""
SELECT p_brand, sum_sales, avg_q FROM (SELECT p_brand, round(sum(l_extendedprice), 2) AS sum_sales, round(avg(sum(l_extendedprice)) OVER (PARTITION BY p_brand), 0) AS avg_q FROM {_SALES} x, part WHERE l_partkey = p_partkey AND p_type IN ('PROMO', 'ECONOMY') AND d_year = 1998 GROUP BY p_brand, d_moy) t WHERE CASE WHEN avg_q > 0 THEN abs(sum_sales - avg_q) / avg_q ELSE NULL END > 0.1 ORDER BY avg_q, sum_sales, p_brand LIMIT 100""",
    "ds_q54": f"""
WITH mc AS (SELECT DISTINCT o_custkey AS k FROM {_SALES} x, part WHERE l_partkey = p_partkey AND p_type = 'PROMO' AND d_year = 1998 AND d_moy = 12), rev AS (SELECT k, sum(l_extendedprice) AS revenue FROM mc, {_SALES} x WHERE k = o_custkey AND o_orderdate BETWEEN (SELECT min(o_orderdate) FROM orders WHERE o_orderdate >= date '1999-01-01') AND date '1999-03-31' GROUP BY k)
SELECT segment, count(*) AS n, segment * 5000 AS base FROM (SELECT CAST(round(revenue / 5000) AS INTEGER) AS segment FROM rev) t GROUP BY segment ORDER BY segment NULLS FIRST, n LIMIT 100""",
    "ds_q58": f"""
WITH a AS (SELECT l_partkey AS k, sum(l_extendedprice) AS v FROM {_SALES} x WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderdate >= date '1998-01-01' AND o_orderdate < date '1998-07-01') GROUP BY l_partkey), b AS (SELECT l_partkey AS k, sum(l_extendedprice) AS v FROM {_SALES} x WHERE d_year = 1999 GROUP BY l_partkey)
SELECT a.k, round(a.v, 2) AS av, round(b.v, 2) AS bv, round((a.v + b.v) / 2, 0) AS average FROM a, b WHERE a.k = b.k AND a.v BETWEEN 0.9 * b.v AND 1.1 * b.v ORDER BY a.k NULLS FIRST LIMIT 100""",
    "ds_q61": """
SELECT round(p.v, 2) AS promotions, round(t.v, 2) AS total, round(CAST(CAST(p.v AS DECIMAL(15, 4)) AS DOUBLE) / CAST(CAST(t.v AS DECIMAL(15, 4)) AS DOUBLE) * 100, 6) AS share FROM (SELECT sum(l_extendedprice) AS v FROM lineitem, part WHERE l_partkey = p_partkey AND p_type = 'PROMO') p, (SELECT sum(l_extendedprice) AS v FROM lineitem, part WHERE l_partkey = p_partkey) t""",
    "ds_q65": f"""
SELECT s_name, sc.p, round(sc.revenue, 2) AS revenue FROM supplier, (SELECT s, avg(revenue) AS ave FROM (SELECT l_suppkey AS s, l_partkey AS p, sum(l_extendedprice) AS revenue FROM {_SALES} x GROUP BY l_suppkey, l_partkey) sa GROUP BY s) sb, (SELECT l_suppkey AS s, l_partkey AS p, sum(l_extendedprice) AS revenue FROM {_SALES} x GROUP BY l_suppkey, l_partkey) sc WHERE sb.s = sc.s AND sc.revenue <= 0.1 * sb.ave AND s_suppkey = sc.s ORDER BY s_name NULLS FIRST, sc.p LIMIT 100""",
    "ds_q68": f"""
SELECT c_name, n_name, amt, profit FROM (SELECT l_orderkey, o_custkey, round(sum(l_extendedprice), 2) AS amt, round(sum(l_discount), 4) AS profit FROM {_SALES} x WHERE CAST(extract(day FROM o_orderdate) AS BIGINT) BETWEEN 1 AND 2 AND d_year IN (1998, 1999) GROUP BY l_orderkey, o_custkey) dn, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey ORDER BY c_name NULLS FIRST, amt, profit LIMIT 100""",
    "ds_q69": f"""
SELECT c_mktsegment, count(*) AS cnt FROM customer c WHERE EXISTS (SELECT 1 FROM {_SALES} x WHERE c.c_custkey = o_custkey AND d_year = 1998 AND d_moy BETWEEN 4 AND 6) AND NOT EXISTS (SELECT 1 FROM {_SALES} x WHERE c.c_custkey = o_custkey AND d_year = 1999 AND d_moy BETWEEN 4 AND 6) AND NOT EXISTS (SELECT 1 FROM {_SALES} x WHERE c.c_custkey = o_custkey AND d_year = 2000 AND d_moy = 1) GROUP BY c_mktsegment ORDER BY c_mktsegment LIMIT 100""",
    "ds_q74": f"""
WITH yt AS (SELECT o_custkey AS k, d_year, stddev_samp(l_extendedprice) AS total, 's' AS kind FROM {_SALES} x WHERE d_year IN (1997, 1998) GROUP BY o_custkey, d_year UNION ALL SELECT o_custkey, d_year, sum(l_quantity), 'w' FROM {_SALES} x WHERE d_year IN (1997, 1998) GROUP BY o_custkey, d_year)
SELECT a.k FROM yt a, yt b, yt c, yt d WHERE a.k = b.k AND a.k = c.k AND a.k = d.k AND a.kind = 's' AND b.kind = 's' AND c.kind = 'w' AND d.kind = 'w' AND a.d_year = 1997 AND b.d_year = 1998 AND c.d_year = 1997 AND d.d_year = 1998 AND a.total > 0 AND c.total > 0 AND d.total / c.total > b.total / a.total ORDER BY a.k NULLS FIRST LIMIT 100""",
    "ds_q77": """
WITH s AS (SELECT l_suppkey AS k, sum(l_extendedprice) AS sales FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_suppkey), r AS (SELECT l_suppkey AS k, sum(l_extendedprice) AS ret FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey < 50 GROUP BY l_suppkey)
SELECT channel, id, round(sum(sales), 2) AS sales, round(sum(returns), 2) AS returns FROM (SELECT 'supplier' AS channel, s.k AS id, sales, coalesce(ret, 0) AS returns FROM s LEFT JOIN r ON s.k = r.k UNION ALL SELECT 'customer', o_custkey, o_totalprice, 0 FROM orders) x GROUP BY ROLLUP(channel, id) ORDER BY channel NULLS FIRST, id NULLS FIRST, sales LIMIT 100""",
    "ds_q78": f"""
WITH ws AS (SELECT d_year AS y, l_partkey AS p, o_custkey AS c, sum(l_quantity) AS q FROM {_SALES} x LEFT JOIN (SELECT DISTINCT l_orderkey AS ok FROM lineitem WHERE l_returnflag = 'R') r ON ok = l_orderkey WHERE ok IS NULL GROUP BY d_year, l_partkey, o_custkey), ss AS (SELECT d_year AS y, l_suppkey AS s, o_custkey AS c, sum(l_quantity) AS q FROM {_SALES} x GROUP BY d_year, l_suppkey, o_custkey)
SELECT ss.s, round(ss.q / (coalesce(ws.q, 0) + 1), 2) AS ratio, round(ss.q, 2) AS qty FROM ss LEFT JOIN ws ON ws.y = ss.y AND ws.c = ss.c AND ws.p = ss.s WHERE coalesce(ws.q, 0) > 0 AND ss.y = 1998 ORDER BY ss.s, ratio, qty LIMIT 100""",
    "ds_q88": """
SELECT a.n AS h8, b.n AS h9, c.n AS h10 FROM (SELECT count(*) AS n FROM events WHERE extract(hour FROM ts) = 8 AND extract(minute FROM ts) >= 30) a, (SELECT count(*) AS n FROM events WHERE extract(hour FROM ts) = 9 AND extract(minute FROM ts) < 30) b, (SELECT count(*) AS n FROM events WHERE extract(hour FROM ts) = 10) c""",
    "ds_q90": "SELECT round(CAST(CAST(a.n AS DECIMAL(15, 4)) AS DOUBLE) / CAST(CAST(p.n AS DECIMAL(15, 4)) AS DOUBLE), 6) AS am_pm FROM (SELECT count(*) AS n FROM events WHERE extract(hour FROM ts) BETWEEN 8 AND 9) a, (SELECT count(*) AS n FROM events WHERE extract(hour FROM ts) BETWEEN 19 AND 20) p",
    "ds_q98": f"""
SELECT p_brand, p_type, p_size, round(sum(l_extendedprice), 2) AS rev, round(sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_type), 6) AS ratio FROM {_SALES} x, part WHERE l_partkey = p_partkey AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND o_orderdate BETWEEN date '1999-02-22' AND date '1999-03-24' GROUP BY p_brand, p_type, p_size ORDER BY p_type, p_brand, p_size, rev, ratio""",
    "ds_q99": """
SELECT substring(s_name, 1, 20) AS w, l_returnflag, CAST(sum(CASE WHEN l_shipdate <= o_orderdate + interval '30' day THEN 1 ELSE 0 END) AS BIGINT) AS d30, CAST(sum(CASE WHEN l_shipdate > o_orderdate + interval '30' day AND l_shipdate <= o_orderdate + interval '120' day THEN 1 ELSE 0 END) AS BIGINT) AS d120 FROM lineitem, orders, supplier WHERE l_orderkey = o_orderkey AND l_suppkey = s_suppkey GROUP BY substring(s_name, 1, 20), l_returnflag ORDER BY w, l_returnflag LIMIT 100""",
    "ds_q75": f"""
WITH s AS (SELECT d_year, l_partkey, sum(cnt) AS cnt, sum(amt) AS amt FROM (
 SELECT d_year, l_partkey, l_quantity - coalesce(q, 0.0) AS cnt, l_extendedprice - coalesce(v, 0.0) AS amt FROM {_SALES} x LEFT JOIN (SELECT l_orderkey AS ok, l_partkey AS pk, min(l_quantity) AS q, min(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_partkey) r ON l_orderkey = ok AND l_partkey = pk
 UNION SELECT d_year, l_partkey, l_quantity, l_extendedprice FROM {_SALES} x WHERE l_discount = 0.1) t GROUP BY d_year, l_partkey)
SELECT p.d_year AS prev_year, c.l_partkey, round(p.cnt, 2) AS prev_cnt, round(c.cnt, 2) AS cnt, round(c.amt - p.amt, 2) AS diff FROM s c, s p WHERE c.l_partkey = p.l_partkey AND c.d_year = 1999 AND p.d_year = 1998 AND p.cnt > 0 AND c.cnt / p.cnt < 0.5 ORDER BY cnt, diff, c.l_partkey LIMIT 100""",
    "ds_q76": """
SELECT channel, k, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT 'o' AS channel, o_orderpriority AS k, o_totalprice AS v FROM orders WHERE o_custkey IS NOT NULL UNION ALL SELECT 'l', l_returnflag, l_extendedprice FROM lineitem WHERE l_partkey IS NOT NULL UNION ALL SELECT 'e', event_type, value FROM events WHERE user_id IS NOT NULL) t GROUP BY channel, k ORDER BY channel, k LIMIT 100""",
    "ds_q87": """
SELECT count(*) AS n FROM ((SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 20000) EXCEPT (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') EXCEPT (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P')) cool""",
    "ds_q97": """
WITH a AS (SELECT o_custkey AS k, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A' GROUP BY o_custkey, l_partkey), b AS (SELECT o_custkey AS k, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY o_custkey, l_partkey)
SELECT CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_a, CAST(sum(CASE WHEN a.k IS NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS only_b, CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS both_ab FROM a FULL OUTER JOIN b ON a.k = b.k AND a.p = b.p""",
}
