"""More queries in the shape of the public star-schema benchmark, on our tables.

Line items of the return flags A, N and R stand for three sales channels, R for returns as well; the
order's customer, its nation and the supplier's nation for the dimensions.
"""

from __future__ import annotations

#: line items with their order's customer and date
S = (
    "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate, o_custkey, o_orderdate, o_orderpriority, o_totalprice, "
    "CAST(extract(year FROM o_orderdate) AS BIGINT) AS d_year, CAST(extract(month FROM o_orderdate) AS BIGINT) AS d_moy, CAST(extract(day FROM o_orderdate) AS BIGINT) AS d_dom FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)


def _channels(measure: str, condition: str) -> str:
    """One sum per item and channel, put together and summed again."""
    parts = [f"SELECT p_brand, sum({measure}) AS v FROM {S} x, part, customer, nation WHERE l_partkey = p_partkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND l_returnflag = '{flag}' AND {condition} GROUP BY p_brand" for flag in "ANR"]
    return f"SELECT p_brand, round(sum(v), 2) AS total FROM ({' UNION ALL '.join(parts)}) t GROUP BY p_brand ORDER BY total, p_brand LIMIT 100"


def _excess(flag: str, brand: str) -> str:
    return f"""
SELECT round(sum(l_extendedprice * l_discount), 4) AS excess FROM {S} x, part WHERE l_partkey = p_partkey AND p_brand = '{brand}' AND d_year = 1998 AND l_returnflag = '{flag}'
AND l_extendedprice * l_discount > (SELECT 1.3 * avg(l_extendedprice * l_discount) FROM {S} y WHERE y.l_partkey = p_partkey AND y.d_year = 1998)"""


def _returners(measure: str, year: int, region: int) -> str:
    return f"""
WITH r AS (SELECT o_custkey AS k, s_nationkey AS place, sum({measure}) AS v FROM {S} x, supplier WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND d_year = {year} GROUP BY o_custkey, s_nationkey)
SELECT c_name, place, round(v, 4) AS v FROM r r1, customer, nation WHERE v > (SELECT avg(v) * 1.2 FROM r r2 WHERE r1.place = r2.place) AND k = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = {region} ORDER BY c_name, place, v LIMIT 100"""


def _three_facts(measure: str, function: str) -> str:
    return f"""
SELECT p_name, s_name, round({function}(a.{measure}), 4) AS sold, round({function}(r.{measure}), 4) AS returned, round({function}(c.{measure}), 4) AS again FROM {S} a, {S} r, {S} c, part, supplier
WHERE a.l_returnflag = 'A' AND r.l_returnflag = 'R' AND c.l_returnflag = 'N' AND a.o_custkey = r.o_custkey AND a.l_orderkey = r.l_orderkey AND r.o_custkey = c.o_custkey AND a.l_partkey = p_partkey AND a.l_suppkey = s_suppkey
AND a.d_year = 1997 AND c.d_year BETWEEN 1997 AND 1999 AND p_size < 10 GROUP BY p_name, s_name ORDER BY p_name, s_name LIMIT 100"""


def _in_stock(flag: str, low: int) -> str:
    return f"""
SELECT p_partkey, p_name, p_retailprice FROM part, (SELECT l_partkey AS k, CAST(o_orderdate AS DATE) AS d, sum(l_quantity) AS held FROM {S} x GROUP BY l_partkey, CAST(o_orderdate AS DATE)) inv, lineitem
WHERE p_retailprice BETWEEN {low} AND {low} + 30 AND inv.k = p_partkey AND inv.d BETWEEN date '1998-01-01' AND date '1998-06-30' AND p_size IN (3, 7, 11, 15, 19, 23) AND held BETWEEN 10 AND 45 AND l_partkey = p_partkey AND l_returnflag = '{flag}'
GROUP BY p_partkey, p_name, p_retailprice ORDER BY p_partkey LIMIT 100"""


def _monthly(who: str, low: float) -> str:
    return f"""
SELECT who, d_moy, sum_sales, avg_sales FROM (SELECT {who} AS who, d_moy, round(sum(l_extendedprice), 2) AS sum_sales, round(avg(sum(l_extendedprice)) OVER (PARTITION BY {who}), 6) AS avg_sales
FROM {S} x, part, supplier WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND d_year = 1999 AND p_type IN ('PROMO', 'ECONOMY', 'STANDARD') GROUP BY {who}, d_moy) t
WHERE CASE WHEN avg_sales > 0 THEN abs(sum_sales - avg_sales) / avg_sales ELSE NULL END > {low} ORDER BY who, avg_sales, sum_sales, d_moy LIMIT 100"""


def _by_brand(columns: str, condition: str) -> str:
    return f"SELECT {columns}, round(sum(l_extendedprice), 2) AS price FROM {S} x, part WHERE l_partkey = p_partkey AND {condition} GROUP BY {columns} ORDER BY price DESC, {columns} LIMIT 100"


def _baskets(extra: str, low: int, high: int) -> str:
    return f"""
SELECT c_name, l_orderkey, cnt FROM (SELECT l_orderkey, o_custkey, count(*) AS cnt FROM {S} x, supplier WHERE l_suppkey = s_suppkey AND d_dom BETWEEN 1 AND 2 AND {extra} AND d_year IN (1997, 1998, 1999) GROUP BY l_orderkey, o_custkey) dj, customer
WHERE o_custkey = c_custkey AND cnt BETWEEN {low} AND {high} ORDER BY cnt DESC, c_name, l_orderkey LIMIT 1000"""


def _shipped(flag: str) -> str:
    spans = [("d30", None, 30), ("d60", 30, 60), ("d90", 60, 90), ("more", 90, None)]
    sums = []
    for name, low, high in spans:
        tests = ([f"l_shipdate > o_orderdate + interval '{low}' day"] if low else []) + ([f"l_shipdate <= o_orderdate + interval '{high}' day"] if high else [])
        sums.append(f"CAST(sum(CASE WHEN {' AND '.join(tests)} THEN 1 ELSE 0 END) AS BIGINT) AS {name}")
    return f"SELECT substring(s_name, 1, 16) AS house, o_orderpriority, {', '.join(sums)} FROM {S} x, supplier WHERE l_suppkey = s_suppkey AND l_returnflag = '{flag}' GROUP BY substring(s_name, 1, 16), o_orderpriority ORDER BY house, o_orderpriority LIMIT 100"


STAR: dict[str, str] = {
    "ds_q11": f"""
WITH yt AS (SELECT o_custkey AS k, d_year, l_returnflag AS channel, sum(l_extendedprice - l_discount) AS total FROM {S} x WHERE l_returnflag IN ('A', 'N') GROUP BY o_custkey, d_year, l_returnflag)
SELECT c_custkey, c_name FROM yt a, yt b, yt c, yt d, customer WHERE a.k = b.k AND a.k = c.k AND a.k = d.k AND c_custkey = a.k AND a.channel = 'A' AND b.channel = 'A' AND c.channel = 'N' AND d.channel = 'N' AND a.d_year = 1997 AND b.d_year = 1998 AND c.d_year = 1997 AND d.d_year = 1998
AND a.total > 0 AND c.total > 0 AND CASE WHEN c.total > 0 THEN d.total / c.total ELSE 0.0 END > CASE WHEN a.total > 0 THEN b.total / a.total ELSE 0.0 END ORDER BY c_custkey LIMIT 100""",
    "ds_q15": f"""
SELECT n_name, round(sum(l_extendedprice), 2) AS total FROM {S} x, customer, nation WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND (substring(n_name, 8, 2) IN ('1', '3', '7', '12', '20') OR n_regionkey IN (2, 4) OR l_extendedprice > 90000)
AND d_year = 2000 AND d_moy BETWEEN 4 AND 6 GROUP BY n_name ORDER BY n_name LIMIT 100""",
    "ds_q19": f"""
SELECT p_brand, p_type, round(sum(l_extendedprice), 2) AS price FROM {S} x, part, customer, supplier WHERE l_partkey = p_partkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND p_size BETWEEN 8 AND 20 AND d_moy = 11 AND d_year = 1999
AND c_nationkey <> s_nationkey GROUP BY p_brand, p_type ORDER BY price DESC, p_brand, p_type LIMIT 100""",
    "ds_q20": f"""
SELECT p_type, p_brand, round(sum(l_extendedprice), 2) AS revenue, round(sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_type), 6) AS ratio FROM {S} x, part
WHERE l_partkey = p_partkey AND l_returnflag = 'N' AND p_type IN ('PROMO', 'STANDARD', 'ECONOMY') AND o_orderdate BETWEEN date '1999-02-22' AND date '1999-03-24' GROUP BY p_type, p_brand ORDER BY p_type, p_brand LIMIT 100""",
    "ds_q24": f"""
WITH ss AS (SELECT c_name, n_name, p_brand, sum(l_extendedprice) AS paid FROM {S} x, part, supplier, customer, nation WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND s_nationkey = c_nationkey GROUP BY c_name, n_name, p_brand)
SELECT c_name, n_name, round(sum(paid), 2) AS paid FROM ss WHERE p_brand IN ('Brand#7', 'Brand#8', 'Brand#9') GROUP BY c_name, n_name HAVING sum(paid) > (SELECT 0.05 * avg(paid) FROM ss) ORDER BY c_name, n_name""",
    "ds_q25": _three_facts("l_extendedprice", "sum"),
    "ds_q26": f"""
SELECT p_partkey, round(avg(l_quantity), 4) AS agg1, round(avg(l_extendedprice), 4) AS agg2, round(avg(l_discount), 4) AS agg3, round(avg(l_tax), 4) AS agg4 FROM {S} x, customer, part WHERE o_custkey = c_custkey AND l_partkey = p_partkey
AND l_returnflag = 'N' AND c_mktsegment = 'FURNITURE' AND (o_orderpriority = '1-URGENT' OR o_orderpriority = '5-LOW') AND d_year = 2000 GROUP BY p_partkey ORDER BY p_partkey LIMIT 100""",
    "ds_q27": f"""
SELECT p_brand, n_name, CAST(grouping(n_name) AS BIGINT) AS g, round(avg(l_quantity), 6) AS agg1, round(avg(l_extendedprice), 6) AS agg2 FROM {S} x, supplier, nation, part WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND l_partkey = p_partkey
AND n_regionkey IN (0, 1, 3) AND d_year = 1999 AND p_type = 'PROMO' GROUP BY ROLLUP(p_brand, n_name) ORDER BY p_brand NULLS FIRST, n_name NULLS FIRST LIMIT 100""",
    "ds_q29": _three_facts("l_quantity", "avg"),
    "ds_q30": _returners("l_extendedprice", 2000, 2),
    "ds_q32": _excess("N", "Brand#11"),
    "ds_q35": f"""
SELECT c_mktsegment, n_regionkey, count(*) AS cnt, round(avg(c_acctbal), 4) AS a, max(c_acctbal) AS hi, round(sum(c_acctbal), 2) AS s FROM customer c, nation WHERE c_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM {S} x WHERE c.c_custkey = x.o_custkey AND x.l_returnflag = 'A' AND x.d_year = 1998)
AND (EXISTS (SELECT 1 FROM {S} y WHERE c.c_custkey = y.o_custkey AND y.l_returnflag = 'N' AND y.d_year = 1999) OR EXISTS (SELECT 1 FROM {S} z WHERE c.c_custkey = z.o_custkey AND z.l_returnflag = 'R' AND z.d_year = 1999))
GROUP BY c_mktsegment, n_regionkey ORDER BY c_mktsegment, n_regionkey LIMIT 100""",
    "ds_q37": _in_stock("N", 920),
    "ds_q42": _by_brand("d_year, p_type", "p_size = 17 AND d_moy = 11 AND d_year = 2000"),
    "ds_q45": f"""
SELECT n_name, c_mktsegment, round(sum(l_extendedprice), 2) AS total FROM {S} x, customer, nation, part WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND l_partkey = p_partkey AND l_returnflag = 'R'
AND (substring(n_name, 8, 2) IN ('2', '5', '11', '14', '22') OR p_partkey IN (SELECT p_partkey FROM part WHERE p_size IN (2, 3, 5, 7, 11, 13, 17, 19, 23, 29))) AND d_moy BETWEEN 4 AND 6 AND d_year = 1999 GROUP BY n_name, c_mktsegment ORDER BY n_name, c_mktsegment LIMIT 100""",
    "ds_q46": f"""
SELECT c_name, here.n_name AS home, bought, l_orderkey, amount, profit FROM (SELECT l_orderkey, o_custkey, n_name AS bought, round(sum(l_extendedprice), 2) AS amount, round(sum(l_extendedprice * l_discount), 4) AS profit FROM {S} x, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey
AND (o_orderpriority = '2-HIGH' OR l_linestatus = 'F') AND d_dom IN (6, 7, 13) AND d_year IN (1998, 1999) AND n_regionkey IN (1, 2) GROUP BY l_orderkey, o_custkey, n_name) dn, customer, nation here
WHERE o_custkey = c_custkey AND c_nationkey = here.n_nationkey AND here.n_name <> bought ORDER BY c_name, home, bought, l_orderkey LIMIT 100""",
    "ds_q48": f"""
SELECT CAST(sum(l_quantity) AS BIGINT) AS q FROM {S} x, supplier, customer, nation WHERE l_suppkey = s_suppkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND d_year = 1999
AND ((c_mktsegment = 'BUILDING' AND l_extendedprice BETWEEN 100 AND 15000) OR (c_mktsegment = 'HOUSEHOLD' AND l_extendedprice BETWEEN 5000 AND 40000) OR (c_mktsegment = 'MACHINERY' AND l_extendedprice BETWEEN 15000 AND 90000))
AND ((n_regionkey = 0 AND l_discount BETWEEN 0 AND 0.05) OR (n_regionkey = 2 AND l_discount BETWEEN 0.02 AND 0.08) OR (n_regionkey = 4 AND l_discount > 0.05))""",
    "ds_q52": _by_brand("d_year, p_brand", "p_size = 21 AND d_moy = 12 AND d_year = 1998"),
    "ds_q55": _by_brand("p_brand", "p_size = 36 AND d_moy = 11 AND d_year = 1999"),
    "ds_q56": _channels("l_extendedprice", "p_name IN (SELECT p_name FROM part WHERE p_name LIKE 'red%' OR p_name LIKE 'small%') AND d_year = 1998 AND d_moy = 2 AND n_regionkey = 3"),
    "ds_q57": f"""
WITH v1 AS (SELECT p_type, s_nationkey, d_year, d_moy, sum(l_extendedprice) AS s, avg(sum(l_extendedprice)) OVER (PARTITION BY p_type, s_nationkey, d_year) AS a, CAST(rank() OVER (PARTITION BY p_type, s_nationkey ORDER BY d_year, d_moy) AS BIGINT) AS rn
FROM {S} x, part, supplier WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND l_returnflag = 'N' AND d_year BETWEEN 1997 AND 1999 GROUP BY p_type, s_nationkey, d_year, d_moy)
SELECT v1.p_type, v1.s_nationkey, v1.d_moy, round(v1.a, 6) AS a, round(v1.s, 2) AS s, round(lg.s, 2) AS psum, round(ld.s, 2) AS nsum FROM v1, v1 lg, v1 ld WHERE v1.p_type = lg.p_type AND v1.s_nationkey = lg.s_nationkey AND v1.p_type = ld.p_type AND v1.s_nationkey = ld.s_nationkey
AND v1.rn = lg.rn + 1 AND v1.rn = ld.rn - 1 AND v1.d_year = 1998 AND v1.a > 0 AND abs(v1.s - v1.a) / v1.a > 0.1 ORDER BY v1.p_type, v1.s_nationkey, v1.d_moy LIMIT 100""",
    "ds_q59": f"""
WITH w AS (SELECT l_suppkey, d_year, d_moy, sum(CASE WHEN d_dom <= 10 THEN l_extendedprice ELSE NULL END) AS early, sum(CASE WHEN d_dom BETWEEN 11 AND 20 THEN l_extendedprice ELSE NULL END) AS middle, sum(CASE WHEN d_dom > 20 THEN l_extendedprice ELSE NULL END) AS late FROM {S} x GROUP BY l_suppkey, d_year, d_moy)
SELECT s_name, y.d_moy, round(y.early / z.early, 4) AS e, round(y.middle / z.middle, 4) AS m, round(y.late / z.late, 4) AS l FROM w y, w z, supplier WHERE y.l_suppkey = s_suppkey AND z.l_suppkey = s_suppkey AND y.d_year = 1998 AND z.d_year = 1999 AND y.d_moy = z.d_moy ORDER BY s_name, y.d_moy LIMIT 100""",
    "ds_q60": _channels("l_extendedprice", "p_brand IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size = 7) AND d_year = 1999 AND d_moy = 9 AND n_regionkey = 2"),
    "ds_q62": _shipped("R"),
    "ds_q63": _monthly("p_brand", 0.1),
    "ds_q64": f"""
WITH kept AS (SELECT l_partkey AS k FROM {S} x WHERE l_returnflag <> 'R' GROUP BY l_partkey HAVING sum(l_extendedprice) > 2 * 1000),
sold AS (SELECT p_name, p_partkey, s_name, s_nationkey, cn.n_name AS home, sn.n_name AS shop, d_year, count(*) AS cnt, sum(l_extendedprice) AS s1, sum(l_discount) AS s2, sum(l_tax) AS s3
FROM {S} x, kept, part, supplier, customer, nation cn, nation sn, region cr, region sr WHERE l_partkey = kept.k AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND o_custkey = c_custkey AND c_nationkey = cn.n_nationkey AND s_nationkey = sn.n_nationkey
AND cn.n_regionkey = cr.r_regionkey AND sn.n_regionkey = sr.r_regionkey AND cr.r_name <> sr.r_name AND p_retailprice BETWEEN 905 AND 960 GROUP BY p_name, p_partkey, s_name, s_nationkey, cn.n_name, sn.n_name, d_year)
SELECT a.p_partkey, a.s_name, a.home, a.shop, a.cnt AS c1, b.cnt AS c2, round(a.s1, 2) AS s11, round(b.s1, 2) AS s12 FROM sold a, sold b WHERE a.p_partkey = b.p_partkey AND a.d_year = 1998 AND b.d_year = 1999 AND b.cnt <= a.cnt AND a.s_name = b.s_name AND a.shop = b.shop
ORDER BY a.p_partkey, a.s_name, a.home, s11, s12""",
    "ds_q66": "SELECT shop, country, "
    + ", ".join(f"round(sum(m{m}), 2) AS m{m}, round(sum(m{m} / size), 6) AS per{m}" for m in (1, 2, 3, 12))
    + " FROM ("
    + " UNION ALL ".join(
        "SELECT s_name AS shop, n_name AS country, s_acctbal + 10000 AS size, "
        + ", ".join(f"sum(CASE WHEN d_moy = {m} THEN {measure} ELSE 0 END) AS m{m}" for m in (1, 2, 3, 12))
        + f" FROM {S} x, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND l_returnflag = '{flag}' AND d_year = 1999 AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY s_name, n_name, s_acctbal"
        for flag, measure in (("N", "l_extendedprice * l_quantity"), ("R", "l_extendedprice"))
    )
    + ") t GROUP BY shop, country ORDER BY shop LIMIT 100",
    "ds_q71": "SELECT p_brand, d_dom, round(sum(v), 2) AS price FROM part, ("
    + " UNION ALL ".join(f"SELECT l_extendedprice AS v, l_partkey AS k, d_dom FROM {S} x WHERE l_returnflag = '{flag}' AND d_moy = 11 AND d_year = 1999" for flag in "ANR")
    + ") t WHERE k = p_partkey AND p_size = 1 AND (d_dom < 6 OR d_dom > 25) GROUP BY p_brand, d_dom ORDER BY price DESC, p_brand, d_dom",
    "ds_q72": f"""
SELECT p_name, n_name, d1.d_moy AS m, CAST(sum(CASE WHEN r.k IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS no_promo, CAST(sum(CASE WHEN r.k IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS promo, count(*) AS total
FROM {S} d1 JOIN (SELECT l_partkey AS k, l_suppkey AS s, d_year AS y, d_moy AS m, sum(l_quantity) AS held FROM {S} i GROUP BY l_partkey, l_suppkey, d_year, d_moy) inv ON d1.l_partkey = inv.k AND d1.d_year = inv.y AND inv.m = d1.d_moy + 1
JOIN supplier ON inv.s = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON d1.l_partkey = p_partkey JOIN customer ON d1.o_custkey = c_custkey LEFT OUTER JOIN (SELECT p_partkey AS k FROM part WHERE p_type = 'PROMO') r ON d1.l_partkey = r.k
WHERE held < d1.l_quantity AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND d1.l_shipdate > d1.o_orderdate + interval '5' day AND d1.d_year = 1998 GROUP BY p_name, n_name, d1.d_moy ORDER BY total DESC, p_name, n_name, m LIMIT 100""",
    "ds_q73": _baskets("o_orderpriority IN ('1-URGENT', '5-LOW')", 1, 5),
    "ds_q79": f"""
SELECT c_name, place, l_orderkey, amount, profit FROM (SELECT l_orderkey, o_custkey, substring(n_name, 1, 30) AS place, round(sum(l_discount * 100), 2) AS amount, round(sum(l_extendedprice * l_tax), 4) AS profit FROM {S} x, supplier, nation
WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND (o_orderpriority = '3-MEDIUM' OR l_linenumber > 5) AND d_dom = 1 AND d_year IN (1998, 1999, 2000) AND s_acctbal BETWEEN 200 AND 8000 GROUP BY l_orderkey, o_custkey, n_name) ms, customer
WHERE o_custkey = c_custkey ORDER BY c_name, place, profit, l_orderkey LIMIT 100""",
    "ds_q80": "SELECT channel, id, round(sum(sales), 2) AS sales, round(sum(returned), 4) AS returned FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS channel, {key} AS id, sum(x.l_extendedprice) AS sales, sum(coalesce(r.amount, 0)) AS returned FROM {S} x LEFT OUTER JOIN (SELECT l_orderkey AS ok, l_linenumber AS ln, l_extendedprice * l_discount AS amount FROM lineitem WHERE l_linestatus = 'F') r ON x.l_orderkey = r.ok AND x.l_linenumber = r.ln, part, supplier "
        f"WHERE x.l_partkey = p_partkey AND x.l_suppkey = s_suppkey AND x.l_returnflag = '{flag}' AND x.o_orderdate BETWEEN date '1999-01-01' AND date '1999-12-31' AND p_retailprice > 900 GROUP BY {key}"
        for name, flag, key in (("shop", "A", "s_name"), ("catalogue", "N", "p_brand"), ("web", "R", "p_type"))
    )
    + ") t GROUP BY ROLLUP(channel, id) ORDER BY channel NULLS FIRST, id NULLS FIRST LIMIT 100",
    "ds_q81": _returners("l_extendedprice * (1 + l_tax)", 1999, 4),
    "ds_q82": _in_stock("A", 960),
    "ds_q83": "WITH "
    + ", ".join(f"r{n} AS (SELECT p_partkey AS k, sum(l_quantity) AS q FROM {S} x, part WHERE l_partkey = p_partkey AND l_returnflag = '{flag}' AND CAST(o_orderdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE extract(month FROM o_orderdate) IN (6, 9, 11)) GROUP BY p_partkey)" for n, flag in ((1, "A"), (2, "N"), (3, "R")))
    + " SELECT r1.k, r1.q AS q1, round(r1.q / (r1.q + r2.q + r3.q) / 3.0 * 100, 4) AS d1, r2.q AS q2, round(r2.q / (r1.q + r2.q + r3.q) / 3.0 * 100, 4) AS d2, r3.q AS q3, round((r1.q + r2.q + r3.q) / 3.0, 4) AS a FROM r1, r2, r3 WHERE r1.k = r2.k AND r1.k = r3.k ORDER BY r1.k, q1 LIMIT 100",
    "ds_q84": """
SELECT c_custkey, concat(c_name, ', ', c_mktsegment) AS who FROM customer, nation, (SELECT 2000.0 AS low, 5000.0 AS high) band, orders, lineitem WHERE c_nationkey = n_nationkey AND n_name = 'NATION_7' AND c_acctbal BETWEEN low AND high AND o_custkey = c_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' ORDER BY c_custkey LIMIT 100""",
    "ds_q85": f"""
SELECT substring(o_orderpriority, 1, 20) AS reason, round(avg(l_quantity), 4) AS a, round(avg(l_extendedprice), 4) AS b, round(avg(l_tax), 6) AS c FROM {S} x, customer, nation, supplier WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey AND l_suppkey = s_suppkey AND l_returnflag = 'R' AND d_year = 2000
AND ((c_mktsegment = 'BUILDING' AND s_acctbal BETWEEN 100 AND 3000 AND l_extendedprice BETWEEN 1000 AND 50000) OR (c_mktsegment = 'FURNITURE' AND l_extendedprice BETWEEN 50 AND 70000) OR (c_mktsegment = 'AUTOMOBILE' AND l_extendedprice > 15000))
AND ((n_regionkey IN (0, 1) AND l_discount > 0.01) OR (n_regionkey IN (2, 3) AND l_discount < 0.09) OR n_regionkey = 4) GROUP BY o_orderpriority ORDER BY reason, a, b, c LIMIT 100""",
    "ds_q86": f"""
SELECT round(sum(l_extendedprice), 2) AS total, p_type, p_brand, CAST(grouping(p_type) + grouping(p_brand) AS BIGINT) AS lochierarchy, CAST(rank() OVER (PARTITION BY grouping(p_type) + grouping(p_brand), CASE WHEN grouping(p_brand) = 0 THEN p_type END ORDER BY sum(l_extendedprice) DESC) AS BIGINT) AS rk
FROM {S} x, part WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND d_year = 2000 GROUP BY ROLLUP(p_type, p_brand) ORDER BY lochierarchy DESC, CASE WHEN grouping(p_type) + grouping(p_brand) = 0 THEN p_type END NULLS FIRST, rk LIMIT 100""",
    "ds_q89": f"""
SELECT p_type, p_brand, s_nationkey, d_moy, sum_sales, avg_sales FROM (SELECT p_type, p_brand, s_nationkey, d_moy, round(sum(l_extendedprice), 2) AS sum_sales, round(avg(sum(l_extendedprice)) OVER (PARTITION BY p_type, p_brand, s_nationkey), 6) AS avg_sales FROM {S} x, part, supplier
WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND d_year = 2000 AND ((p_type IN ('PROMO', 'ECONOMY') AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')) OR (p_type = 'STANDARD' AND p_brand IN ('Brand#4', 'Brand#5', 'Brand#6'))) GROUP BY p_type, p_brand, s_nationkey, d_moy) t
WHERE CASE WHEN avg_sales <> 0 THEN abs(sum_sales - avg_sales) / avg_sales ELSE NULL END > 0.1 ORDER BY sum_sales - avg_sales, s_nationkey, p_type, p_brand, d_moy LIMIT 100""",
    "ds_q91": f"""
SELECT s_name, n_name, c_mktsegment, round(sum(l_extendedprice), 2) AS loss FROM {S} x, customer, supplier, nation WHERE o_custkey = c_custkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND l_returnflag = 'R' AND d_year = 1998 AND d_moy = 11
AND (c_mktsegment = 'MACHINERY' OR (c_mktsegment = 'HOUSEHOLD' AND c_acctbal > 0)) AND n_name LIKE 'NATION_1%' GROUP BY s_name, n_name, c_mktsegment ORDER BY loss DESC, s_name, c_mktsegment""",
    "ds_q92": _excess("R", "Brand#14"),
    "ds_q93": f"""
SELECT o_custkey, round(sum(sales), 4) AS sumsales FROM (SELECT o_custkey, CASE WHEN r.q IS NOT NULL THEN (x.l_quantity - r.q) * x.l_extendedprice ELSE x.l_quantity * x.l_extendedprice END AS sales FROM {S} x LEFT OUTER JOIN (SELECT l_partkey AS pk, l_orderkey AS ok, l_linenumber AS ln, l_quantity / 2 AS q, l_discount AS why FROM lineitem WHERE l_returnflag = 'R') r
ON x.l_partkey = r.pk AND x.l_orderkey = r.ok AND x.l_linenumber = r.ln WHERE r.why > 0.03) t GROUP BY o_custkey ORDER BY sumsales, o_custkey LIMIT 100""",
    "ds_q94": """
SELECT count(DISTINCT a.l_orderkey) AS orders, round(sum(a.l_tax * a.l_extendedprice), 4) AS cost, round(sum(a.l_extendedprice), 2) AS profit FROM lineitem a, supplier, nation WHERE a.l_shipdate >= date '1999-02-01' AND a.l_shipdate < date '1999-04-02' AND a.l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 3
AND EXISTS (SELECT 1 FROM lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem r WHERE a.l_orderkey = r.l_orderkey AND r.l_returnflag = 'R')""",
    "ds_q95": """
WITH two AS (SELECT a.l_orderkey AS k FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)
SELECT count(DISTINCT l_orderkey) AS orders, round(sum(l_tax * l_extendedprice), 4) AS cost, round(sum(l_extendedprice), 2) AS profit FROM lineitem, supplier, nation WHERE l_shipdate >= date '1999-02-01' AND l_shipdate < date '1999-04-02' AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 3
AND l_orderkey IN (SELECT k FROM two) AND l_orderkey IN (SELECT o_orderkey FROM orders, two WHERE o_orderkey = two.k AND o_orderstatus = 'F')""",
    "ds_q96": "SELECT count(*) AS cnt FROM events, customer, nation WHERE user_id = c_custkey AND c_nationkey = n_nationkey AND extract(hour FROM ts) = 8 AND extract(minute FROM ts) >= 30 AND n_regionkey < 4",
}
