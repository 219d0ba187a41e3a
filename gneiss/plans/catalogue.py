"""The registered queries and their oracles."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gneiss import catalog
from gneiss.functions import registry
from gneiss.operators import aggregates, distribution, joins
from gneiss.plans import relational, sampler, star, suites
from gneiss.plans.handlers import Handlers
from gneiss.sources import numbers as sources
from gneiss.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]


def _sql(text: str) -> Query:
    return lambda spark, sf_dir: catalog.query(spark, sf_dir, text)


_INNER = "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY'"


def _inner(strategy: str | None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customer = catalog.table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
        orders = catalog.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
        return joins.join(orders, customer, orders["o_custkey"] == customer["c_custkey"], "inner", strategy).select("c_custkey", "o_orderkey", "o_totalprice")

    return run


def join_null_aware_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = catalog.table(spark, sf_dir, "orders").select("o_orderkey")
    return joins.null_aware_anti(orders, catalog.table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey")


def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = catalog.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_orderkey")
    supplier = catalog.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return joins.salted(lines, supplier, "k", 4).groupBy("s_nationkey").agg(F.count("*").alias("n"))


def agg_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregates.two_level(catalog.table(spark, sf_dir, "lineitem"), ["l_returnflag"], {"n": ("count", "l_orderkey"), "q": ("sum", "l_quantity"), "lo": ("min", "l_shipdate"), "hi": ("max", "l_extendedprice"), "a": ("avg", "l_quantity")})
    return out.select("l_returnflag", "n", F.round("q", 2).alias("q"), "lo", "hi", F.round("a", 6).alias("a"))


def agg_reduction_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.table(spark, sf_dir, "events").repartition(8)
    return aggregates.reduction_tree(rows, ["event_type"], {"n": ("count", "event_id"), "lo": ("min", "ts"), "hi": ("max", "value")}, [4, 2])


def fn_date_bin_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry.register(spark)
    rows = catalog.table(spark, sf_dir, "events").withColumn("bin", registry.date_bin(timedelta(hours=1), F.col("ts")))
    return rows.groupBy("bin").agg(F.count("*").alias("n"))


def udf_group_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("string")
    def kind(value: pd.Series) -> pd.Series:
        return value.str.slice(0, 1).str.upper()

    return catalog.table(spark, sf_dir, "events").groupBy(kind("event_type").alias("k")).agg(F.count("*").alias("n"))


def udtf_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.run(spark, "SELECT number FROM numbers(3, 40)")


def source_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.numbers(spark, 10, 1010, 100).groupBy((F.col("number") % 7).alias("m")).agg(F.count("*").alias("n"))


def work_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.work_units(spark, "t", 2, ["rows(2) wait(1)", "rows(1)", "rows(3)"])


def dist_repartition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distribution.by_hash(catalog.table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), 6, "o_custkey")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("hi"))


def dist_range_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distribution.by_range(catalog.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 5, "o_orderdate")
    spans = distribution.with_task(rows).groupBy("task").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"), F.count("*").alias("n"))
    following = F.lead("lo").over(Window.orderBy("task"))  # a row a task
    return spans.select(F.when(F.col("hi") > following, 1).alias("over")).agg(F.count("over").alias("overlaps"))


def dist_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = distribution.coalesced(distribution.round_robin(catalog.table(spark, sf_dir, "nation"), 5), 1)
    return distribution.with_task(rows).groupBy("task").agg(F.count("*").alias("n")).select(F.col("task").cast("long").alias("task"), "n")


def dist_union_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = [catalog.table(spark, sf_dir, t).select(F.col(c).cast("long").alias("k")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"))]
    return distribution.isolated_union(children, 6, [3.0, 2.0, 1.0])


def stream_tumbling_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.tumbling(catalog.table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])
    return out.select("bin", "event_type", "n", F.round("total", 4).alias("total"))


def stateful_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node with state between batches: rows and a running sum of each partition, added up."""

    def run(batches):
        rows, total = 0, 0
        for batch in batches:
            rows += len(batch)
            total += int(batch["user_id"].sum())
        yield pd.DataFrame({"rows": [rows], "total": [total]})

    out = catalog.table(spark, sf_dir, "events").select("user_id").mapInPandas(run, "rows long, total long")
    return out.agg(F.sum("rows").alias("n_rows"), F.sum("total").alias("total"))


def dist_weighted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that each child's rows run in: whole shares of a budget, none for the child of weight 0."""
    keys = (("customer", "c_custkey"), ("orders", "o_orderkey"), ("nation", "n_nationkey"))
    children = [catalog.table(spark, sf_dir, t).select(F.lit(t).alias("child"), F.col(c).cast("long").alias("k")).repartition(8, "k") for t, c in keys]
    rows = distribution.isolated_union(children, 4, [1.0, 3.0, 0.0])
    return distribution.with_task(rows).groupBy("child").agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("n"))


def dist_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = catalog.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    customers = catalog.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return distribution.interleaved([orders, customers], 6, "k").groupBy("k").agg(F.count("*").alias("n"))


def dist_task_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = distribution.TaskCount
    rows = distribution.with_task_count(spark.range(0, 96, 1, 8), count(desired=12), count(maximum=6), count(desired=4))
    return distribution.with_task(rows).agg(F.countDistinct("task").alias("tasks"), F.count("*").alias("n"))


def udaf_geometric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def geometric(value: pd.Series) -> float:
        return float(np.exp(np.log(value).mean()))

    rows = catalog.table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(geometric("l_quantity").alias("g"))
    return rows.select("l_returnflag", F.round("g", 6).alias("g"))


def udwf_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(value: pd.Series) -> float:
        return float(value.max() - value.min())

    over = Window.partitionBy("n_regionkey").orderBy("n_nationkey").rowsBetween(-1, 1)
    return catalog.table(spark, sf_dir, "nation").select("n_nationkey", spread(F.col("n_nationkey").cast("double")).over(over).alias("spread"))


def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = catalog.table(spark, sf_dir, "events")
    a = events.filter("event_id % 3 = 0").select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = events.filter("event_id % 3 = 1").select("user_id", F.col("event_id").alias("next_id"), F.col("ts").alias("next_ts"))
    return windows.interval_join(a, b, "user_id", "first_ts", "next_ts", "1 DAY").select("user_id", "first_id", "next_id")


def sampler_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1)
    return sampler.profile(rows).select("name", "rows", "null_share", F.round("distinct_share", 6).alias("distinct_share"), "complete")


def plan_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    handlers = Handlers()
    handlers.rewrite(lambda df: df.filter("n_regionkey < 3"))
    handlers.rewrite(lambda df: df.withColumn("n_name", F.lower("n_name")))
    handlers.rewrite(lambda df: None)
    return handlers.apply(catalog.table(spark, sf_dir, "nation").select("n_name", "n_regionkey"))


def numbers_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.query(spark, sf_dir, "SELECT n_name, t.number FROM nation JOIN numbers(0, 5) t ON n_nationkey = t.number")


_FRAMES: dict[str, tuple[Query, str | None]] = {
    "join_inner_hash": (_inner(None), _INNER),
    "join_broadcast": (_inner("broadcast"), _INNER),
    "join_merge": (_inner("merge"), _INNER),
    "join_shuffle_hash": (_inner("shuffle_hash"), _INNER),
    "join_null_aware_anti": (join_null_aware_anti, relational.SHARED["join_anti_not_in"]),
    "join_salted": (join_salted, "SELECT s_nationkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey"),
    "agg_two_level": (agg_two_level, "SELECT l_returnflag, count(l_orderkey) AS n, round(sum(l_quantity), 2) AS q, min(l_shipdate) AS lo, max(l_extendedprice) AS hi, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag"),
    "agg_reduction_tree": (agg_reduction_tree, "SELECT event_type, count(event_id) AS n, min(ts) AS lo, max(value) AS hi FROM events GROUP BY event_type"),
    "fn_date_bin_column": (fn_date_bin_column, "SELECT time_bucket(INTERVAL '1 hour', ts) AS bin, count(*) AS n FROM events GROUP BY 1"),
    "udf_group_key": (udf_group_key, "SELECT upper(substring(event_type, 1, 1)) AS k, count(*) AS n FROM events GROUP BY 1"),
    "udtf_numbers": (udtf_numbers, "SELECT range AS number FROM range(3, 40)"),
    "source_numbers": (source_numbers, "SELECT range % 7 AS m, count(*) AS n FROM range(10, 1010) GROUP BY 1"),
    "work_units": (work_units, "SELECT * FROM (VALUES ('t', 0::BIGINT, 0::BIGINT, 'a'), ('t', 0, 0, 'b'), ('t', 1, 0, 'a'), ('t', 0, 1, 'a'), ('t', 0, 1, 'b'), ('t', 0, 1, 'c')) v(tag, task, partition, letter)"),
    "dist_repartition_hash": (dist_repartition_hash, "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY o_custkey"),
    "dist_range_partition": (dist_range_partition, "SELECT CAST(0 AS BIGINT) AS overlaps"),
    "dist_coalesce": (dist_coalesce, "SELECT CAST(0 AS BIGINT) AS task, count(*) AS n FROM nation"),
    "dist_union_tasks": (dist_union_tasks, "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT n_nationkey FROM nation"),
    "stream_tumbling_batch": (stream_tumbling_batch, "SELECT date_trunc('hour', ts) AS bin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "dist_weighted_union": (dist_weighted_union, "SELECT 'customer' AS child, 1::BIGINT AS tasks, count(*) AS n FROM customer UNION ALL SELECT 'orders', 3, count(*) FROM orders UNION ALL SELECT 'nation', 1, count(*) FROM nation"),
    "dist_interleaved": (dist_interleaved, "SELECT k, count(*) AS n FROM (SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY k"),
    "dist_task_hints": (dist_task_hints, "SELECT 6::BIGINT AS tasks, 96::BIGINT AS n"),
    "udaf_geometric_mean": (udaf_geometric_mean, "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS g FROM lineitem GROUP BY l_returnflag"),
    "udwf_spread": (udwf_spread, "SELECT n_nationkey, CAST(max(n_nationkey) OVER w - min(n_nationkey) OVER w AS DOUBLE) AS spread FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"),
    "join_interval": (join_interval, "SELECT a.user_id, a.event_id AS first_id, b.event_id AS next_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY WHERE a.event_id % 3 = 0 AND b.event_id % 3 = 1"),
    "sampler_profile": (sampler_profile, "SELECT * FROM (VALUES ('n_nationkey', 25::BIGINT, 0.0::DOUBLE, 1.0::DOUBLE, true), ('n_name', 25, 0.0, 1.0, true), ('n_regionkey', 25, 0.0, 0.2, true)) v(name, rows, null_share, distinct_share, complete)"),
    "plan_rewrites": (plan_rewrites, "SELECT lower(n_name) AS n_name, n_regionkey FROM nation WHERE n_regionkey < 3"),
    "numbers_in_sql": (numbers_in_sql, "SELECT n_name, t.number FROM nation JOIN (SELECT range AS number FROM range(0, 5)) t ON n_nationkey = t.number"),
    "stateful_map": (stateful_map, "SELECT count(*) AS n_rows, CAST(sum(user_id) AS BIGINT) AS total FROM events"),
}


def queries() -> dict[str, Query]:
    out = {name: _sql(text) for name, text in (relational.SHARED | suites.TPCH | suites.CLICKS | suites.STAR | star.STAR).items()}
    out |= {name: _sql(text) for name, (text, _) in (relational.TWO | suites.CLICKS_TWO).items()}
    return out | {name: run for name, (run, _) in _FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    out = relational.SHARED | suites.TPCH | suites.CLICKS | suites.STAR | star.STAR
    for name, made in catalog.DERIVED.items():  # inline: the oracle's tables are the given ones
        out = {k: re.sub(rf"\b{name}\b", f"({made})", text) for k, text in out.items()}
    out |= {name: text for name, (_, text) in (relational.TWO | suites.CLICKS_TWO).items()}
    return out | {name: text for name, (_, text) in _FRAMES.items() if text}
