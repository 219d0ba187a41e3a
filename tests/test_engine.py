"""Session, catalogue, dialect, sources, operators, plans and streams."""

import datetime
import itertools
import random
import re
import threading
import time

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gneiss import catalog, console, context, session
from gneiss.functions import dialect, registry
from gneiss.operators import aggregates, distribution, joins
from gneiss.plans import catalogue, compare, explain, relational, sampler, star, suites
from gneiss.plans.handlers import Handlers
from gneiss.sources import numbers
from gneiss.streaming import windows


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ configuration and catalogue


def test_config_maps_to_spark_settings():
    confs = session.EngineConfig(adaptive=False, broadcast_joins=False, max_tasks_per_stage=7, compression="zstd").confs()
    assert confs["spark.sql.adaptive.enabled"] == "false" and confs["spark.sql.autoBroadcastJoinThreshold"] == "-1"
    assert confs["spark.sql.shuffle.partitions"] == "7" and confs["spark.io.compression.codec"] == "zstd"
    assert session.EngineConfig(compression="none").confs()["spark.shuffle.compress"] == "false"


def test_set_statements(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    session.set_option(spark, "SET gneiss.broadcast_joins = false")
    assert spark.conf.get(key) == "-1"
    session.set_option(spark, "SET gneiss.broadcast_bytes = 1234")
    assert spark.conf.get(key) == "-1"
    session.set_option(spark, "SET gneiss.broadcast_joins = true;")
    assert spark.conf.get(key) == "1234"
    session.set_option(spark, f"SET gneiss.broadcast_bytes = {10 << 20}")
    assert spark.conf.get(key) == str(10 << 20)
    session.set_option(spark, f"SET {key} = {before}")
    assert spark.conf.get(key) == before
    session.set_option(spark, "SET gneiss.lenient = true")
    assert spark.sql("SELECT CAST('x' AS INT) AS a").first().a is None
    session.set_option(spark, "SET gneiss.lenient = false")
    with pytest.raises(PySparkException):
        spark.sql("SELECT CAST('x' AS INT) AS a").collect()
    for wrong in ("SET gneiss.nothing = 1", "SET gneiss.adaptive = maybe"):
        with pytest.raises(ValueError):
            session.set_option(spark, wrong)


def test_session_steps_run_in_order(spark):
    seen = []
    steps = [lambda s: seen.append("first"), lambda s: s.createDataFrame([(4,)], "n int").createOrReplaceTempView("prepared"), lambda s: seen.append(s.table("prepared").first().n)]
    out = session.session("tests", None, session.EngineConfig(extra={"spark.ui.enabled": "false"}), steps)
    assert out is not None and seen == ["first", 4]


def test_hive_partitions_prune_and_copy(spark, tmp_path):
    rows = [(season, f"{season}-{k}", 10 * k) for season in ("dry", "mild", "wet") for k in range(4)]
    path = str(tmp_path / "seasons")
    catalog.write_partitioned(spark.createDataFrame(rows, "season string, station string, depth int"), path, ["season"], ["depth"])
    df = catalog.register_parquet(spark, "seasons", path, {"season": "string"})
    one = spark.sql("SELECT station, depth FROM seasons WHERE season = 'mild' ORDER BY depth")
    assert [tuple(r) for r in one.collect()] == [(f"mild-{k}", 10 * k) for k in range(4)] and df.count() == 12
    assert "PartitionFilters: [isnotnull(season" in plan(one).replace("\n", "")
    catalog.copy_to(one, str(tmp_path / "csv"), "csv", options={"header": "true"})
    assert catalog.register_csv(spark, "c", str(tmp_path / "csv"), "station string, depth int").count() == 4
    catalog.copy_to(one, str(tmp_path / "json"), "json")
    assert catalog.register_json(spark, "j", str(tmp_path / "json")).count() == 4
    assert catalog.from_path(spark, path).count() == 12


def test_views_columns_and_cache(spark, sf_dir):
    catalog.register_tables(spark, sf_dir, ["nation"])
    catalog.create_view(spark, "v", "SELECT n_nationkey, n_name FROM nation", ["k", "name"])
    assert spark.sql("SELECT k, name FROM v").count() == 25
    shown = {(r.column_name, r.data_type) for r in catalog.show_columns(spark, "v").collect()}
    assert shown == {("k", "int"), ("name", "string")}
    assert catalog.cached(spark, "v").count() == 25 and "InMemoryRelation" in plan(spark.table("v"))
    spark.catalog.uncacheTable("v")
    catalog.drop_view(spark, "v")
    assert not spark.catalog.tableExists("v")


def test_scan_reads_only_what_it_needs(spark, sf_dir):
    text = plan(catalog.table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select("l_orderkey"))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text and "GreaterThan(l_quantity,10.0)" in text


# ------------------------------------------------------------------ dialect and functions


def test_dialect_rewrites():
    assert dialect.translate('SELECT "MinTemp" FROM "we""ird"') == 'SELECT `MinTemp` FROM `we"ird`'
    assert dialect.translate(r"SELECT regexp_replace(x, '(a\.b)', '\1-\1'), '\1'") == r"SELECT regexp_replace(x, '(a\\.b)', '$1-$1'), '\1'"
    assert dialect.translate("SELECT concat(a, concat(b)) , `concat`(x)") == "SELECT concat_ws('', a, concat_ws('', b)) , `concat`(x)"
    assert dialect.translate("SELECT a / 2, b / 2, x.a / y.a, f(a) / 2, a / 2.0, 1.5 / 2, 7 / 2", {"a"}) == "SELECT a div 2, b / 2, x.a div y.a, f(a) / 2, a / 2.0, 1.5 / 2, 7 div 2"
    assert dialect.translate("SELECT date_bin(INTERVAL '2 months', t), date_bin(INTERVAL '1' YEAR, t)").replace(" ", "") == "SELECTdate_bin_months(2,t),date_bin_months(12,t)"
    assert dialect.translate("SELECT `a``b` FROM `t` ORDER BY `x` DESC") == "SELECT `a``b` FROM `t` ORDER BY `x` DESC NULLS FIRST"
    assert dialect.translate("SELECT * FROM numbers(1, 2 + 3) n, u") == "SELECT * FROM (SELECT id AS number FROM range(1, 2 + 3)) n, u"
    assert dialect.translate("SELECT a FROM t ORDER BY a DESC, b LIMIT 3") == "SELECT a FROM t ORDER BY a DESC NULLS FIRST, b NULLS LAST LIMIT 3"
    assert dialect.translate("SELECT rank() OVER (PARTITION BY x ORDER BY f(y, 1)) FROM t ORDER BY 1 NULLS FIRST") == "SELECT rank() OVER (PARTITION BY x ORDER BY f(y, 1) NULLS LAST) FROM t ORDER BY 1 NULLS FIRST"
    assert dialect.translate("SELECT 'it''s ORDER BY x' -- ORDER BY y\n") == "SELECT 'it''s ORDER BY x' -- ORDER BY y\n"


def test_translated_text_runs(spark):
    spark.createDataFrame([(1, None), (2, 5), (3, 4)], "K int, v int").createOrReplaceTempView("t")
    assert [r[0] for r in spark.sql(dialect.translate('SELECT "K" FROM t ORDER BY v')).collect()] == [3, 2, 1]
    assert [r[0] for r in spark.sql(dialect.translate('SELECT "K" FROM t ORDER BY v DESC')).collect()] == [1, 2, 3]


def test_registered_functions(spark):
    registry.register(spark)
    ts = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-15 13:14:15.678901' AS t")
    bins = [(datetime.timedelta(milliseconds=250), "1970-01-01 00:00:00"), (datetime.timedelta(days=7), "2001-01-03 05:00:00"), (3, "1999-02-01 00:00:00"), (1, "2024-01-20 00:00:00"), (datetime.timedelta(hours=5), "2030-01-01 00:00:00")]
    got = ts.select(*[registry.date_bin(w, F.col("t"), o).alias(f"b{i}") for i, (w, o) in enumerate(bins)]).first()
    want = ["2024-03-15T13:14:15.500000", "2024-03-13T05:00:00", "2024-02-01T00:00:00", "2024-02-20T00:00:00"]
    origin, t, w = datetime.datetime(2030, 1, 1), datetime.datetime(2024, 3, 15, 13, 14, 15, 678901), bins[4][0]
    want.append((origin + (t - origin) // w * w).isoformat())
    assert [x.isoformat() for x in got] == want
    row = spark.sql("SELECT date_bin(INTERVAL '30' SECOND, TIMESTAMP_NTZ '2024-01-02 03:04:59') AS a, to_timestamp_seconds(86401) AS b, concat_lenient('x', NULL) AS c").first()
    assert row.a == datetime.datetime(2024, 1, 2, 3, 4, 30) and row.b == datetime.datetime(1970, 1, 2, 0, 0, 1) and row.c == "x"


def test_integer_division_truncates(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, -2), (0, 3), (1, 0)], "a long, b long")
    assert [r[0] for r in df.select(registry.integer_division(F.col("a"), F.col("b"))).collect()] == [3, -3, -3, 0, None]


# ------------------------------------------------------------------ joins


@pytest.fixture
def sides(spark):
    """Even numbers below 160 in 5 partitions; each 30 times, dealt in another order."""
    build = spark.range(0, 160, 2, 5)
    probe = build.select(F.explode(F.sequence(F.lit(1), F.lit(30))).alias("n"), F.pmod(F.col("id") * 3, F.lit(160)).alias("id")).select("id")
    return build, probe


@pytest.mark.parametrize("strategy", [None, "broadcast", "merge", "shuffle_hash"])
@pytest.mark.parametrize("how,rows", [("inner", 2400), ("left", 2400), ("full", 2400), ("left_semi", 80), ("left_anti", 0)])
@pytest.mark.parametrize("adaptive,parts", [(True, 4), (False, 1), (False, 16)])
def test_joins_agree(spark, sides, strategy, how, rows, adaptive, parts):
    build, probe = sides
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert joins.join(build, probe, "id", how, strategy).count() == rows
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_hints_choose_the_operator(sides):
    build, probe = sides
    for strategy, node in (("broadcast", "BroadcastHashJoin"), ("merge", "SortMergeJoin"), ("shuffle_hash", "ShuffledHashJoin")):
        assert node in plan(joins.join(probe, build, "id", "inner", strategy))


def test_null_aware_anti_join(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(2,), (5,)], "r int")
    with_null, empty = right.unionAll(spark.createDataFrame([(None,)], "r int")), right.filter("r > 9")
    for r in (right, with_null, empty):
        left.createOrReplaceTempView("l")
        r.createOrReplaceTempView("r")
        want = sorted(map(str, spark.sql("SELECT k FROM l WHERE k NOT IN (SELECT r FROM r)").collect()))
        assert sorted(map(str, joins.null_aware_anti(left, r, "k", "r").collect())) == want
    assert "BroadcastNestedLoop" not in plan(joins.null_aware_anti(left, right, "k", "r")).split("LeftAnti")[-1]


def test_not_in_of_a_statement_needs_no_broadcast(spark, sf_dir):
    for query in ("join_anti_not_in", "join_anti_not_in_null"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            text = plan(catalogue.queries()[query](spark, sf_dir))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert "SortMergeJoin" in text and "Broadcast" not in text


def test_not_in_keeps_its_nulls(spark):
    rows = lambda kind, *values: spark.createDataFrame([(v, (v or 0) % 2) for v in values], f"k {kind}, g int")
    lefts, rights = (rows("int", 1, 2, 2, None), rows("int", 1, 3), rows("int")), (rows("long", 2, 5), rows("long", 2, None), rows("long", None), rows("long"))
    statements = [
        "SELECT k FROM l WHERE k NOT IN (SELECT k FROM r)",
        'SELECT k FROM l AS x WHERE g NOT LIKE \'7\' AND x."k" NOT  IN ( SELECT k + 0 FROM r) -- the end\n',
        "SELECT k FROM l WHERE k NOT IN (SELECT k FROM r WHERE r.g = l.g) AND k NOT IN (SELECT 5) ORDER BY k",
        "SELECT k FROM l WHERE k NOT IN (SELECT k FROM r WHERE k NOT IN (SELECT k FROM r WHERE k > 2) UNION SELECT 1) OR g > 3",
        "SELECT g, count(*) FROM l WHERE k NOT IN (SELECT k FROM r WHERE k NOT IN (SELECT k FROM r WHERE k > 2) UNION SELECT 1) GROUP BY g HAVING count(*) > 0 OR g = 7",
        "SELECT k FROM l AS x WHERE EXISTS (SELECT 1 FROM r WHERE x.k NOT IN (SELECT k + 1 FROM r))",
    ]
    for left, right in itertools.product(lefts, rights):
        left.createOrReplaceTempView("l")
        right.createOrReplaceTempView("r")
        for s in statements:
            want = spark.sql(s.replace('"', "`"))
            got = catalog.run(spark, s)
            assert not compare.differences(got.columns, got.collect(), want.columns, want.collect()), (s, left.collect(), right.collect())


def test_not_in_elsewhere_is_left_alone():
    changed = dialect.translate("SELECT a FROM t WHERE b > 1 AND t.a NOT IN (SELECT c FROM u) GROUP BY a HAVING max(b) > 1 OR a = 2")
    assert "NOT IN" not in changed and changed.count("SELECT c FROM u") == 3
    for s in (
        "SELECT a FROM t WHERE a NOT IN (SELECT c FROM u) OR b = 1",
        "SELECT a FROM t WHERE b = 1 OR b = 2 AND a NOT IN (SELECT c FROM u)",
        "SELECT a FROM t WHERE NOT a NOT IN (SELECT c FROM u)",
        "SELECT a FROM t WHERE (a NOT IN (SELECT c FROM u)) IS NULL",
        "SELECT a FROM t WHERE a NOT IN (SELECT c FROM u) IS NULL",
        "SELECT a FROM t WHERE b AND CASE WHEN a AND a NOT IN (SELECT c FROM u) THEN 1 ELSE 2 END = 2",
        "SELECT a FROM t WHERE a + 1 NOT IN (SELECT c FROM u) AND f(a) NOT IN (SELECT c FROM u) AND (a, b) NOT IN (SELECT c, d FROM u)",
        "SELECT a FROM t WHERE a NOT IN (SELECT c FROM u LIMIT 3) AND a NOT IN (SELECT rand() FROM u) AND a NOT IN (1, 2)",
        "SELECT a NOT IN (SELECT c FROM u) FROM t JOIN v ON x = y AND a NOT IN (SELECT c FROM u)",
        "SELECT 'WHERE a NOT IN (SELECT c FROM u)' -- WHERE a NOT IN (SELECT c FROM u)\n",
    ):
        assert dialect.translate(s) == s


def test_salted_and_small_broadcasts(spark, sides):
    build, probe = sides
    assert joins.salted(probe, build, "id", 3).count() == 2400 and joins.salted(probe, build, "id", 3, "left_anti").count() == 0
    with pytest.raises(ValueError):
        joins.salted(probe, build, "id", 3, "full")
    assert "BroadcastHashJoin" in plan(probe.join(joins.broadcast_if_small(build, 80), "id"))
    assert joins.broadcast_if_small(build, 79) is build


def test_bucketed_tables_join_without_shuffle(spark, sf_dir):
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        joins.save_bucketed(catalog.table(spark, sf_dir, name).withColumnRenamed(key, "k"), f"b_{name}", "k", 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = joins.bucketed_join(spark, "b_orders", "b_lineitem", "k")
        assert "Exchange hashpartitioning" not in plan(out) and "SortMergeJoin" in plan(out) and "Sort [" not in plan(out)
        grouped = spark.table("b_lineitem").groupBy("k").agg(F.count("*").alias("n"))
        assert "Exchange" not in plan(grouped)
        assert out.count() == catalog.table(spark, sf_dir, "lineitem").join(catalog.table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey")).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("b_orders", "b_lineitem"):
            spark.sql(f"DROP TABLE {name}")


def test_folders_join_without_shuffle(spark, tmp_path):
    left = [(v, i, f"{v}{i}") for v in ("a b", "c", "d/e") for i in range(6)] + [(None, 9, "none")]
    right = [(v, i % 3, 10 * i) for v in ("a b", "d/e", "f") for i in range(5)] + [(None, 0, 7)]
    paths = []
    for name, rows, schema in (("l", left, "k string, n int, x string"), ("r", right, "k string, n int, y int"), ("s", right, "k string, m int, y int")):
        catalog.write_partitioned(spark.createDataFrame(rows, schema), str(tmp_path / name), ["k"])
        paths.append(str(tmp_path / name))
    a, b, c = (spark.read.parquet(p) for p in paths)
    assert joins.folder_values(spark, paths[0], "k") == ["__HIVE_DEFAULT_PARTITION__", "a b", "c", "d/e"]
    for how in ("inner", "left", "left_semi", "left_anti"):
        for on in ([], ["n"]):
            got = joins.folder_join(spark, paths[0], paths[1 if on else 2], "k", on, how)
            want = a.join(b if on else c, ["k", *on], how)
            assert not compare.differences(got.columns, got.collect(), want.columns, want.collect()), (how, on)
            assert "Exchange" not in plan(got)
    assert joins.folder_join(spark, paths[0], paths[2], "k").rdd.getNumPartitions() == 2
    with pytest.raises(ValueError):
        joins.folder_join(spark, paths[0], paths[2], "k", [], "full")


# ------------------------------------------------------------------ aggregates, placement


def test_first_by_never_gives_null_across_files(spark, tmp_path):
    rows = [(k, f"berth {k * k}", 7 * k + 1) for k in (11, 12, 13, 14, 15, 16)]
    for half in (rows[::2], rows[1::2]):
        spark.createDataFrame(half, "ship int, berth string, hour int").coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r")).groupBy("ship").agg(aggregates.first_by("berth", "hour").alias("t"), aggregates.first_by("hour", "hour").alias("v"))
    assert sorted(map(tuple, got.collect())) == rows


def test_two_level_rejects_nothing_it_cannot_merge(spark):
    with pytest.raises(ValueError):
        aggregates.reduction_tree(spark.range(3), ["id"], {"a": ("avg", "id")}, [1])


def test_shares_follow_weights_and_caps():
    assert distribution.shares([1, 1, 1], 7) == [3, 2, 2]
    assert distribution.shares([8, 1, 1], 10, [4, None, None]) == [4, 3, 3]
    assert distribution.shares([0.0, 5.0], 4) == [0, 4] and distribution.shares([1] * 5, 3) == [1, 1, 1, 0, 0]
    assert distribution.shares([0, 0], 3) == [2, 1] and distribution.shares([3, 1], 6, [2, 1]) == [2, 1]
    rng = random.Random(2)
    for _ in range(300):
        n, budget = rng.randint(1, 7), rng.randint(1, 20)
        weights, most = [rng.choice([0, 0.5, 1, 3, 10]) for _ in range(n)], [rng.choice([None, 0, 1, 5]) for _ in range(n)]
        got = distribution.shares(weights, budget, most)
        cap = [budget if m is None else min(m, budget) for m in most]
        assert sum(got) == min(budget, sum(cap)) and all(g <= c for g, c in zip(got, cap, strict=True))
        if not any(m is not None for m in most) and sum(weights):
            assert all(abs(g - budget * w / sum(weights)) < 1 for g, w in zip(got, weights, strict=True))


def test_children_without_a_share_are_guests(spark):
    out = distribution.isolated_union([spark.range(0, 40, 1, 4), spark.range(40, 50, 1, 4), spark.range(50, 60, 1, 4)], 2, [1.0, 1.0, 0.0])
    assert out.rdd.getNumPartitions() == 2 and out.count() == 60
    with pytest.raises(ValueError):
        distribution.isolated_union([spark.range(3)], 2, None, [0])


def test_task_counts_merge(spark):
    count = distribution.TaskCount
    assert (count(desired=3) | count(desired=8) | count(maximum=5) | count(maximum=6)) == count(8, 5)
    assert count(8, 5).resolve(2) == 5 and count(3, 5).resolve(9) == 3 and count(None, 4).resolve(9) == 4 and count().resolve(9) == 9
    assert distribution.with_task_count(spark.range(0, 10, 1, 2), count(desired=5)).rdd.getNumPartitions() == 5


def test_interleaved_children_need_one_shuffle_each(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = distribution.interleaved([spark.range(100), spark.range(50, 70)], 6, "id").groupBy("id").agg(F.count("*").alias("n"))
        assert plan(out).count("Exchange") == 2
        assert out.filter("n = 2").count() == 20 and out.count() == 100
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_union_keeps_children_apart(spark):
    out = distribution.isolated_union([spark.range(0, 100, 1, 8), spark.range(100, 150, 1, 8)], 6, [2.0, 1.0])
    assert out.rdd.getNumPartitions() == 6 and out.count() == 150


# ------------------------------------------------------------------ sources


def test_numbers_split_over_tasks(spark):
    df = numbers.numbers(spark, 0, 10, 3)
    assert df.rdd.getNumPartitions() == 4 and [r.number for r in df.collect()] == [*range(10)]
    assert catalog.run(spark, "SELECT sum(number) AS s FROM numbers(1, 5)").first().s == 10
    assert catalog.run(spark, "SELECT number FROM numbers(0, 1000)").rdd.getNumPartitions() > 1


def test_work_units_make_rows_and_tell_errors(spark):
    df = numbers.work_units(spark, "x", 2, ["rows(2)", "", "wait(1) rows(1)"])
    assert sorted(map(tuple, df.collect())) == [("x", 0, 0, "a"), ("x", 0, 0, "b"), ("x", 0, 1, "a")]
    assert df.join(df.select("letter").distinct(), "letter").unionByName(df).groupBy("task").count().count() == 1
    with pytest.raises(PySparkException, match="boom"):
        numbers.work_units(spark, "x", 1, ["rows(1) err(boom)"]).collect()


# ------------------------------------------------------------------ plans, comparison, streams


def test_stages_and_report(spark, sf_dir):
    df = catalog.query(spark, sf_dir, "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
    assert len(explain.stages(df)) == 2 and any("HashAggregate" in o for o in explain.stages(df)[1])
    report = explain.analyze(df)
    assert report.rows == 3 and report.seconds > 0 and "stage 1" in report.plan
    assert any(k.endswith("numOutputRows") and v > 0 for k, v in report.metrics.items())
    assert explain.graphviz(df).startswith("digraph")
    assert explain.percentiles([3.0, 1.0, 2.0, 4.0]) == {"min": 1.0, "max": 4.0, "avg": 2.5, "p50": 2.0, "p75": 3.0, "p95": 4.0, "p99": 4.0}


def test_headline_queries_prune_columns_and_push_filters(spark, sf_dir):
    widths = {t[0]: len(catalog.table(spark, sf_dir, t).columns) for t in ("lineitem", "orders", "customer", "part")}
    for name, sql in suites.TPCH.items():
        text = plan(catalog.query(spark, sf_dir, sql))
        scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[(.)", text, re.S)
        assert scans, name
        for columns, _ in scans:
            assert len(columns.split(",")) < widths.get(columns[0], 99), (name, columns)
        assert any(first != "]" for _, first in scans), name


def test_metrics_of_every_task(spark, sf_dir):
    df = catalog.query(spark, sf_dir, "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
    report, stages = explain.analyze_tasks(df)
    assert report.rows == df.count() and stages and all(s.tasks == len(s.per_task) for s in stages)
    assert sum(t["rows_read"] for t in stages[0].per_task) == catalog.table(spark, sf_dir, "lineitem").count()
    assert sum(t["bytes_written"] for t in stages[0].per_task) > 0
    assert all(s.durations["min"] <= s.durations["p50"] <= s.durations["p99"] <= s.durations["max"] for s in stages)


def test_handlers_run_in_order(spark):
    handlers, seen = Handlers(), []
    handlers.rewrite(lambda df: seen.append(1) or df.filter("id > 2"))
    handlers.rewrite(lambda df: seen.append(2))
    handlers.rewrite(lambda df: seen.append(3) or df.withColumn("id", F.col("id") * 2))
    assert [r.id for r in handlers.apply(spark.range(5)).collect()] == [6, 8] and seen == [1, 2, 3]
    handlers.rewrite(lambda df: df.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError):
        handlers.apply(spark.range(5))
    handlers.decide("tasks", lambda df: 9, built_in=True)
    handlers.decide("tasks", lambda df: None)
    handlers.decide("tasks", lambda df: 4)
    handlers.decide("tasks", lambda df: 5)
    assert handlers.first("tasks", spark.range(1)) == 4 and handlers.first("other", spark.range(1)) is None


def test_headers_reach_tasks(spark):
    def told(batches):
        for batch in batches:
            yield pd.DataFrame({"h": [str(context.header("tenant"))] * len(batch)})

    def seen():
        return {r.h for r in spark.range(0, 8, 1, 2).mapInPandas(told, "h string").collect()}

    with context.headers(spark, tenant="blue"):
        assert seen() == {"blue"}
    assert seen() == {"None"} and context.header("tenant") is None


def test_kept_state_expires():
    now = [0.0]
    kept = context.Kept(idle=10, most=2, clock=lambda: now[0])
    made = []
    get = lambda k: kept.get(k, lambda: made.append(k) or k.upper())
    assert [get("a"), get("a"), get("b")] == ["A", "A", "B"] and made == ["a", "b"]
    now[0] = 9
    get("a")
    now[0] = 11  # b has been idle for too long
    assert len(kept) == 1 and get("a") == "A" and made == ["a", "b"]
    get("c"), get("d")
    assert len(kept) == 2 and get("a") == "A" and made == ["a", "b", "c", "d", "a"]
    kept.forget("a")
    assert len(kept) == 1


def test_sampler_reads_heads_only(spark):
    df = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") % 4 != 0, (F.col("id") % 10).cast("string")).alias("s"), F.array("id").alias("list"))
    got = {r.name: r for r in sampler.profile(df, rows=100).collect()}
    assert all(r.partitions == 4 and r.rows == 400 and not r.complete for r in got.values())
    assert got["s"].null_share == 0.25 and got["id"].distinct_share == 1 and got["id"].mean_bytes == 8 and got["list"].distinct_share is None
    assert all(r.complete for r in sampler.profile(df, rows=250).collect())
    assert sampler.profile(df.filter("id < 0")).count() == 0


def test_console_tells_what_runs(spark):
    seen = []

    def slow(batches):
        time.sleep(1.5)
        yield from batches

    job = threading.Thread(target=lambda: spark.range(0, 4, 1, 2).mapInPandas(slow, "id long").collect())
    job.start()
    console.watch(spark, lambda: not job.is_alive(), 0.2, seen.append)
    job.join()
    assert any("/2 (" in s for s in seen) and console.render([]) == "idle"
    assert all(0 <= used <= most for used, most in console.executors(spark).values())


def test_plan_shapes(spark, sf_dir):
    catalog.register_tables(spark, sf_dir, ["orders", "lineitem"])
    assert "TakeOrderedAndProject" in plan(spark.sql("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5"))
    assert re.search("LeftAnti.*true", plan(spark.sql("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")))
    assert "WindowGroupLimit" in plan(spark.sql("SELECT * FROM (SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS r FROM orders) t WHERE r <= 2"))
    assert "partial_count" in plan(spark.sql("SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey"))


def test_comparator():
    assert not compare.differences(["b", "a"], [(1, None), (2.0, "x")], ["a", "b"], [("x", 2), (None, 1)])
    assert compare.differences(["a"], [(1,)], ["a"], [(1,), (1,)]) and compare.differences(["a"], [], ["b"], [])
    assert compare.is_sorted([(1,), (2,), (None,)], [(0, False, False)]) and not compare.is_sorted([(1,), (2,)], [(0, True, False)])
    assert compare.is_sorted([(None,), (2,), (1,)], [(0, True, True)])


def keys_of(sql, columns):
    """The sort keys of a statement's last ORDER BY outside of parentheses, by output column; None if
    it has none or sorts by something that is not an output column."""
    depth, at = 0, None
    parts = dialect.tokens(dialect.translate(sql))
    for i, t in enumerate(parts):
        depth += (t == "(") - (t == ")")
        if depth == 0 and t.lower() == "order":
            at = i
    if at is None:
        return None
    text = re.sub(r"(?is)\b(limit|offset)\b.*", "", "".join(parts[at:]))[len("order"):].strip()[2:]
    out = []
    for key in re.split(r",(?![^(]*\))", text):
        m = re.fullmatch(r"(?is)\s*([`\w. ]+?)\s*(asc|desc)?\s*nulls\s+(first|last)\s*", key)
        name = m and m[1].strip("` ").split(".")[-1].strip("`")
        if not m or (name not in columns and not name.isdigit()):
            return None
        out.append((int(name) - 1 if name.isdigit() else columns.index(name), (m[2] or "").lower() == "desc", m[3].lower() == "first"))
    return out


def ordered_queries():
    text = relational.SHARED | suites.TPCH | suites.CLICKS | suites.STAR | star.STAR | {k: v for k, (v, _) in (relational.TWO | suites.CLICKS_TWO).items()}
    return {k: v for k, v in text.items() if re.search(r"(?i)\border\s+by\b", v)}


def test_order_of_results(spark, sf_dir):
    checked = []
    for name, sql in sorted(ordered_queries().items()):
        df = catalog.query(spark, sf_dir, sql)
        keys = keys_of(sql, df.columns)
        if keys:
            assert compare.is_sorted([tuple(r) for r in df.collect()], keys), name
            checked.append(name)
    assert len(checked) >= 60 and {"dialect_null_order_asc", "dialect_null_order_desc", "tpch_q1", "tpch_q9"} <= set(checked)


def test_streams_join_as_tables_do(spark, sf_dir, tmp_path):
    events = catalog.table(spark, sf_dir, "events")
    a = events.filter("event_id % 3 = 0").select("user_id", F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"))
    b = events.filter("event_id % 3 = 1").select("user_id", F.col("event_id").alias("next_id"), F.col("ts").alias("next_ts"))
    want = windows.interval_join(a, b, "user_id", "first_ts", "next_ts", "1 DAY")
    for df, side in ((a, "a"), (b, "b")):
        df.coalesce(1).write.parquet(str(tmp_path / side))
    streams = [windows.event_stream(spark, str(tmp_path / side), df.schema) for df, side in ((a, "a"), (b, "b"))]
    out = windows.interval_join(*streams, "user_id", "first_ts", "next_ts", "1 DAY", late="400 days")
    run = out.writeStream.outputMode("append").format("memory").queryName("near").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("near")
    assert want.count() > 0 and not compare.differences(got.columns, got.collect(), want.columns, want.collect())


def test_stream_equals_table(spark, sf_dir, tmp_path):
    events = catalog.table(spark, sf_dir, "events").select("ts", "event_type", "user_id", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windows.event_stream(spark, str(tmp_path / "in"), events.schema)
    run = windows.tumbling(stream, "ts", "1 day", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = windows.tumbling(events, "ts", "1 day", ["event_type"])
    got = spark.table("tumbled")
    assert not compare.differences(got.columns, got.collect(), want.columns, want.collect())
    assert windows.sessions(events, "ts", "30 minutes", "user_id").agg(F.sum("n")).first()[0] == events.count()
