from gneiss import catalog, repl


def test_statements_are_split_outside_of_texts():
    assert repl.statements("SELECT ';' -- a;b\n; SELECT 2 /* ; */;;") == ["SELECT ';'", "SELECT 2"]


def test_shell_runs_statements(spark, sf_dir, tmp_path, capsys, monkeypatch):
    catalog.register_tables(spark, sf_dir, ["nation"])
    monkeypatch.setattr(repl, "session", lambda *a, **k: spark)
    rc = tmp_path / "rc"
    rc.write_text("CREATE VIEW few AS SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey < 3;")
    repl.main(["--rc", str(rc), "-c", "SELECT k, n_name FROM few ORDER BY k", "--format", "csv"])
    assert capsys.readouterr().out.splitlines()[0] == "k,n_name"
    repl.main(["--rc", str(rc), "-c", f"SELECT count(*) AS n FROM '{sf_dir}/region.parquet'; SHOW COLUMNS FROM few", "--format", "json"])
    out = capsys.readouterr().out
    assert '{"n": 5}' in out and '"column_name": "k"' in out
    repl.main(["--rc", "none", "-c", "EXPLAIN ANALYZE VERBOSE SELECT count(*) AS n FROM few; SELECT nope; SELECT NULL AS x"])
    seen = capsys.readouterr()
    assert "stage 0" in seen.out and "rows 1," in seen.out and "| x |" in seen.out and "error:" in seen.err
    repl.main(["--rc", "none", "-c", f"COPY (SELECT k FROM few) TO '{tmp_path}/out' STORED AS parquet; SET gneiss.broadcast_bytes = 1000"])
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "1000"
    repl.main(["--rc", "none", "-c", "SET gneiss.broadcast_bytes = 10485760; CREATE VIEW odd AS SELECT nullif(k, 1) AS v FROM few", "--format", "csv"])
    repl.main(["--rc", "none", "-c", "SELECT v FROM odd ORDER BY v; SELECT `v` FROM odd ORDER BY v; SELECT v FROM `odd` ORDER BY v DESC", "--format", "json"])
    assert [line[6:-1] for line in capsys.readouterr().out.splitlines()] == ["0", "2", "null"] * 2 + ["null", "2", "0"]
    repl.main(["--rc", "none", "-c", f"SELECT nullif(r_regionkey, 2) AS v FROM '{sf_dir}/region.parquet' ORDER BY v LIMIT 5", "--format", "json"])
    assert capsys.readouterr().out.splitlines()[-1] == '{"v": null}'
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
