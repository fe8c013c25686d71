"""Specifications, job files, reports, the command line and the registered queries."""

import json
import os

import pytest

from tallymark import errors as E
from tallymark import report
from tallymark.cli import main
from tallymark.model import Algorithm, DiffResult, Notice, RowDiff, Rule
from tallymark.plans import config
from tallymark.sources import open_table, parse_spec, redact


@pytest.mark.parametrize("text, kind, name", [
    ("postgres://u:p@h:5432/db/public.orders", "postgres", "public.orders"), ("postgresql://h/db/t", "postgres", "t"), ("ch://u@h/d/t", "clickhouse", "t"),
    ("sf://u:p@acc/db/s.t", "snowflake", "s.t"), ("parquet:///data/orders.parquet", "parquet", "orders.parquet"), ("table://cat.db.t", "table", "cat.db.t"),
])
def test_specs(text, kind, name):
    spec = parse_spec(text)
    assert (spec.kind, spec.name) == (kind, name) and "p@" not in str(spec)


@pytest.mark.parametrize("text", ["nothing", "mysql://h/d/t", "postgres://h/d", "parquet://", "postgres://h:x/d/t", "unknown/t"])
def test_bad_specs(text):
    with pytest.raises(E.SourceFailed):
        parse_spec(text, {"known": "postgres://h/d"})


def test_named_connections_and_redaction():
    assert parse_spec("prod/public.t", {"prod": "postgres://u:s%40cret@h/db"}).password == "s@cret"
    assert redact("x postgres://u:se:c/ret@h/db y") == "x postgres://u:***@h/db y" and redact("postgres://u@h/db") == "postgres://u@h/db"


def result(**more):
    r = DiffResult("parquet:/a", "parquet:/b", ["id"], Algorithm.JOINDIFF, 10, 9, 1, 0, 1, **more)
    r.row_diffs = [RowDiff((1,), "missing"), RowDiff((2,), "changed", {"n": (None, "<b>", Rule.STR)})]
    r.notices = [Notice("careful", Rule.TS_NAIVE, "ts")]
    return r


def test_reports():
    r = result(sample_pct=5.0, truncated=True, excluded_columns=["z"])
    text = report.terminal(r)
    for part in ("DIFFERENT (exit code 1)", "SAMPLE of 5 %", "[1] missing", "n by STR-1: 'NULL' became '<b>'", "note: careful", "first 2 differences", "not compared: z"):
        assert part in text
    held = json.loads(report.as_json(r))
    assert held["schema_version"] == 1 and held["missing_in_target"] == 1 and held["row_diffs"][1]["changes"]["n"] == {"source": "NULL", "target": "<b>", "rule": "STR-1"} and held["warning_details"][0]["rule"] == "TS-3"
    page = report.as_html(r)
    assert "&lt;b&gt;" in page and "<b>" not in page and "NULL" in page and "http" not in page and "A4" in page and "Reproduce" in page


def test_keys_of_any_type_are_written_as_json():
    r = result()
    r.row_diffs = [RowDiff((__import__("datetime").date(2024, 1, 1), __import__("decimal").Decimal("1.5")), "extra")]
    assert json.loads(report.as_json(r))["row_diffs"][0]["key"] == ["2024-01-01", "1.5"]


def test_config(tmp_path, monkeypatch):
    monkeypatch.setenv("PW", "secret")
    path = tmp_path / "jobs.yaml"
    path.write_text(json.dumps({"connections": {"a": "postgres://u:${PW}@h/d", "b": {"dsn": "ch://h/d"}}, "tables": [{"source": "a/t", "target": "b/t", "key": "id, x", "column_map": "p:q", "sample": "1%", "output": ["json"]}]}))
    held = config.load(str(path))
    job = held.jobs[0]
    assert "secret" in held.connections["a"] and job.request.key == ["id", "x"] and job.request.column_map == {"p": "q"} and job.request.sample == 1.0 and job.request.algorithm is Algorithm.HASHDIFF
    for bad in ("[1]", '{"tables": [{"source": "x"}]}', '{"connections": {"a": 1}}', "${NOT_THERE}", "{", '{"tables": [{"source": "x", "target": "y", "sample": 0}]}', '{"tables": [{"source": "x", "target": "y", "sample": 1, "algorithm": "joindiff"}]}'):
        path.write_text(bad)
        with pytest.raises(E.CouldNotCompare):
            config.load(str(path))


@pytest.fixture
def tables(spark, tmp_path):
    for name, rows in (("a", [(1, "x"), (2, "y"), (3, "z")]), ("b", [(1, "x"), (2, "Y")])):
        spark.createDataFrame(rows, "id long, name string").write.parquet(str(tmp_path / name))
        spark.createDataFrame(rows, "id long, name string").write.json(str(tmp_path / f"{name}-json"))
    return tmp_path


def test_command_line(spark, tables, capsys):
    a, b = f"parquet://{tables}/a", f"parquet://{tables}/b"
    assert main(["diff", a, a, "--key", "id"], spark) == 0 and "MATCH (exit code 0)" in capsys.readouterr().out
    assert main(["diff", a, b, "--key", "id", "--output", "json", "--output", "html", "--html-path", str(tables / "r.html")], spark) == 1
    assert json.loads(capsys.readouterr().out)["missing_in_target"] == 1 and (tables / "r.html").exists()
    assert main(["diff", a, b, "--key", "id", "--case-insensitive", "--where", "id < 3"], spark) == 0
    assert main(["diff", a, b, "--key", "id", "--fail-on", "none"], spark) == 0
    assert main(["diff", a, f"json://{tables}/a-json", "--key", "id", "--algorithm", "hashdiff"], spark) == 0
    capsys.readouterr()
    assert main(["explain", a, b, "--key", "id"], spark) == 0 and "FullOuter" in capsys.readouterr().out
    for bad in (["diff", a, b], ["diff", a, f"parquet://{tables}/none", "--key", "id"], ["diff", a, "postgres://u:pa55@127.0.0.1:1/d/t", "--key", "id"], ["diff", a, b, "--key", "id", "--sample", "5", "--algorithm", "joindiff"], ["diff", a, b, "--key", "id", "--output", "html"]):
        assert main(bad, spark) == 2
        said = capsys.readouterr()
        assert "error:" in said.err and "pa55" not in said.err + said.out


def test_run_goes_on_and_the_worst_code_counts(spark, tables, capsys):
    path = tables / "jobs.json"
    a, b = f"parquet://{tables}/a", f"parquet://{tables}/b"
    jobs = [{"source": a, "target": f"parquet://{tables}/none", "key": "id"}, {"source": a, "target": a, "key": "id"}, {"source": a, "target": b, "key": "id"}]
    path.write_text(json.dumps({"connections": {"files": f"parquet://{tables}"}, "tables": jobs}))
    assert main(["run", str(path)], spark) == 2
    out = capsys.readouterr().out
    assert "MATCH (exit code 0)" in out and "DIFFERENT (exit code 1)" in out
    path.write_text(json.dumps({"connections": {"files": f"parquet://{tables}"}, "tables": jobs[1:]}))
    assert main(["run", str(path)], spark) == 1
    assert main(["connections", "test", "nobody", "--config", str(path)], spark) == 2


def test_file_formats_and_tables(spark, tables):
    spark.read.parquet(f"{tables}/a").createOrReplaceTempView("known_view")
    for text in (f"parquet://{tables}/a", f"json://{tables}/a-json", "view://known_view"):
        assert open_table(spark, parse_spec(text)).df.count() == 3


SF = "/root/testdata/sf0.001"


def _queries():
    from tallymark.plans import catalog

    return catalog.queries()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(_queries()))
def test_registered_query_equals_its_sql(spark, name):
    import duckdb

    from tallymark.plans import catalog

    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, sql = catalog.queries()[name](spark, SF), con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    tidy = lambda rows, names: sorted(tuple(str(r[names.index(c)]) for c in order) for r in rows)
    assert tidy([tuple(r) for r in df.collect()], df.columns) == tidy(sql.fetchall(), sql.columns)


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_changed_cells_equal_their_sql_where_shifted_keys_meet_other_orders(spark, tmp_path):
    import duckdb

    from tallymark.plans import catalog

    con, shift = duckdb.connect(), 1_000_000
    orders = f"(SELECT i AS o_orderkey, i % 13 AS o_custkey, substr('FOP', i % 3 + 1, 1) AS o_orderstatus, i + 0.25::DOUBLE AS o_totalprice, TIMESTAMP '2024-01-01' + to_days((i % 17)::INT) AS o_orderdate, '1-' || i % 5 AS o_orderpriority FROM (SELECT unnest(range(2000)) AS i UNION ALL SELECT unnest(range({shift}, {shift + 2000}))))"
    con.sql(f"copy {orders} to '{tmp_path}/orders.parquet'")
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    tidy = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    got, sql = catalog.queries()["changed_cells"](spark, str(tmp_path)), con.sql(catalog.oracle_sql()["changed_cells"])
    assert got.columns == sql.columns and tidy(got.collect()) == tidy(sql.fetchall())
