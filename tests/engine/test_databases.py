"""JDBC reads, against an embedded database where Spark ships one; queries of the catalogs as text."""

import dataclasses

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import errors as E
from tallymark.cli import main, options_of, parser, whole_source
from tallymark.functions import canonical
from tallymark.model import Options, Rule
from tallymark.plans import config
from tallymark.plans.compare import Request, compare
from tallymark.sources import databases, open_table, parse_spec, probe, readers


@pytest.fixture(scope="module")
def embedded(spark):
    """A database in the JVM's memory that stands in for the engines; its catalog is played by constants."""
    url = "jdbc:derby:memory:{database};create=true"
    rows = spark.range(5000).select(F.col("id").alias("ID"), F.concat(F.lit("v"), "id").alias("V"))
    for name, df in (("A", rows), ("B", rows.where("ID % 1000 <> 7").withColumn("V", F.when(F.col("ID") == 11, "x").otherwise(F.col("V"))))):
        df.repartition(1).write.format("jdbc").options(url=url.format(database="held"), driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", dbtable=f'"{name}"').save()
    key = lambda schema, table: "SELECT 'ID' AS name FROM SYSIBM.SYSDUMMY1"
    types = lambda schema, table: "SELECT 'V' AS name, 'uuid' AS kind, 3 AS digits FROM SYSIBM.SYSDUMMY1"
    return databases.Database(url, 1, "org.apache.derby.iapi.jdbc.AutoloadedDriver", "APP", key, types, '"', "SELECT 1 AS answer FROM SYSIBM.SYSDUMMY1")


@pytest.fixture
def engine(embedded, monkeypatch):
    monkeypatch.setitem(databases.DATABASES, "postgres", embedded)


def test_tables_are_read_in_ranges_of_their_key(spark, engine):
    table = open_table(spark, parse_spec("postgres://h/held/A"))
    assert table.key == ["ID"] and table.df.rdd.getNumPartitions() == databases.PARTITIONS and table.df.count() == 5000
    assert table.df.schema["V"].metadata["logicalType"] == "uuid"
    assert open_table(spark, parse_spec("postgres://h/held/A"), {"numPartitions": "3"}).df.rdd.getNumPartitions() == 3
    by_hand = {"partitionColumn": "ID", "lowerBound": "0", "upperBound": "5000", "numPartitions": "5"}
    assert open_table(spark, parse_spec("postgres://h/held/A"), by_hand).df.rdd.getNumPartitions() == 5
    assert open_table(spark, parse_spec("postgres://h/held/A"), {"partitionColumn": "ID"}).df.rdd.getNumPartitions() == databases.PARTITIONS


def test_databases_are_compared_without_naming_a_key(spark, engine):
    found = compare(*(open_table(spark, parse_spec(f"postgres://h/held/{n}")) for n in "AB"), Request())
    assert (found.algorithm.value, found.missing, found.extra, found.changed) == ("hashdiff", 5, 0, 1)
    assert found.jobs == 5  # uniqueness, bounds, segments, finer segments, rows


def test_probe_and_connections_test(spark, engine, tmp_path, capsys):
    probe(spark, parse_spec("postgres://h/held/none"))
    path = tmp_path / "jobs.json"
    path.write_text('{"connections": {"here": "postgres://u:p@h/held", "far": {"dsn": "clickhouse://h/d", "options": {"connectTimeout": 1}}}}')
    assert main(["connections", "test", "here", "--config", str(path)], spark) == 0 and "here: ok" in capsys.readouterr().out
    assert main(["connections", "test", "far", "--config", str(path)], spark) == 2
    with pytest.raises(E.QueryFailed):
        open_table(spark, parse_spec("postgres://h/held/NOT_THERE"))


def test_no_connection_is_tried_again(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(readers.databases, "describe", lambda *a: calls.append(1) or (_ for _ in ()).throw(__import__("pyspark").errors.PySparkException("Connection refused")))
    with pytest.raises(E.ConnectionFailed):
        open_table(spark, parse_spec("postgres://h/d/t"), pause=0)
    assert len(calls) == readers.ATTEMPTS


def test_options_of_the_command_line_and_of_job_files(tmp_path):
    args = parser().parse_args(["diff", "a", "b", "--option", "fetchsize=5", "--target-option", "fetchsize=9", "--source-option", "x=a=b"])
    assert options_of(args) == ({"fetchsize": "5", "x": "a=b"}, {"fetchsize": "9"})
    with pytest.raises(E.CouldNotCompare):
        options_of(parser().parse_args(["diff", "a", "b", "--option", "nothing"]))
    path = tmp_path / "jobs.json"
    path.write_text('{"connections": {"c": {"dsn": "ch://h/d", "options": {"a": 1}}}, "tables": [{"source": "c/t", "target": "c/u", "options": {"b": 2}, "target_options": {"b": 3}}]}')
    held = config.load(str(path))
    assert held.connection_options == {"c": {"a": "1"}} and held.jobs[0].options == ({"b": "2"}, {"b": "3"})
    path.write_text('{"tables": [{"source": "c/t", "target": "c/u", "options": [1]}]}')
    with pytest.raises(E.CouldNotCompare):
        config.load(str(path))


def test_dsn_of_a_probe():
    assert whole_source("postgres://u:p@h/db") == "postgres://u:p@h/db/none" and whole_source("ch://h/d/") == "ch://h/d/none"
    assert whole_source("postgres://h/db/t") == "postgres://h/db/t" and whole_source("parquet:///data") == "parquet:///data"


@pytest.mark.parametrize("kind, said", [("uuid", "uuid"), ("jsonb", "json"), ("USER-DEFINED", "enum"), ("Nullable(UUID)", "uuid"), ("LowCardinality(Nullable(Enum8('a' = 1)))", "enum"), ("VARIANT", "json"), ("bigint", None), ("timestamp with time zone", None), ("DateTime64(3)", None), ("time without time zone", "time")])
def test_types_of_catalogs(kind, said):
    assert databases.logical_type(kind) == said


def test_statements_quote_what_they_are_given():
    sql = databases.DATABASES["postgres"].key_sql("pub'lic", "t")
    assert "'pub''lic'" in sql and "PRIMARY KEY" in sql
    assert "system.columns" in databases.DATABASES["clickhouse"].types_sql("d", "t")
    spec = dataclasses.replace(parse_spec("ch://u:p@h/d/t"), table="a`b")
    assert databases.table_name(spec) == "`a``b`"
    assert databases.reader_options(parse_spec("sf://u:p@acc/db/s.t"), {"fetchsize": 3})["fetchsize"] == "3"


def test_times_that_arrive_as_timestamps(spark):
    kind = T.TimestampNTZType()
    assert spark.sql("select timestamp_ntz'1970-01-01 13:05:06.25' x").select(canonical(F.col("x"), Rule.TIME, kind, Options())).first()[0] == "13:05:06.250000"
