"""Tables of databases by Spark's JDBC reader.

A table whose key begins with a whole number is read in ranges of it, each by a task's own
connection, so a side is never pulled through one; Spark takes column pruning and filters down to the
database. Keys and types come from the databases' catalogs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.sources.specs import Spec


@dataclass(frozen=True)
class Database:
    """What differs between engines: address, driver, quoting, and where the catalog keeps keys and types."""

    url: str
    port: int
    driver: str
    schema: str
    key_sql: Callable[[str, str], str]
    types_sql: Callable[[str, str], str]
    mark: str = '"'
    probe_sql: str = "SELECT 1 AS answer"


def quoted(name: str, mark: str = '"') -> str:
    return mark + name.replace(mark, mark * 2) + mark


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "''") + "'" if "\\" in text else "'" + text.replace("'", "''") + "'"


def _standard_key(schema: str, table: str) -> str:
    return (
        "SELECT k.column_name AS name FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k "
        "ON k.constraint_name = c.constraint_name AND k.table_schema = c.table_schema AND k.table_name = c.table_name "
        f"WHERE c.constraint_type = 'PRIMARY KEY' AND c.table_schema = {literal(schema)} AND c.table_name = {literal(table)} ORDER BY k.ordinal_position"
    )


def _standard_types(schema: str, table: str) -> str:
    return f"SELECT column_name AS name, data_type AS kind, datetime_precision AS digits FROM information_schema.columns WHERE table_schema = {literal(schema)} AND table_name = {literal(table)}"


def _clickhouse_key(database: str, table: str) -> str:
    return f"SELECT name FROM system.columns WHERE database = {literal(database)} AND table = {literal(table)} AND is_in_primary_key = 1 ORDER BY position"


def _clickhouse_types(database: str, table: str) -> str:
    return f"SELECT name, type AS kind, datetime_precision AS digits FROM system.columns WHERE database = {literal(database)} AND table = {literal(table)}"


# Addresses, default ports, driver classes and default schemas of the databases.
DATABASES = {
    "postgres": Database("jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver", "public", _standard_key, _standard_types),
    "clickhouse": Database("jdbc:clickhouse://{host}:{port}/{database}", 8123, "com.clickhouse.jdbc.ClickHouseDriver", "", _clickhouse_key, _clickhouse_types, "`"),
    "snowflake": Database("jdbc:snowflake://{host}.snowflakecomputing.com:{port}/?db={database}", 443, "net.snowflake.client.jdbc.SnowflakeDriver", "PUBLIC", _standard_key, _standard_types),
}

#: A catalog's names of types that Spark sees as text or plain timestamps, in lower case, by how they begin; the longest fits.
LOGICAL_TYPES = {"uuid": "uuid", "json": "json", "jsonb": "json", "variant": "json", "object": "json", "user-defined": "enum", "enum": "enum", "time without": "time", "time": "time", "timestamp": "", "datetime": ""}
#: Ranges of a partitioned read, unless the options say otherwise.
PARTITIONS = 32


@dataclass
class Described:
    """What a database's catalog says of a table."""

    key: list[str] | None = None
    hints: dict[str, str] = field(default_factory=dict)
    digits: dict[str, int] = field(default_factory=dict)


def reader_options(spec: Spec, options: dict) -> dict[str, str]:
    """The JDBC options of a connection; what the user gives comes last."""
    base = DATABASES[spec.kind]
    held = {"url": base.url.format(host=spec.host, port=spec.port or base.port, database=spec.database), "driver": base.driver, "fetchsize": "10000"}
    return held | {k: v for k, v in (("user", spec.user), ("password", spec.password)) if v is not None} | {k: str(v) for k, v in options.items()}


_PARTITIONING = ("partitioncolumn", "lowerbound", "upperbound", "numpartitions", "dbtable")


def ask(spark: SparkSession, spec: Spec, options: dict, sql: str) -> DataFrame:
    """The rows of a query that the database runs."""
    plain = {k: v for k, v in options.items() if k.lower() not in _PARTITIONING}
    return spark.read.format("jdbc").options(**reader_options(spec, plain)).option("query", sql).load()


def logical_type(kind: str) -> str | None:
    """The logical type that a catalog's type name stands for, without ClickHouse's wrappers; None where Spark's own type says it all."""
    bare = kind.strip().lower()
    for wrapper in ("lowcardinality(", "nullable("):
        bare = bare.removeprefix(wrapper)
    fits = [name for name in LOGICAL_TYPES if bare.startswith(name)]
    return LOGICAL_TYPES[max(fits, key=len)] or None if fits else None


def describe(spark: SparkSession, spec: Spec, options: dict) -> Described:
    base = DATABASES[spec.kind]
    schema = spec.schema or base.schema or spec.database
    found = Described([r[0] for r in ask(spark, spec, options, base.key_sql(schema, spec.table)).collect()] or None)
    for name, kind, digits in ask(spark, spec, options, base.types_sql(schema, spec.table)).collect():
        if said := logical_type(kind or ""):
            found.hints[name] = said
        if digits is not None:
            found.digits[name] = int(digits)
    return found


def table_name(spec: Spec) -> str:
    return ".".join(quoted(p, DATABASES[spec.kind].mark) for p in (spec.schema, spec.table) if p)


def ranges(schema: T.StructType, key: list[str] | None, options: dict) -> str | None:
    """The column to read by ranges of: what the options name, else the first key column if it is a whole number."""
    given = {k.lower(): v for k, v in options.items()}
    if "partitioncolumn" in given:
        return None if "lowerbound" in given else given["partitioncolumn"]
    if not key or key[0] not in schema.names:
        return None
    kind = schema[key[0]].dataType
    return key[0] if isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0 else None


def read(spark: SparkSession, spec: Spec, options: dict, described: Described | None = None) -> DataFrame:
    """The table, in ranges of its key where that is a whole number or as the options say."""
    load = lambda more: spark.read.format("jdbc").options(**reader_options(spec, more)).option("dbtable", table_name(spec)).load()
    plain = {k: v for k, v in options.items() if k.lower() not in _PARTITIONING}
    df = load(plain)
    given = {k.lower(): v for k, v in options.items() if k.lower() in _PARTITIONING}
    column = ranges(df.schema, described.key if described else None, options)
    if column is None:
        return load(options) if "partitioncolumn" in given else df
    name = quoted(column, DATABASES[spec.kind].mark)
    lo, hi = ask(spark, spec, options, f"SELECT MIN({name}) AS lo, MAX({name}) AS hi FROM {table_name(spec)}").first()
    if lo is None:
        return df
    # the outer ranges are open and the first one has the NULLs, so no row is lost whatever was added since
    return load(plain | {"partitionColumn": column, "lowerBound": int(lo), "upperBound": int(hi) + 1, "numPartitions": given.get("numpartitions", PARTITIONS)})


def with_types(df: DataFrame, described: Described) -> DataFrame:
    """``df`` with what the catalog says of its columns as fields' metadata, where the matching of columns looks for it."""
    own = {}
    for f in df.schema.fields:
        said = {"logicalType": described.hints[f.name]} if f.name in described.hints else {}
        if f.name in described.digits and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            said["precision"] = described.digits[f.name]
        if said:
            own[f.name] = F.col(quoted(f.name, "`")).alias(f.name, metadata=said)
    return df.withColumns(own) if own else df
