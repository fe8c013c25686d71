"""Readers: one for each kind of Spec. Nothing here writes to what it reads."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tallymark.errors import ConnectionFailed, QueryFailed, SourceFailed
from tallymark.sources import databases
from tallymark.sources.databases import DATABASES
from tallymark.sources.specs import FILES, Spec

ATTEMPTS, PAUSE = 3, 0.5
OPTIONS = {"csv": {"header": "true", "inferSchema": "true"}}


@dataclass
class Table:
    """A DataFrame with the name it is reported by and, where known, its unique columns and its columns' logical types."""

    df: DataFrame
    name: str
    label: str
    key: list[str] | None = None
    hints: dict[str, str] = field(default_factory=dict)


def _file(spark: SparkSession, spec: Spec, options: dict) -> DataFrame:
    return spark.read.format(spec.kind).options(**OPTIONS.get(spec.kind, {}) | options).load(spec.path)


def _known(spark: SparkSession, spec: Spec, options: dict) -> DataFrame:
    return spark.table(spec.table)


FORMATS: dict[str, Callable[[SparkSession, Spec, dict], DataFrame]] = {**dict.fromkeys(FILES, _file), "table": _known, "view": _known, **dict.fromkeys(DATABASES, databases.read)}


def declared_key(spark: SparkSession, spec: Spec) -> list[str] | None:
    """The columns that a catalog table's property ``key`` names."""
    if spec.kind != "table":
        return None
    try:
        rows = spark.sql(f"SHOW TBLPROPERTIES {spec.table}").collect()
    except PySparkException:
        return None
    found = {r["key"]: r["value"] for r in rows}.get("key")
    return [c.strip() for c in found.split(",")] if found else None


def _why(error: Exception) -> str:
    text = str(getattr(error, "java_exception", None) or error)
    return text.strip().splitlines()[0][:300] if text.strip() else type(error).__name__


#: How drivers and Spark put it that there is no connection (or no driver for one), in lower case; all else is a query's own failure.
_NO_CONNECTION = ("connection", "connect ", "classnotfound", "no suitable driver", "unknownhost", "timed out", "password", "authentication", "access denied")


def failed(spec: Spec, error: Exception) -> SourceFailed:
    said = _why(error)
    if spec.kind in DATABASES and any(w in said.lower() for w in _NO_CONNECTION):
        return ConnectionFailed(f"{spec}: {said}")
    return (QueryFailed if spec.kind in DATABASES else SourceFailed)(f"{spec}: {said}")


def again(spec: Spec, action: Callable, attempts: int = ATTEMPTS, pause: float = PAUSE):
    """``action()``; where a database doesn't answer it is asked again, as connections fail for a moment. Queries that are wrong stay wrong."""
    for i in range(1, attempts + 1):
        try:
            return action()
        except (PySparkException, Py4JJavaError) as e:
            error = failed(spec, e)
            if i == attempts or not isinstance(error, ConnectionFailed):
                raise error from e
            time.sleep(pause * i)
    raise AssertionError


def open_table(spark: SparkSession, spec: Spec, options: dict | None = None, attempts: int = ATTEMPTS, pause: float = PAUSE) -> Table:
    """Resolve ``spec``: of a database also the key and the types, which its catalog knows; ``options`` go to the reader."""

    def read() -> Table:
        if spec.kind in DATABASES:
            described = databases.describe(spark, spec, dict(options or {}))
            df = databases.read(spark, spec, dict(options or {}), described)
            return Table(databases.with_types(df, described), spec.name, str(spec), described.key, described.hints)
        return Table(FORMATS[spec.kind](spark, spec, dict(options or {})), spec.name, str(spec), declared_key(spark, spec))

    return again(spec, read, attempts, pause)


def probe(spark: SparkSession, spec: Spec, options: dict | None = None, attempts: int = ATTEMPTS, pause: float = PAUSE) -> None:
    """Whether the source answers: a database is asked for a constant, anything else for one row."""
    if spec.kind in DATABASES:
        again(spec, lambda: databases.ask(spark, spec, dict(options or {}), DATABASES[spec.kind].probe_sql).collect(), attempts, pause)
        return
    table = open_table(spark, spec, options)
    try:
        table.df.limit(1).collect()
    except (PySparkException, Py4JJavaError) as e:
        raise failed(spec, e) from e
