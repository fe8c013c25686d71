"""Job files: connections and table pairs, with ``${NAME}`` taken from the environment."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

from tallymark.errors import CouldNotCompare
from tallymark.model import Algorithm, Options
from tallymark.plans.compare import Request

try:
    import yaml
except ImportError:  # JSON is YAML too, and needs no library
    yaml = None


@dataclass(frozen=True)
class Job:
    source: str
    target: str
    request: Request
    fail_on: str = "any"
    output: tuple[str, ...] = ("terminal",)
    json_path: str | None = None
    html_path: str | None = None
    options: tuple[dict, dict] = field(default_factory=lambda: ({}, {}))


@dataclass(frozen=True)
class Config:
    connections: dict[str, str] = field(default_factory=dict)
    jobs: tuple[Job, ...] = ()
    connection_options: dict[str, dict] = field(default_factory=dict)


def with_environment(text: str) -> str:
    def value(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise CouldNotCompare(f"the environment has no {m[1]}")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", value, text)


def names(value, what: str) -> list[str] | None:
    """A list of names, or one text with commas."""
    if value is None:
        return None
    if isinstance(value, str):
        value = value.split(",")
    if not isinstance(value, list):
        raise CouldNotCompare(f"{what}: expected a list or a text with commas")
    return [str(v).strip() for v in value if str(v).strip()] or None


def mapping(value) -> dict[str, str] | None:
    """``a:b,c:d`` or a mapping."""
    if not value:
        return None
    if isinstance(value, dict):
        return {str(k): str(v) for k, v in value.items()}
    pairs = [p.partition(":") for p in str(value).split(",") if p.strip()]
    if any(not a.strip() or not sep or not b.strip() for a, sep, b in pairs):
        raise CouldNotCompare(f"column map {value!r}: expected source:target, with commas between pairs")
    return {a.strip(): b.strip() for a, _, b in pairs}


def request_of(said: dict) -> Request:
    """A Request from the names that job files and the command line share."""
    options = Options(bool(said.get("trim", False)), bool(said.get("case_insensitive", False)), int(said.get("float_precision", 15)), str(said.get("assume_tz", "UTC")), bool(said.get("exact_floats", False)))
    try:
        algorithm = Algorithm(said.get("algorithm", "auto"))
    except ValueError:
        raise CouldNotCompare(f"unknown algorithm {said.get('algorithm')!r}") from None
    sample, rows = said.get("sample"), said.get("sample_rows")
    if sample is not None and rows is not None:
        raise CouldNotCompare("a sample is by percentage or by rows, not both")
    if sample is not None:
        try:
            sample = float(str(sample).rstrip("% "))
        except ValueError:
            raise CouldNotCompare(f"{sample!r} is no percentage") from None
        if not 0 < sample <= 100:
            raise CouldNotCompare("a sample is more than 0 and at most 100 per cent")
    if (sample is not None or rows is not None) and algorithm is Algorithm.JOINDIFF:
        raise CouldNotCompare("sampling goes with hashdiff or auto, not with joindiff")
    if algorithm is Algorithm.AUTO and (sample is not None or rows is not None):
        algorithm = Algorithm.HASHDIFF
    return Request(
        key=names(said.get("key"), "key"), columns=names(said.get("columns"), "columns"), exclude=names(said.get("exclude"), "exclude"),
        where=said.get("where"), where_source=said.get("where_source"), where_target=said.get("where_target"), column_map=mapping(said.get("column_map")),
        algorithm=algorithm, row_threshold=int(said.get("row_threshold", 1000)), max_diff_rows=int(said.get("max_diff_rows", 10_000)), sample=sample, sample_rows=int(rows) if rows is not None else None, options=options,
    )


def reader_options(value, what: str) -> dict[str, str]:
    if not isinstance(value or {}, dict):
        raise CouldNotCompare(f"{what}: options are a mapping")
    return {str(k): str(v) for k, v in (value or {}).items()}


def job_options(said: dict, i: int) -> tuple[dict, dict]:
    """The reader options of both sides: ``options`` for both, ``source_options`` and ``target_options`` for one."""
    both, source, target = (reader_options(said.get(name), f"table pair {i}") for name in ("options", "source_options", "target_options"))
    return {**both, **source}, {**both, **target}


def load(path: str) -> Config:
    try:
        with open(path, encoding="utf-8") as f:
            text = with_environment(f.read())
        held = (yaml.safe_load(text) if yaml else json.loads(text)) or {}
    except OSError as e:
        raise CouldNotCompare(f"{path}: {e.strerror}") from e
    except ValueError as e:
        raise CouldNotCompare(f"{path} can't be parsed: {e}") from e
    except Exception as e:
        if yaml and isinstance(e, yaml.YAMLError):
            raise CouldNotCompare(f"{path} can't be parsed: {e}") from e
        raise
    if not isinstance(held, dict):
        raise CouldNotCompare(f"{path} must hold a mapping with connections and tables")
    connections, connection_options = {}, {}
    for name, value in (held.get("connections") or {}).items():
        dsn = value.get("dsn") if isinstance(value, dict) else value
        if not isinstance(dsn, str):
            raise CouldNotCompare(f"connection {name}: expected a DSN")
        connections[name] = dsn
        connection_options[name] = reader_options(value.get("options") if isinstance(value, dict) else None, f"connection {name}")
    jobs = []
    for i, said in enumerate(held.get("tables") or []):
        if not isinstance(said, dict) or not said.get("source") or not said.get("target"):
            raise CouldNotCompare(f"table pair {i}: source and target are needed")
        if said.get("fail_on", "any") not in ("any", "count", "none"):
            raise CouldNotCompare(f"table pair {i}: fail_on is any, count or none")
        jobs.append(Job(said["source"], said["target"], request_of(said), said.get("fail_on", "any"), tuple(names(said.get("output"), "output") or ["terminal"]), said.get("json_path"), said.get("html_path"), job_options(said, i)))
    return Config(connections, tuple(jobs), connection_options)
