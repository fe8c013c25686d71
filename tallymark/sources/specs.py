"""The grammar of table specifications.

``engine://user:password@host:port/database/[schema.]table`` for databases,
``format:///path`` (or ``format://store/path``) for files, ``table://[catalog.]name`` and ``view://name`` for
what the session knows, and ``connection/[schema.]table`` for a connection of the configuration.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

from tallymark.errors import SourceFailed

# Accepted spellings of the database engines.
ENGINES = {"postgres": "postgres", "postgresql": "postgres", "clickhouse": "clickhouse", "ch": "clickhouse", "snowflake": "snowflake", "sf": "snowflake"}
FILES = ("parquet", "csv", "json", "orc", "avro", "delta", "text")
KNOWN = ("table", "view")


@dataclass(frozen=True)
class Spec:
    kind: str
    path: str = ""
    host: str = ""
    port: int | None = None
    user: str | None = None
    password: str | None = None
    database: str = ""
    schema: str | None = None
    table: str = ""

    @property
    def name(self) -> str:
        if self.kind in FILES:
            return self.path.rstrip("/").rpartition("/")[2]
        return f"{self.schema}.{self.table}" if self.schema else self.table

    def __str__(self) -> str:
        """As written, without the secrets."""
        if self.kind in ENGINES.values():
            return f"{self.kind}:{self.database}/{self.name}"
        return f"{self.kind}:{self.path or self.table}"


def redact(text: str) -> str:
    """Passwords in anything like a DSN become stars, wherever they stand in the text."""
    return re.sub(r"(://[^\s:/@]*:)\S*(@)", r"\1***\2", text)


def parse_spec(text: str, connections: dict[str, str] | None = None) -> Spec:
    """``text`` as a Spec; a name before the first slash that ``connections`` knows stands for its DSN."""
    if "://" not in text:
        name, _, table = text.partition("/")
        if not connections or name not in connections:
            raise SourceFailed(f"{redact(text)}: neither a DSN nor a table of a known connection")
        return parse_spec(f"{connections[name].rstrip('/')}/{table}")
    scheme, _, rest = text.partition("://")
    scheme = scheme.lower()
    if scheme in FILES:
        if not rest.strip("/"):
            raise SourceFailed(f"{scheme}:// needs a path")
        return Spec(scheme, path=rest)
    if scheme in KNOWN:
        if not rest:
            raise SourceFailed(f"{scheme}:// needs a name")
        return Spec(scheme, table=rest)
    if scheme not in ENGINES:
        raise SourceFailed(f"unknown engine {scheme}")
    try:
        parts = urlsplit(f"{ENGINES[scheme]}://{rest}")
        port = parts.port
    except ValueError as e:
        raise SourceFailed(f"{redact(text)}: {e}") from None
    steps = [unquote(p) for p in parts.path.split("/") if p]
    if len(steps) != 2 or not parts.hostname:
        raise SourceFailed(f"{redact(text)}: expected engine://user:password@host:port/database/[schema.]table")
    schema, _, table = steps[1].rpartition(".")
    return Spec(ENGINES[scheme], host=parts.hostname, port=port, user=unquote(parts.username) if parts.username else None, password=unquote(parts.password) if parts.password else None, database=steps[0], schema=schema or None, table=table)
