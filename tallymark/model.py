"""Rules, options and results: plain values, no Spark in them."""

from __future__ import annotations

import enum
from dataclasses import dataclass, field
from typing import Any


class Rule(enum.Enum):
    """How a value is put into canonical text; every reported change names the rule that governed it."""

    # The published identifiers of the rules.
    NULL = "NULL-1"
    INT = "INT-1"
    DEC = "DEC-1"
    FLT = "FLT-1"
    STR = "STR-1"
    STR_FOLDED = "STR-2"
    BOOL = "BOOL-1"
    TS = "TS-1"
    TS_ROUNDED = "TS-2"
    TS_NAIVE = "TS-3"
    DATE = "DATE-1"
    TIME = "TIME-1"
    UUID = "UUID-1"
    BIN = "BIN-1"
    JSON = "JSON-1"
    ARR = "ARR-1"
    ENUM = "ENUM-1"
    UNKNOWN = "UNK-1"


class Algorithm(enum.Enum):
    AUTO = "auto"
    HASHDIFF = "hashdiff"
    JOINDIFF = "joindiff"


@dataclass(frozen=True)
class Options:
    """What holds for a whole comparison."""

    trim: bool = False
    case_insensitive: bool = False
    float_precision: int = 15
    assume_tz: str = "UTC"
    exact_floats: bool = False


@dataclass(frozen=True)
class Pair:
    """A column of the source and its partner, both rendered by one rule."""

    source: str
    target: str
    rule: Rule
    source_type: Any
    target_type: Any
    scale: int = 0
    precision: int = 6


@dataclass(frozen=True)
class Notice:
    message: str
    rule: Rule | None = None
    column: str | None = None


@dataclass(frozen=True)
class RowDiff:
    key: tuple
    kind: str
    changes: dict[str, tuple[str | None, str | None, Rule]] = field(default_factory=dict)


@dataclass
class DiffResult:
    source: str
    target: str
    key_columns: list[str]
    algorithm: Algorithm
    source_count: int = 0
    target_count: int = 0
    missing: int = 0
    extra: int = 0
    changed: int = 0
    row_diffs: list[RowDiff] = field(default_factory=list)
    truncated: bool = False
    notices: list[Notice] = field(default_factory=list)
    excluded_columns: list[str] = field(default_factory=list)
    segments_examined: int = 0
    jobs: int = 0
    elapsed_seconds: float = 0.0
    sample_pct: float | None = None
    statements: list[str] = field(default_factory=list)
    diffs: Any = None  # the whole list of differences, a DataFrame

    @property
    def is_match(self) -> bool:
        return self.source_count == self.target_count and not (self.missing or self.extra or self.changed)

    def exit_code(self, fail_on: str = "any") -> int:
        """0 or 1. ``any``: every difference counts; ``count``: only unequal row counts do; ``none``: nothing does."""
        if fail_on == "none":
            return 0
        if fail_on == "count":
            return int(self.source_count != self.target_count)
        return int(not self.is_match)
