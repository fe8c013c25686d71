"""URL filters by a bit-parallel wildcard automaton.

Every rule becomes a glob over the canonical URL ``"." host SEP path``, SEP being a symbol that no
byte equals. All globs are laid side by side into one bit string of several 64-bit words; a
Shift-And step moves the states of all of them at once, and numpy does that step for a whole batch
of URLs. A ``*`` is a state that stays set on every symbol.

The plan is one map over the rows: no shuffle, and the automaton's size depends on the rules only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import table, utf8

SEP = 256
STAR, ANY = -1, -2


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``; both are literal."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    def symbols(self) -> list[int]:
        return [STAR, *f".{self.host}".encode(), SEP, *self.path.encode(), STAR]


@dataclass(frozen=True)
class GlobRule:
    """``*`` is any run of bytes, ``?`` is any byte; the host glob is held against "." + host."""

    action: str
    host: str
    path: str

    def symbols(self) -> list[int]:
        turn = lambda s: [{42: STAR, 63: ANY}.get(b, b) for b in s.encode()]
        return [*turn(self.host), SEP, *turn(self.path)]


#: The rules that the registered query applies.
HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
#: What decides where no host rule fits; else the default holds.
GLOB_RULES = (
    GlobRule("block", "*.ads.*", "*"),
    GlobRule("block", "*", "*/admin/*"),
    GlobRule("block", "*", "*/cart/*"),
    GlobRule("block", "*", "*.exe"),
)
DEFAULT = "allow"


class Automaton:
    """All globs in one bit string: for each the start state, then one bit a literal."""

    def __init__(self, globs: list[list[int]]):
        bits: list[tuple[int, int, bool]] = []  # the symbol that leads here (-3: a start), the glob, stays set
        self.accept = []
        for g, glob in enumerate(globs):
            bits.append((-3, g, False))
            for symbol in glob:
                if symbol == STAR:
                    bits[-1] = (*bits[-1][:2], True)
                else:
                    bits.append((symbol, g, False))
            self.accept.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.start, self.loop = np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        self.masks = np.zeros((257, self.words), np.uint64)
        for i, (symbol, _, stays) in enumerate(bits):
            word, bit = divmod(i, 64)
            one = np.uint64(1 << bit)
            if symbol == -3:
                self.start[word] |= one
            elif symbol == ANY:
                self.masks[:256, word] |= one
            else:
                self.masks[symbol, word] |= one
            if stays:
                self.loop[word] |= one

    def step(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """One symbol for each row of ``state``; a start bit has no mask, so no glob runs into the next."""
        moved = state << np.uint64(1)
        if self.words > 1:
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return (moved & self.masks[symbols]) | (state & self.loop)

    def run(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which globs match each string data[at[i]:at[i + 1]], as booleans of shape (strings, globs)."""
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        starts, longest_first = at[:-1][order], sizes[order]
        state = np.repeat(self.start[None, :], len(sizes), axis=0)
        alive = np.searchsorted(-longest_first, -np.arange(int(longest_first[0]) if len(sizes) else 0), side="left")
        for t, n in enumerate(alive):
            state[:n] = self.step(state[:n], data[starts[:n] + t])
        out = np.empty((len(sizes), len(self.accept)), bool)
        for g, i in enumerate(self.accept):
            word, bit = divmod(i, 64)
            out[order, g] = (state[:, word] >> np.uint64(bit)) & np.uint64(1)
        return out


def canonical(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of "." host SEP path for each row, end to end, and where each begins."""
    (h, h_at), (p, p_at) = utf8(hosts), utf8(paths)
    n, hl, pl = len(h_at) - 1, np.diff(h_at), np.diff(p_at)
    at = np.concatenate(([0], np.cumsum(hl + pl + 2)))
    out = np.full(int(at[-1]), SEP, np.int16)
    out[at[:-1]] = 46
    out[np.arange(len(h)) + np.repeat(at[:-1] + 1 - h_at[:-1], hl)] = h
    out[np.arange(len(p)) + np.repeat(at[:-1] + 2 + hl - p_at[:-1], pl)] = p
    assert len(at) == n + 1
    return out, at


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://`` up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``. Else both empty."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, url.substr(start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules=HOST_RULES, glob_rules=GLOB_RULES, default: str = DEFAULT) -> DataFrame:
    """Judge each URL: (id, host, path, rule, verdict).

    The longest host rule that fits decides (the first of equals); where none fits, a glob rule
    does (``block`` before ``allow``), else ``default``. A URL that is null or has no ``://`` has
    empty host and path, so only globs for the empty URL or the default decide. Every row stays, repeated ones
    too; a null id stays null; columns other than the two named are not read.
    """
    rank = {r: i for i, r in enumerate(host_rules)}
    ordered = sorted(host_rules, key=lambda r: (len(r.text), -rank[r]))
    globs = [r.symbols() for r in ordered] + [r.symbols() for r in glob_rules]
    names = np.array([r.text for r in ordered] + [None], object)
    actions = np.array([r.action for r in ordered], object)
    automaton = Automaton(globs)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = canonical(batch.column(1), batch.column(2))
            hit = automaton.run(data, at)
            rule = np.full(len(batch), -1)
            for i in range(len(ordered)):
                rule[hit[:, i]] = i
            verdict = np.full(len(batch), default, object)
            for action in ("allow", "block"):
                for g, r in enumerate(glob_rules, len(ordered)):
                    if r.action == action:
                        verdict[hit[:, g]] = action
            found = rule >= 0
            verdict[found] = actions[rule[found]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[rule], pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    id_type = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(judge, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_FITS = "((host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}'))"

OP10_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), ruled AS (
  SELECT *, CASE WHEN {_FITS.format(h="example.org", p="/en/1")} THEN 'example.org/en/1'
                 WHEN {_FITS.format(h="example.org", p="/es/")} THEN 'example.org/es/'
                 WHEN {_FITS.format(h="com", p="/fr/")} THEN 'com/fr/'
                 WHEN {_FITS.format(h="com", p="/de/")} THEN 'com/de/'
                 WHEN {_FITS.format(h="org", p="/")} THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN contains('.' || host, '.ads.') OR contains(path, '/admin/') OR contains(path, '/cart/') OR suffix(path, '.exe') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""
