"""Projection, filters, bounds, counts, uniqueness and sampling of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.errors import KeyNotUnique
from tallymark.functions import framed, nullable_canonical, signed_hash
from tallymark.model import Options, Pair, Rule

#: Samples are told off in millionths, so a small percentage is never nothing.
SAMPLE_UNITS = 1_000_000


def filtered(df: DataFrame, predicate: str | None) -> DataFrame:
    """Rows that the SQL predicate holds for; Catalyst takes it down to the scan."""
    return df.where(F.expr(predicate)) if predicate else df


def native(pair: Pair) -> bool:
    """Whether a key can be joined on as it is: both sides of one type, whose equal values have equal canonical text."""
    return pair.source_type == pair.target_type and pair.rule in (Rule.INT, Rule.STR, Rule.BOOL, Rule.DATE, Rule.ENUM, Rule.TS, Rule.TS_NAIVE)


def text_of(pair: Pair, side: str, options: Options):
    name, kind = (pair.source, pair.source_type) if side == "source" else (pair.target, pair.target_type)
    return nullable_canonical(F.col(f"`{name}`"), pair.rule, kind, options, pair.scale, pair.precision)


def canonical_side(df: DataFrame, side: str, keys: list[Pair], values: list[Pair], options: Options) -> DataFrame:
    """Keys (as they are where possible) and canonical values, all under the source's names; nothing else is read."""
    key = [(F.col(f"`{p.source if side == 'source' else p.target}`") if native(p) else text_of(p, side, options)).alias(p.source) for p in keys]
    return df.select(*key, *[text_of(p, side, options).alias(p.source) for p in values])


def bounds(df: DataFrame, key: str) -> DataFrame:
    """(lo, hi, n) in one aggregation; from footers alone where the format keeps them."""
    return df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number; combined before the shuffle."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("n")).where("n > 1")


def key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """(rows, twice): the number of rows and the least key that occurs more than once, by one aggregation."""
    each = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count("*").alias("n"))
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    return each.agg(F.sum("n").alias("rows"), F.min(F.when(F.col("n") > 1, key)).alias("twice"))


def require_unique(df: DataFrame, name: str, keys: list[str]) -> int:
    """The number of rows, if no key occurs twice."""
    found = key_check(df, keys).first()
    if found["twice"] is not None:
        raise KeyNotUnique(name, keys, tuple(found["twice"]))
    return found["rows"] or 0


def sample_bucket(keys: list[Pair], side: str, options: Options):
    """A number below SAMPLE_UNITS that depends on the canonical key alone, so both sides sample the same rows."""
    return F.pmod(signed_hash(framed([text_of(p, side, options) for p in keys])), F.lit(SAMPLE_UNITS))


def sampled(df: DataFrame, keys: list[Pair], side: str, options: Options, percent: float) -> DataFrame:
    return df.where(sample_bucket(keys, side, options) < F.lit(round(percent * SAMPLE_UNITS / 100)))


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n keys (all, if fewer) in their order, drawn by a seeded hash of each, so reruns agree; equal keys are drawn once, nulls never.

    Each task keeps its n least hashes, so no more than that leaves it.
    """
    keys = df.select(F.col(f"`{key}`").alias(key)).where(F.col(f"`{key}`").isNotNull()).distinct()
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col(f"`{key}`").cast("string")))
    return keys.orderBy(drawn, F.col(f"`{key}`")).limit(n).orderBy(F.col(f"`{key}`"))


def percent_for(rows: int, largest: int) -> float:
    """The percentage that gives about ``rows`` of the larger side's rows."""
    return min(100.0, rows * 100.0 / largest) if largest else 100.0


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0
