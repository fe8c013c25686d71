"""All differences by one full outer join on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.model import Pair


def joined_sides(source: DataFrame, target: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, in_source, in_target, s_*, t_*): both sides' canonical rows by key.

    NULL keys meet each other. The canonical texts are made below the exchange, by whole-stage code;
    the join is a sort-merge join on a unique key, so no key can be hot.
    """
    s = source.select(F.lit(True).alias("in_source"), *[F.col(f"`{k}`").alias(f"sk_{k}") for k in keys], *[F.col(f"`{v}`").alias(f"s_{v}") for v in values])
    t = target.select(F.lit(True).alias("in_target"), *[F.col(f"`{k}`").alias(f"tk_{k}") for k in keys], *[F.col(f"`{v}`").alias(f"t_{v}") for v in values])
    on = F.lit(True)
    for i, k in enumerate(keys):
        same = F.col(f"`sk_{k}`").eqNullSafe(F.col(f"`tk_{k}`"))
        on = same if not i else on & same
    both = s.join(t, on, "full_outer")
    merged = [F.coalesce(F.col(f"`sk_{k}`"), F.col(f"`tk_{k}`")).alias(k) for k in keys]
    return both.select(*merged, "in_source", "in_target", *[F.col(f"`s_{v}`") for v in values], *[F.col(f"`t_{v}`") for v in values])


def kinds(both: DataFrame, values: list[str]) -> DataFrame:
    """Adds ``kind``: missing, extra, changed, or NULL for equal rows."""
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(f"`s_{v}`").eqNullSafe(F.col(f"`t_{v}`"))
    kind = F.when(F.col("in_target").isNull(), F.lit("missing")).when(F.col("in_source").isNull(), F.lit("extra")).when(differs, F.lit("changed"))
    return both.withColumn("kind", kind)


def differences(source: DataFrame, target: DataFrame, keys: list[str], pairs: list[Pair]) -> DataFrame:
    """(keys, kind, changes): changes is array<struct<column, source, target, rule>>, empty but for changed rows."""
    values = [p.source for p in pairs]
    found = kinds(joined_sides(source, target, keys, values), values).where(F.col("kind").isNotNull())
    none = F.expr("cast(array() as array<struct<column: string, source: string, target: string, rule: string>>)")
    cells = [
        F.when(~F.col(f"`s_{p.source}`").eqNullSafe(F.col(f"`t_{p.source}`")), F.struct(F.lit(p.source).alias("column"), F.col(f"`s_{p.source}`").alias("source"), F.col(f"`t_{p.source}`").alias("target"), F.lit(p.rule.value).alias("rule")))
        for p in pairs
    ]
    changes = F.when(F.col("kind") == "changed", F.filter(F.array(*cells), lambda c: c.isNotNull())).otherwise(none) if cells else none
    return found.select(*[F.col(f"`{k}`") for k in keys], "kind", changes.alias("changes"))


def tally(diffs: DataFrame) -> DataFrame:
    """(missing, extra, changed): exact counts in one row."""
    return diffs.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "extra", "changed")])


def first_differences(diffs: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n by key; each task keeps n rows at most."""
    return diffs.orderBy(*[F.col(f"`{k}`").asc_nulls_first() for k in keys]).limit(n)


def changed_cells(diffs: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """A row for each changed value, of ``columns`` alone if they are given: (keys, column, source, target, rule)."""
    cells = F.col("changes") if columns is None else F.filter("changes", lambda c: c["column"].isin(columns))
    return diffs.where(F.col("kind") == "changed").select(*[F.col(f"`{k}`") for k in keys], F.inline(cells))
