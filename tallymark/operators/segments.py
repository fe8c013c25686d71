"""Key ranges: how many, where they end, and which one a row is in."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import aggregate_hash

ROWS_PER_SEGMENT, LEAST_SEGMENTS = 100_000, 8


def segment_count(rows: int, per_segment: int = ROWS_PER_SEGMENT, least: int = LEAST_SEGMENTS) -> int:
    return max(least, -(-rows // per_segment)) if rows else 1


def numeric_segment(key: Column, lo: int, hi: int, n: int) -> Column:
    """Which of n equal parts of [lo, hi] the key is in, by whole-number arithmetic; keys outside fall in the first or last."""
    width = int(hi) - int(lo) + 1
    place = key.cast("decimal(20,0)") - F.lit(Decimal(int(lo))).cast("decimal(20,0)")
    part = F.call_function("div", place.cast("decimal(21,0)") * F.lit(Decimal(n)).cast("decimal(10,0)"), F.lit(Decimal(width)).cast("decimal(21,0)"))
    return F.least(F.greatest(part, F.lit(0)), F.lit(n - 1)).cast("int")


def numeric_bounds(lo: int, hi: int, n: int) -> list[tuple[int, int | None]]:
    """The parts of ``numeric_segment`` as half-open ranges, the last one open; they tile everything from lo on."""
    width = int(hi) - int(lo) + 1
    cuts = [int(lo) + -(-i * width // n) for i in range(n)]
    return list(zip(cuts, [*cuts[1:], None], strict=True))


def quantile_cuts(df: DataFrame, key: str, n: int, rows: int) -> list:
    """n - 1 ascending cuts, the keys at i / n of the sorted ones, nulls left out; fewer where keys repeat.

    Distinct keys with their numbers are dealt out by range, about how many ranges by ``rows``; each range's sum tells which ones hold the
    places asked for, and only these are summed up key by key. Nothing but sums and cuts reaches the driver.
    """
    keys = df.select(F.col(key).alias("k")).where(F.col(key).isNotNull()).groupBy("k").agg(F.count("*").alias("c"))
    # kept, as another run could draw the ranges elsewhere
    ranged = keys.repartitionByRange(segment_count(max(rows, 1)), "k").withColumn("part", F.spark_partition_id()).persist()
    try:
        parts = ranged.groupBy("part").agg(F.sum("c").alias("n"), F.min("k").alias("least")).orderBy("part").collect()
        rows = sum(r["n"] for r in parts)
        places, wanted, before = sorted({i * rows // n for i in range(1, n)}), [], 0
        for r in parts:
            wanted += [(r["part"], p - before) for p in places if before <= p < before + r["n"]]
            before += r["n"]
        if not wanted:
            return []
        asked = df.sparkSession.createDataFrame(wanted, "part int, place long")
        upto = F.sum("c").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        summed = ranged.join(F.broadcast(asked.select("part").distinct()), "part", "left_semi").withColumn("upto", upto)
        held = summed.join(F.broadcast(asked), "part").where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("c")))
        return sorted({r["k"] for r in held.select("k").collect()} - {parts[0]["least"]})
    finally:
        ranged.unpersist()


def cut_segment(key: Column, cuts: list) -> Column:
    """How many of the cuts are at or below the key, as a balanced tree of comparisons; a null key is in the first part."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts)).cast("int")


def hashed_segment(keys: list[Column], n: int, seed: int = 0) -> Column:
    """A part by hash: even for every kind of key, and for composite ones with a heavy first column."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(n)).cast("int")


def segment_statistics(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, hash, mix): one row a segment; partial sums leave each task, not rows. ``df`` has ``h`` and ``h2``."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), aggregate_hash(F.col("h")).alias("hash"), F.bit_xor("h2").alias("mix"))


def mismatched(source: DataFrame, target: DataFrame, by: list[str]) -> DataFrame:
    """Segments whose statistics differ, or that one side lacks."""
    s = source.select(*by, F.struct("n", "hash", "mix").alias("s"))
    t = target.select(*by, F.struct("n", "hash", "mix").alias("t"))
    return s.join(t, by, "full_outer").where(~F.col("s").eqNullSafe(F.col("t"))).select(*by)
