"""Differences by segment hashes: rows move only where segments disagree.

Level one sums a hash over each key range (or hash bucket) of each side: a task sends one row a
segment. Level two does so again, in finer hash buckets, for the rows of segments that disagree.
What still disagrees is compared row by row by the full outer join. Each level reads the input again with
its columns pruned, which is cheaper than a shuffle of all rows when the sides are nearly equal.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import framed, signed_hash
from tallymark.model import Pair
from tallymark.operators import segments as S
from tallymark.operators.joindiff import differences

SIDES = ("source", "target")
#: Segments below which their list is small enough to be sent to every task: sixteen bytes each.
SENT_SEGMENTS = 500_000
#: Segments of a text key up to which rows are placed by comparisons with the cuts; source rows above which that is worth a sort of the keys.
TEXT_CUTS, LEAST_ROWS = 256, 10_000


@dataclass
class Segmented:
    """What hashdiff found out on the way to ``diffs``."""

    diffs: DataFrame
    segments: int
    bad: int
    reads: int = 0  # of each side, up to and with the rows
    steps: list[tuple[str, DataFrame]] = field(default_factory=list)  # what was run before ``diffs``, by title


def with_hashes(side: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Adds ``h``, the published row hash over unambiguous text, and ``h2``, an independent one."""
    text = framed([F.col(f"`{c}`").cast("string") for c in [*keys, *values]])
    return side.withColumn("h", signed_hash(text)).withColumn("h2", F.xxhash64(text))


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType) or isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision <= 20


def segment_bounds(side: DataFrame, keys: list[str]) -> DataFrame:
    """(n, and lo and hi of a whole-number first key) of one side."""
    ends = [F.min(f"`{keys[0]}`").alias("lo"), F.max(f"`{keys[0]}`").alias("hi")] if _whole(side.schema[keys[0]].dataType) else []
    return side.agg(F.count("*").alias("n"), *ends)


def choose_segment(source: DataFrame, target: DataFrame, keys: list[str], per_segment: int) -> tuple[Column, int, int]:
    """The segment of a row, how many there are, and the reads that took: ranges of a single whole-number key, quantiles of
    a single text key where the tasks can do with TEXT_CUTS comparisons, else hash buckets, which are even for every kind of key."""
    kind = source.schema[keys[0]].dataType
    a, b = segment_bounds(source, keys).first(), segment_bounds(target, keys).first()
    n = S.segment_count(max(a["n"], b["n"]), per_segment)
    if len(keys) == 1:
        ends = [x for r in (a, b) for x in (r["lo"], r["hi"]) if x is not None] if _whole(kind) else []
        if ends:
            return F.coalesce(S.numeric_segment(F.col(f"`{keys[0]}`"), min(ends), max(ends), n), F.lit(0)), n, 1
        if isinstance(kind, T.StringType) and LEAST_ROWS < a["n"] and n <= TEXT_CUTS:
            return S.cut_segment(F.col(f"`{keys[0]}`"), S.quantile_cuts(source.select(F.col(f"`{keys[0]}`").alias("k")), "k", n, a["n"])), n, 2
    return S.hashed_segment([F.col(f"`{k}`") for k in keys], n), n, 1


def only(rows: DataFrame, bad: DataFrame, by: list[str], n: int) -> DataFrame:
    """Rows of the segments in ``bad``, which is sent to the tasks where its size, n at most, allows it."""
    return rows.join(F.broadcast(bad) if n <= SENT_SEGMENTS else bad, by, "left_semi")


def hashdiff(source: DataFrame, target: DataFrame, keys: list[str], pairs: list[Pair], per_segment: int = S.ROWS_PER_SEGMENT, row_threshold: int = 1000) -> Segmented:
    """Differences of two canonical sides (see ``canonical_side``), as ``joindiff.differences`` gives them."""
    values = [p.source for p in pairs]
    segment, n, reads = choose_segment(source, target, keys, per_segment)
    fan = max(1, per_segment // max(1, row_threshold))
    fine = S.hashed_segment([F.col(f"`{k}`") for k in keys], fan, seed=1)
    sides = [with_hashes(x, keys, values).withColumn("seg", segment).withColumn("sub", fine) for x in (source, target)]
    sums = [S.segment_statistics(x, ["seg"]) for x in sides]
    steps = [(f"bounds of the {name}", segment_bounds(x, keys)) for name, x in zip(SIDES, (source, target), strict=True)]
    steps += [(f"segment statistics of the {name}", x) for name, x in zip(SIDES, sums, strict=True)]
    bad = S.mismatched(*sums, ["seg"])
    found = [r["seg"] for r in bad.limit(SENT_SEGMENTS + 1).collect()]
    if not found:
        empty = differences(source.limit(0), target.limit(0), keys, pairs)
        return Segmented(empty, n, 0, reads + 1, steps)
    if len(found) <= SENT_SEGMENTS:
        bad = source.sparkSession.createDataFrame([(x,) for x in found], "seg int")
    sides = [only(x, bad, ["seg"], len(found)) for x in sides]
    if fan > 1:
        sums = [S.segment_statistics(x, ["seg", "sub"]) for x in sides]
        steps += [(f"finer statistics of the {name}", x) for name, x in zip(SIDES, sums, strict=True)]
        worse = S.mismatched(*sums, ["seg", "sub"])
        sides = [only(x, worse, ["seg", "sub"], len(found) * fan) for x in sides]
    return Segmented(differences(sides[0].drop("h", "h2", "seg", "sub"), sides[1].drop("h", "h2", "seg", "sub"), keys, pairs), n, len(found), reads + 2 + (fan > 1), steps)
