"""From two tables to a verdict."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tallymark.errors import Contradiction, EmptySample, MissingKey
from tallymark.functions.canonical import MARKER
from tallymark.model import Algorithm, DiffResult, Notice, Options, Pair, RowDiff, Rule
from tallymark.operators import basics, joindiff
from tallymark.operators.hashdiff import SIDES, Segmented, choose_segment, hashdiff, segment_bounds, with_hashes
from tallymark.operators.matching import match_columns
from tallymark.operators.segments import ROWS_PER_SEGMENT, segment_statistics
from tallymark.sources.readers import Table


@dataclass(frozen=True)
class Request:
    """What is asked for, beside the two tables."""

    key: list[str] | None = None
    columns: list[str] | None = None
    exclude: list[str] | None = None
    where: str | None = None
    where_source: str | None = None
    where_target: str | None = None
    column_map: dict[str, str] | None = None
    algorithm: Algorithm = Algorithm.AUTO
    row_threshold: int = 1000
    rows_per_segment: int = ROWS_PER_SEGMENT
    max_diff_rows: int = 10_000
    sample: float | None = None
    sample_rows: int | None = None
    options: Options = field(default_factory=Options)


@dataclass
class Prepared:
    """Both sides matched, filtered and sampled; ``source`` and ``target`` are canonical."""

    keys: list[Pair]
    values: list[Pair]
    left_out: list[str]
    notices: list[Notice]
    whole: tuple[DataFrame, DataFrame]  # filtered, but not sampled
    source: DataFrame
    target: DataFrame
    sample: float | None = None
    counts: tuple[int, int] | None = None
    reads: int = 0  # of each side so far

    def key_checks(self) -> list[tuple[str, DataFrame]]:
        """What tells whether the key is unique, by title."""
        names = [p.source for p in self.keys], [p.target for p in self.keys]
        return [(f"key unique in the {side}", basics.key_check(df, keys)) for side, df, keys in zip(SIDES, self.whole, names, strict=True)]

    @property
    def key_names(self) -> list[str]:
        return [p.source for p in self.keys]


def choose(request: Request, source: Table, target: Table) -> Algorithm:
    """Both sides are in one session, so the join is exact and one pass; hashes pay where a side is remote and rows are dear."""
    if request.algorithm is not Algorithm.AUTO:
        return request.algorithm
    remote = any(t.label.partition(":")[0] in ("postgres", "clickhouse", "snowflake") for t in (source, target))
    return Algorithm.HASHDIFF if remote else Algorithm.JOINDIFF


def prepare(source: Table, target: Table, request: Request, check: bool = True) -> Prepared:
    """Match columns, filter each side, make sure that the key is unique (before sampling), and sample both alike."""
    key = request.key or source.key
    if not key:
        raise MissingKey(source.name)
    options = request.options
    keys, values, left_out, notices = match_columns(source.df.schema, target.df.schema, key, options, request.columns, request.exclude, request.column_map, {**target.hints, **source.hints})
    s = basics.filtered(source.df, request.where_source or request.where)
    t = basics.filtered(target.df, request.where_target or request.where)
    whole, counts, reads = (s, t), None, 0
    if check:
        counts, reads = (basics.require_unique(s, source.name, [p.source for p in keys]), basics.require_unique(t, target.name, [p.target for p in keys])), 1
    percent = request.sample
    if request.sample_rows is not None:
        if counts is None:  # only explained: the share is unknown until it runs
            notices = [*notices, Notice(f"the sample of {request.sample_rows} rows is taken when the comparison runs; the plans are those of all rows")]
        percent = basics.percent_for(request.sample_rows, max(counts)) if counts else None
    if percent is not None and percent < 100:
        s, t = basics.sampled(s, keys, "source", options, percent), basics.sampled(t, keys, "target", options, percent)
        if check:
            before, counts, reads = counts, (s.count(), t.count()), reads + 1
            if not any(counts) and any(before):
                raise EmptySample(f"a sample of {percent:g} % holds no row: that proves nothing")
    return Prepared(keys, values, left_out, notices, whole, basics.canonical_side(s, "source", keys, values, options), basics.canonical_side(t, "target", keys, values, options), percent, counts, reads)


def find_differences(ready: Prepared, algorithm: Algorithm, request: Request) -> Segmented:
    """The differences, and what was run on the way to them."""
    if algorithm is Algorithm.JOINDIFF:
        return Segmented(joindiff.differences(ready.source, ready.target, ready.key_names, ready.values), 1, 0, 1)
    return hashdiff(ready.source, ready.target, ready.key_names, ready.values, request.rows_per_segment, request.row_threshold)


def shown(value: str | None) -> str:
    """NULL as it is written in reports."""
    return "NULL" if value is None or value == MARKER else value


def compare(source: Table, target: Table, request: Request = Request()) -> DiffResult:
    """Run the comparison. Counts are exact; the list holds the first ``max_diff_rows`` differences by key.

    The differences (not the rows) are kept while they are counted and listed, on executors' disks if need be.
    """
    began = time.time()
    algorithm = choose(request, source, target)
    ready = prepare(source, target, request)
    found = find_differences(ready, algorithm, request)
    diffs = found.diffs
    result = DiffResult(source.label, target.label, ready.key_names, algorithm, notices=list(ready.notices), excluded_columns=ready.left_out, segments_examined=found.segments, sample_pct=ready.sample)
    kept = diffs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = joindiff.tally(kept).first()
        result.missing, result.extra, result.changed = counts["missing"], counts["extra"], counts["changed"]
        result.source_count, result.target_count = ready.counts
        if found.bad and not (result.missing or result.extra or result.changed):
            raise Contradiction(f"{found.bad} segments disagree but no row does")
        if result.source_count - result.missing != result.target_count - result.extra:
            raise Contradiction("rows missing and extra don't account for the row counts: an input changed meanwhile")
        for row in joindiff.first_differences(kept, ready.key_names, request.max_diff_rows).collect():
            changes = {c["column"]: (c["source"], c["target"], Rule(c["rule"])) for c in row["changes"]}
            result.row_diffs.append(RowDiff(tuple(row[k] for k in ready.key_names), row["kind"], changes))
    finally:
        kept.unpersist()
    result.truncated = result.missing + result.extra + result.changed > len(result.row_diffs)
    if result.source_count != result.target_count:
        result.notices.append(Notice(f"row counts differ: {result.source_count} in the source, {result.target_count} in the target"))
    result.diffs, result.elapsed_seconds = diffs, time.time() - began
    result.statements = [f"-- {title}\n{logical(df)}" for title, df in [*ready.key_checks(), *found.steps, ("row differences", diffs)]]
    result.jobs = ready.reads + found.reads
    return result


def logical(df: DataFrame) -> str:
    """The optimised logical plan, as text: what a report shows to make a result reproducible."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def explain(source: Table, target: Table, request: Request = Request()) -> str:
    """The plans that ``compare`` would run. Rows are read only where a plan depends on them: the bounds of the segments, if it would go by hashes."""
    ready = prepare(source, target, request, check=False)
    plain = lambda df: df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    parts = ready.key_checks()
    notes = [f"-- note: {n.message}" for n in ready.notices]
    if choose(request, source, target) is Algorithm.HASHDIFF:
        names = [p.source for p in ready.values]
        segment, n, _ = choose_segment(ready.source, ready.target, ready.key_names, request.rows_per_segment)
        notes.append(f"-- note: {n} segments; rows of those that disagree are hashed again in finer ones, and compared one by one where these disagree too")
        for side, df in zip(SIDES, (ready.source, ready.target), strict=True):
            parts += [(f"bounds of the {side}", segment_bounds(df, ready.key_names)), (f"segment statistics of the {side}", segment_statistics(with_hashes(df, ready.key_names, names).withColumn("seg", segment), ["seg"]))]
    parts.append(("row differences", joindiff.differences(ready.source, ready.target, ready.key_names, ready.values)))
    return "\n".join([*notes, *(f"-- {title}\n{plain(df)}" for title, df in parts)])
