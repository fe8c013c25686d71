"""Whole comparisons: planted differences come back, by either algorithm."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymark import errors as E
from tallymark.model import Algorithm, Options, Rule
from tallymark.operators import basics, segments
from tallymark.operators.matching import match_columns
from tallymark.plans.compare import Request, compare, explain
from tallymark.sources import Table

BOTH = [Algorithm.JOINDIFF, Algorithm.HASHDIFF]


def make(spark, rows, schema, name="t", **more):
    return Table(spark.createDataFrame(rows, schema), name, f"test:{name}", **more)


def ids(result, kind):
    return sorted(d.key[0] for d in result.row_diffs if d.kind == kind)


@pytest.mark.parametrize("algorithm", BOTH)
def test_edits_come_back_exactly(spark, algorithm):
    base = [(i, f"row-{i}") for i in range(1, 1001)]
    edited = [(i, n + "!" if 11 <= i <= 20 else n) for i, n in base if i > 10] + [(i, "new") for i in range(1001, 1011)]
    r = compare(make(spark, base, "id long, name string"), make(spark, edited, "id long, name string"), Request(key=["id"], algorithm=algorithm, rows_per_segment=100))
    assert (r.source_count, r.target_count, r.missing, r.extra, r.changed) == (1000, 1000, 10, 10, 10)
    assert ids(r, "missing") == [*range(1, 11)] and ids(r, "extra") == [*range(1001, 1011)] and ids(r, "changed") == [*range(11, 21)]
    assert next(d for d in r.row_diffs if d.key == (11,)).changes == {"name": ("row-11", "row-11!", Rule.STR)}
    assert not r.is_match and r.exit_code() == 1 and r.exit_code("count") == 0 and r.exit_code("none") == 0


@pytest.mark.parametrize("algorithm", BOTH)
@pytest.mark.parametrize("a, b", [(0, 25), (25, 0), (0, 0)])
def test_empty_sides(spark, algorithm, a, b):
    rows = [(i, "x") for i in range(25)]
    r = compare(make(spark, rows[:a], "id long, name string"), make(spark, rows[:b], "id long, name string"), Request(key=["id"], algorithm=algorithm))
    assert (r.missing, r.extra, r.changed) == (a, b, 0) and r.is_match == (a == b)


@pytest.mark.parametrize("algorithm", BOTH)
def test_composite_and_text_keys(spark, algorithm):
    rows = [(t, f"k{o:03}", "open") for t in range(5) for o in range(50)]
    other = [(t, o, "shut" if (t, o) == (3, "k025") else s) for t, o, s in rows]
    r = compare(make(spark, rows, "tenant long, o string, status string"), make(spark, other, "tenant long, o string, status string"), Request(key=["tenant", "o"], algorithm=algorithm, rows_per_segment=20))
    assert [d.key for d in r.row_diffs] == [(3, "k025")] and r.changed == 1


@pytest.mark.parametrize("algorithm", BOTH)
def test_null_keys_and_markers_are_told_apart(spark, algorithm):
    a = make(spark, [(None, "x"), (1, None), (2, "\\N"), (3, "a\x1fb")], "id long, name string")
    b = make(spark, [(None, "x"), (1, "\\N"), (2, "\\N"), (3, "a\x1fb")], "id long, name string")
    r = compare(a, b, Request(key=["id"], algorithm=algorithm))
    assert (r.missing, r.extra, r.changed) == (0, 0, 1) and r.row_diffs[0].key == (1,)


def test_list_is_capped_but_counts_are_not(spark):
    a, b = make(spark, [(i, "a") for i in range(100)], "id long, n string"), make(spark, [(i, "b") for i in range(100)], "id long, n string")
    r = compare(a, b, Request(key=["id"], max_diff_rows=7))
    assert r.changed == 100 and r.truncated and [d.key[0] for d in r.row_diffs] == [*range(7)]


def test_filters_scope_uniqueness_and_each_side(spark):
    t = make(spark, [(1, "active", "x"), (1, "archived", "y"), (2, "active", "z")], "id long, status string, name string")
    with pytest.raises(E.KeyNotUnique) as e:
        compare(t, t, Request(key=["id"]))
    assert e.value.example == (1,)
    assert compare(t, t, Request(key=["id"], where="status = 'active'")).is_match
    r = compare(t, t, Request(key=["id"], where="status = 'active'", where_target="id = 2"))
    assert r.missing == 1


def test_no_key_and_unknown_names_are_errors(spark):
    t = make(spark, [(1, "x")], "id long, name string")
    for request, error in ((Request(), E.MissingKey), (Request(key=["nope"]), E.UnknownColumn), (Request(key=["id"], columns=["nmae"]), E.UnknownColumn), (Request(key=["id"], exclude=["nope"]), E.UnknownColumn), (Request(key=["id"], column_map={"name": "nope"}), E.UnknownColumn)):
        with pytest.raises(error):
            compare(t, t, request)
    assert compare(Table(t.df, "t", "test:t", key=["id"]), t, Request()).is_match


def test_sample_is_the_same_on_both_sides_and_never_empty(spark):
    rows = [(i, "x") for i in range(5000)]
    a, b = make(spark, rows, "id long, n string"), make(spark, [(i, "y" if i % 2 else n) for i, n in rows], "id long, n string")
    first, again = (compare(a, b, Request(key=["id"], sample=5.0, algorithm=Algorithm.HASHDIFF)) for _ in range(2))
    assert 100 < first.source_count == first.target_count < 500 and first.changed == again.changed > 0 and first.sample_pct == 5.0
    assert compare(a, b, Request(key=["id"], sample_rows=500)).source_count < 1000
    with pytest.raises(E.EmptySample):
        compare(a, b, Request(key=["id"], sample=0.00001))


def test_rules_of_pairs(spark):
    from pyspark.sql import types as T

    def pair(a, b, options=Options(), meta=({}, {})):
        s = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", a, metadata=meta[0])])
        t = T.StructType([T.StructField("ID", T.LongType()), T.StructField("X", b, metadata=meta[1])])
        _, values, left, notes = match_columns(s, t, ["id"], options)
        return (values[0].rule, values[0].scale, values[0].precision, len(notes)) if values else (None, left, len(notes))

    dec = T.DecimalType
    assert pair(dec(10, 2), dec(12, 4)) == (Rule.DEC, 2, 6, 1)
    assert pair(T.LongType(), dec(12, 4)) == (Rule.DEC, 4, 6, 1)
    assert pair(T.LongType(), T.DoubleType())[0] is Rule.FLT and pair(dec(10, 2), T.FloatType())[0] is Rule.FLT
    assert pair(T.LongType(), dec(20, 0))[0] is Rule.INT
    assert pair(T.IntegerType(), T.BooleanType()) == (None, ["x"], 1)
    assert pair(T.StringType(), T.StringType(), Options(trim=True))[0] is Rule.STR_FOLDED
    assert pair(T.StringType(), T.StringType(), Options(trim=True), ({"logicalType": "uuid"}, {}))[0] is Rule.UUID
    assert pair(T.TimestampType(), T.TimestampType(), meta=({"precision": 6}, {"precision": 0})) == (Rule.TS_ROUNDED, 0, 0, 1)
    assert pair(T.StructType([]), T.StringType())[0] is Rule.UNKNOWN


def test_whole_number_against_decimal_keeps_the_fraction(spark):
    a, b = make(spark, [(1, 12)], "id long, x long"), make(spark, [(1, __import__("decimal").Decimal("12.4"))], "id long, x decimal(10,1)")
    assert compare(a, b, Request(key=["id"])).changed == 1


def test_columns_of_one_side_are_reported_for_both(spark):
    a, b = make(spark, [(1, True)], "id long, only_a boolean"), make(spark, [(1, 2)], "id long, only_b int")
    r = compare(a, b, Request(key=["id"]))
    assert r.is_match and sorted(r.excluded_columns) == ["only_a", "only_b"] and len(r.notices) == 2


def test_renamed_key_and_key_of_another_type(spark):
    a, b = make(spark, [(1, "x"), (2, "y")], "id long, name string"), make(spark, [(1, "x"), (2, "z")], "ref int, full_name string")
    r = compare(a, b, Request(key=["id"], column_map={"id": "ref", "name": "full_name"}))
    assert (r.missing, r.extra, r.changed) == (0, 0, 1)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_random_mutations_come_back_by_both_algorithms(spark, seed):
    rng = random.Random(seed)
    base = {rng.randrange(-500, 500): rng.choice(["a", None, "", "\\N", "x y"]) for _ in range(300)}
    other = dict(base)
    for k in rng.sample(sorted(base), 20):
        other.pop(k) if rng.random() < 0.5 else other.update({k: rng.choice(["b", None])})
    for k in rng.sample(range(600, 900), 5):
        other[k] = "new"
    expected = {(k, "missing") for k in base.keys() - other.keys()} | {(k, "extra") for k in other.keys() - base.keys()} | {(k, "changed") for k in base.keys() & other.keys() if base[k] != other[k]}
    a, b = make(spark, list(base.items()), "id long, v string"), make(spark, list(other.items()), "id long, v string")
    for algorithm in BOTH:
        r = compare(a, b, Request(key=["id"], algorithm=algorithm, rows_per_segment=40, row_threshold=10))
        assert {(d.key[0], d.kind) for d in r.row_diffs} == expected
    lost = {x.id for x in a.df.exceptAll(b.df).collect()}
    assert lost == {k for k, kind in expected if kind != "extra"}


def test_segment_sums_do_not_depend_on_the_partitioning(spark):
    df = spark.range(5000).select("id", F.xxhash64("id").alias("h"), F.xxhash64("id", F.lit(1)).alias("h2"), (F.col("id") % 7).cast("int").alias("seg"))
    sums = [sorted(map(tuple, segments.segment_statistics(x, ["seg"]).collect())) for x in (df.repartition(1), df.repartition(13), df.orderBy(F.desc("id")))]
    assert sums[0] == sums[1] == sums[2] and sum(r[1] for r in sums[0]) == 5000


@pytest.mark.parametrize("lo, hi, n", [(0, 999, 8), (-5, 5, 3), (7, 7, 8), (-(1 << 62), 1 << 62, 1000)])
def test_ranges_tile_and_agree_with_the_expression(spark, lo, hi, n):
    parts = segments.numeric_bounds(lo, hi, n)
    assert parts[0][0] == lo and parts[-1][1] is None and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    keys = sorted({lo, hi, (lo + hi) // 2, *(p[0] for p in parts[:50]), *(max(lo, p[0] - 1) for p in parts[:50])})
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", segments.numeric_segment(F.col("k"), lo, hi, n).alias("s")).collect()
    for r in got:
        a, b = parts[r["s"]]
        assert a <= r["k"] and (b is None or r["k"] < b)


def test_quantile_parts_are_even(spark):
    df = spark.createDataFrame([(f"{i:05}",) for i in range(4000)] + [(None,)], "k string")
    cuts = segments.quantile_cuts(df, "k", 8, 4001)
    sizes = [r["count"] for r in df.groupBy(segments.cut_segment(F.col("k"), cuts)).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * sum(sizes) / 8


def test_quantile_cuts_are_exact_at_any_size(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("k0500")).when(F.col("id") % 11 > 0, F.format_string("k%04d", F.pmod(F.xxhash64("id"), F.lit(900)))).alias("k"))
    values = sorted(r.k for r in df.where("k is not null").collect())
    for n in (1, 8, 13):
        want = sorted({values[i * len(values) // n] for i in range(1, n)} - {values[0]})
        assert segments.quantile_cuts(df, "k", n, 30_000) == want
    assert segments.quantile_cuts(df.where("k is null"), "k", 8, 30_000) == [] == segments.quantile_cuts(df.limit(0), "k", 8, 0)


def test_segment_counts():
    assert [segments.segment_count(n) for n in (0, 1, 800_000, 1_000_001)] == [1, 8, 8, 11]


def test_equal_segments_move_no_rows(spark):
    a = make(spark, [(i, "x") for i in range(1000)], "id long, n string")
    r = compare(a, a, Request(key=["id"], algorithm=Algorithm.HASHDIFF))
    assert r.is_match and r.segments_examined == 8


def test_explain_runs_nothing_and_prunes_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a", 2.0)], "id long, n string, x double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    t = Table(df, "t", "parquet:t")
    text = explain(t, t, Request(key=["id"], columns=["n"], where="id > 0"))
    assert "FullOuter" in text and "PushedFilters: [IsNotNull(id), GreaterThan(id,0)]" in text and "ReadSchema: struct<id:bigint,n:string>" in text
    assert "bit_xor" in explain(t, t, Request(key=["id"], algorithm=Algorithm.HASHDIFF))


def test_text_keys_are_cut_by_quantiles(spark, monkeypatch):
    from tallymark.operators import hashdiff as H

    monkeypatch.setattr(H, "LEAST_ROWS", 100)
    a = spark.range(3000).selectExpr("concat('k', id % 7, '-', id) as k", "id as v")
    b = a.where("v <> 5").unionByName(spark.sql("select 'new' k, 1L v")).withColumn("v", F.when(F.col("v") == 77, 0).otherwise(F.col("v")))
    segment, n, reads = H.choose_segment(a, b, ["k"], 100)
    assert (n, reads) == (30, 2)
    sizes = [r["count"] for r in a.groupBy(segment).count().collect()]
    assert len(sizes) == 30 and set(sizes) == {100}
    found = compare(Table(a, "a", "a"), Table(b, "b", "b"), Request(key=["k"], algorithm=Algorithm.HASHDIFF, rows_per_segment=100, row_threshold=10))
    assert (found.missing, found.extra, found.changed, found.segments_examined) == (1, 1, 1, 30)


def test_keys_are_drawn_once_and_alike(spark):
    df = spark.range(400).select(F.when(F.col("id") % 10 > 0, F.format_string("k%03d", F.col("id") % 200)).alias("k"))
    drawn, again, other = ([r.k for r in basics.sample_keys(df.repartition(parts), "k", 50, seed).collect()] for parts, seed in ((1, 0), (7, 0), (7, 1)))
    assert drawn == again == sorted(set(drawn)) and len(drawn) == 50 and drawn != other
    assert len(basics.sample_keys(df, "k", 1000).collect()) == 180 and basics.sample_keys(df.limit(0), "k", 5).isEmpty()


def test_every_step_is_in_the_log(spark):
    a = spark.range(2000).selectExpr("id", "id % 5 as v")
    b = a.withColumn("v", F.when(F.col("id") == 7, 9).otherwise(F.col("v")))
    titles = lambda result: [s.splitlines()[0].removeprefix("-- ") for s in result.statements]
    hashed, joined = (compare(Table(a, "a", "a"), Table(b, "b", "b"), Request(key=["id"], algorithm=x)) for x in (Algorithm.HASHDIFF, Algorithm.JOINDIFF))
    each = lambda what: [f"{what} the source", f"{what} the target"]
    assert titles(joined) == [*each("key unique in"), "row differences"]
    assert titles(hashed) == [*each("key unique in"), *each("bounds of"), *each("segment statistics of"), *each("finer statistics of"), "row differences"]
    assert hashed.changed == joined.changed == 1 and all("Aggregate" in s for s in hashed.statements[:-1])
