"""Golden canonical texts, each a row of a table."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.functions import canonical, framed, joined, row_hash, signed_hash
from tallymark.model import Options, Rule

NTZ, TS = T.TimestampNTZType(), T.TimestampType()
UTC = dt.timezone.utc


def render(spark, value, kind, rule, options=Options(), **how):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", kind)]))
    return df.select(canonical(F.col("x"), rule, kind, options, **how)).first()[0]


CASES = [
    (7, T.LongType(), Rule.INT, {}, "7"),
    (-7, T.IntegerType(), Rule.INT, {}, "-7"),
    (Decimal("18446744073709551615"), T.DecimalType(20, 0), Rule.INT, {}, "18446744073709551615"),
    (Decimal("0.125"), T.DecimalType(10, 3), Rule.DEC, {"scale": 2}, "0.12"),
    (Decimal("0.375"), T.DecimalType(10, 3), Rule.DEC, {"scale": 2}, "0.38"),
    (Decimal("-0.125"), T.DecimalType(10, 3), Rule.DEC, {"scale": 2}, "-0.12"),
    (Decimal("-0.00"), T.DecimalType(10, 2), Rule.DEC, {"scale": 2}, "0.00"),
    (Decimal("1234567890123456789012345678.5"), T.DecimalType(38, 4), Rule.DEC, {"scale": 1}, "1234567890123456789012345678.5"),
    (Decimal("0"), T.DecimalType(20, 10), Rule.DEC, {"scale": 10}, "0.0000000000"),
    (1.5, T.DoubleType(), Rule.FLT, {}, "1.50000000000000e+00"),
    (-0.0, T.DoubleType(), Rule.FLT, {}, "0.00000000000000e+00"),
    (0.0, T.DoubleType(), Rule.FLT, {}, "0.00000000000000e+00"),
    (float("nan"), T.DoubleType(), Rule.FLT, {}, "NaN"),
    (float("inf"), T.DoubleType(), Rule.FLT, {}, "Infinity"),
    (float("-inf"), T.DoubleType(), Rule.FLT, {}, "-Infinity"),
    (1.23456789, T.DoubleType(), Rule.FLT, {"options": Options(float_precision=5)}, "1.2346e+00"),
    (1.23456789, T.DoubleType(), Rule.FLT, {"options": Options(float_precision=5, exact_floats=True)}, "1.2346e+00"),
    ("abc ", T.StringType(), Rule.STR, {}, "abc "),
    ("abc ", T.StringType(), Rule.STR_FOLDED, {"options": Options(trim=True)}, "abc"),
    ("Straße", T.StringType(), Rule.STR_FOLDED, {"options": Options(case_insensitive=True)}, "straße"),
    ("😀 שלום" + "x" * 10_000, T.StringType(), Rule.STR, {}, "😀 שלום" + "x" * 10_000),
    (True, T.BooleanType(), Rule.BOOL, {}, "true"),
    (False, T.BooleanType(), Rule.BOOL, {}, "false"),
    (dt.datetime(2024, 3, 1, 4, 30, tzinfo=UTC), TS, Rule.TS, {}, "2024-03-01T04:30:00.000000Z"),
    (dt.datetime(2024, 3, 1, 10, 0, 0, 123456), NTZ, Rule.TS_NAIVE, {}, "2024-03-01T10:00:00.123456Z"),
    (dt.datetime(2024, 3, 1, 10), NTZ, Rule.TS_NAIVE, {"options": Options(assume_tz="Asia/Kolkata")}, "2024-03-01T04:30:00.000000Z"),
    (dt.datetime(1, 1, 1), NTZ, Rule.TS_NAIVE, {}, "0001-01-01T00:00:00.000000Z"),
    (dt.datetime(9999, 12, 31, 23, 59, 59), NTZ, Rule.TS_NAIVE, {}, "9999-12-31T23:59:59.000000Z"),
    (dt.datetime(2024, 3, 1, 23, 59, 59, 999999), NTZ, Rule.TS_ROUNDED, {"precision": 0}, "2024-03-02T00:00:00Z"),
    (dt.datetime(1969, 12, 31, 23, 59, 59, 999400), NTZ, Rule.TS_ROUNDED, {"precision": 3}, "1969-12-31T23:59:59.999Z"),
    (dt.date(2024, 3, 1), T.DateType(), Rule.DATE, {}, "2024-03-01"),
    (49_507_500_000, T.LongType(), Rule.TIME, {}, "13:45:07.500000"),
    (49_507_999_500, T.LongType(), Rule.TS_ROUNDED, {"precision": 3}, "13:45:08.000"),
    (86_399_999_999, T.LongType(), Rule.TS_ROUNDED, {"precision": 0}, "00:00:00"),
    ("A0EEBC999C0B4EF8BB6D6BB9BD380A11", T.StringType(), Rule.UUID, {}, "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"),
    (b"\xde\xad\xbe\xef", T.BinaryType(), Rule.BIN, {}, "deadbeef"),
    ('{"b" : 1,  "a":[1,2]}', T.StringType(), Rule.JSON, {}, '{"a":[1,2],"b":1}'),
    ("no json", T.StringType(), Rule.JSON, {}, "no json"),
    ([1, 2, 3], T.ArrayType(T.IntegerType()), Rule.ARR, {}, "[1,2,3]"),
    ([], T.ArrayType(T.IntegerType()), Rule.ARR, {}, "[]"),
    (["a", None, "c"], T.ArrayType(T.StringType()), Rule.ARR, {}, "[a,\\N,c]"),
    ([Decimal("1.50"), Decimal("-0.00")], T.ArrayType(T.DecimalType(5, 2)), Rule.ARR, {}, "[1.50,0.00]"),
    ("open", T.StringType(), Rule.ENUM, {}, "open"),
    ({"b": 2, "a": 1}, T.MapType(T.StringType(), T.IntegerType()), Rule.UNKNOWN, {}, '{"a":1,"b":2}'),
    (None, T.IntegerType(), Rule.INT, {}, "\\N"),
    (None, T.ArrayType(T.IntegerType()), Rule.ARR, {}, "\\N"),
    (None, T.DoubleType(), Rule.FLT, {}, "\\N"),
    (None, T.LongType(), Rule.TIME, {}, "\\N"),
    ("", T.StringType(), Rule.STR, {}, ""),
    ("NULL", T.StringType(), Rule.STR, {}, "NULL"),
]


@pytest.mark.parametrize("value, kind, rule, how, expected", CASES, ids=lambda x: str(x)[:24])
def test_canonical_text(spark, value, kind, rule, how, expected):
    assert render(spark, value, kind, rule, **how) == expected


def test_exact_floats_round_the_binary_value(spark):
    import random

    rng = random.Random(1)
    values = [rng.uniform(-1e6, 1e6) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(canonical(F.col("x"), Rule.FLT, T.DoubleType(), Options(exact_floats=True))).collect()]
    assert got == ["%.14e" % v for v in values]


def test_time_type_where_spark_has_it(spark):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        df = spark.sql("select time'13:45:07.5' as x")
    except Exception:
        pytest.skip("no TIME type here")
    finally:
        spark.conf.unset("spark.sql.timeType.enabled")
    spark.conf.set("spark.sql.timeType.enabled", "true")
    assert df.select(canonical(F.col("x"), Rule.TIME, df.schema["x"].dataType)).first()[0] == "13:45:07.500000"
    spark.conf.unset("spark.sql.timeType.enabled")


@pytest.mark.parametrize("text, expected", [("hello", 6719722671305337462), ("row-2", -1091569353222381949)])
def test_row_hash_equals_the_published_one(spark, text, expected):
    assert spark.range(1).select(row_hash([F.lit(text)])).first()[0] == expected


def test_hash_of_many_texts_equals_python(spark):
    import hashlib

    texts = ["hello", "", "row-2", "2024-03-01T04:30:00.000000Z", "\\N", "12.50", "a" * 200, "unicode: café ☃"]
    got = {r["t"]: r["h"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", signed_hash(F.col("t")).alias("h")).collect()}
    assert got == {t: int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big", signed=True) for t in texts}


def test_framed_text_keeps_apart_what_joined_text_does_not(spark):
    rows = spark.createDataFrame([("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\\N", "x"), ("-", "x")], "a string, b string")
    cols = [F.col("a"), F.col("b")]
    assert rows.select(framed(cols)).distinct().count() == 5
    assert rows.select(joined([F.coalesce(c, F.lit("\\N")) for c in cols])).distinct().count() == 3


# -- texts of different values differ, in any session's zone --------------------------------------

STRUCT = T.StructType([T.StructField("m", T.MapType(T.StringType(), T.DoubleType())), T.StructField("t", TS)])
#: Pairs of values that careless text would render alike.
DIFFERENT = [
    (["a,b"], ["a", "b"], T.ArrayType(T.StringType())), (["\\N"], [None], T.ArrayType(T.StringType())), ([""], [], T.ArrayType(T.StringType())), (["\\e"], [""], T.ArrayType(T.StringType())), ([None], [], T.ArrayType(T.StringType())), (["a\\", "b"], ["a\\,b"], T.ArrayType(T.StringType())),
    ([["a],[b"]], [["a"], ["b"]], T.ArrayType(T.ArrayType(T.StringType()))), ([[], []], [[""], []], T.ArrayType(T.ArrayType(T.StringType()))), ([None], [["\\N"]], T.ArrayType(T.ArrayType(T.StringType()))),
    (dt.datetime(2024, 11, 3, 5, 30, tzinfo=UTC), dt.datetime(2024, 11, 3, 6, 30, tzinfo=UTC), TS),
    (dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 3, 10, 3, 30), NTZ),
    ({"m": {"a": 1.0}, "t": None}, {"m": {"a": None}, "t": None}, STRUCT), ({"m": None, "t": dt.datetime(2024, 11, 3, 5, 30, 0, 1, tzinfo=UTC)}, {"m": None, "t": dt.datetime(2024, 11, 3, 5, 30, 0, 2, tzinfo=UTC)}, STRUCT),
]


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zoned(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("algorithm", ["joindiff", "hashdiff"])
def test_different_values_are_told_apart_in_any_zone(zoned, algorithm):
    from tallymark.model import Algorithm
    from tallymark.plans.compare import Request, compare
    from tallymark.sources import Table

    names = [f"c{i}" for i in range(len(DIFFERENT))]
    schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(n, k) for n, (_, _, k) in zip(names, DIFFERENT, strict=True)]])
    sides = [Table(zoned.createDataFrame([(1, *[d[i] for d in DIFFERENT])], schema), x, x) for i, x in enumerate("ab")]
    found = compare(*sides, Request(key=["id"], algorithm=Algorithm(algorithm)))
    assert found.changed == 1 and sorted(found.row_diffs[0].changes) == sorted(names)
    assert compare(sides[0], sides[0], Request(key=["id"], algorithm=Algorithm(algorithm))).is_match


def test_texts_of_timestamps_in_any_zone(zoned):
    df = zoned.sql("select timestamp_micros(1730611800000001) a, timestamp_ntz'2024-03-10 02:30:00.5' b, timestamp_micros(-1) c, timestamp_ntz'0001-01-01 00:00:00' d, date'2024-03-10' e")
    show = lambda c, rule, kind, **how: canonical(F.col(c), rule, kind, **how)
    row = df.select(show("a", Rule.TS, TS), show("b", Rule.TS_NAIVE, NTZ), show("c", Rule.TS_ROUNDED, TS, precision=3), show("d", Rule.TS_NAIVE, NTZ), show("b", Rule.TS_ROUNDED, NTZ, precision=0), show("e", Rule.DATE, T.DateType())).first()
    assert tuple(row) == ("2024-11-03T05:30:00.000001Z", "2024-03-10T02:30:00.500000Z", "1970-01-01T00:00:00.000Z", "0001-01-01T00:00:00.000000Z", "2024-03-10T02:30:01Z", "2024-03-10")


def test_maps_at_any_depth_have_no_order(spark):
    df = spark.sql("select struct(map('a', array(map('x', 1, 'y', 2)), 'b', null) as m) s union all select struct(map('b', null, 'a', array(map('y', 2, 'x', 1))) as m)")
    texts = {r[0] for r in df.select(canonical(F.col("s"), Rule.UNKNOWN, df.schema["s"].dataType)).collect()}
    assert texts == {'{"m":{"a":[{"x":1,"y":2}],"b":null}}'}
