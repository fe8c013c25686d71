"""Canonical text of values, one Column expression for each rule.

All of it stays within built-in functions, so it is compiled into the scan's stage; only
``exact_floats`` leaves the JVM, by Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.model import Options, Rule

#: How NULL is written where a text without NULLs is needed.
MARKER = "\\N"


def integer(x: Column) -> Column:
    return x.cast("string")


def decimal(x: Column, scale: int) -> Column:
    """``scale`` places, half to even; no exponent at any size and no negative zero."""
    return F.bround(x, scale).cast(T.DecimalType(38, scale)).cast("string")


def floating(x: Column, digits: int, exact: bool = False) -> Column:
    """Scientific notation with so many significant digits; NaN, Infinity, -Infinity; zero without a sign."""
    zero = "0" + ("." + "0" * (digits - 1) if digits > 1 else "") + "e+00"
    x = x.cast("double")
    text = exact_scientific(digits)(x) if exact else F.format_string(f"%.{digits - 1}e", x)
    return F.when(x == 0, F.lit(zero)).when(F.isnan(x), F.lit("NaN")).when(F.abs(x) == float("inf"), F.when(x > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity"))).when(x.isNotNull(), text)


def exact_scientific(digits: int):
    """Rounds the binary value as C does; the JVM's formatter rounds the shortest decimal instead, which differs in a few per cent of arbitrary doubles."""

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        form = f"%.{digits - 1}e"
        return values.map(lambda v: None if pd.isna(v) else form % v)

    return text


def text(x: Column) -> Column:
    return x.cast("string")


def folded(x: Column, trim: bool, lower: bool) -> Column:
    x = F.rtrim(x.cast("string")) if trim else x.cast("string")
    return F.lower(x) if lower else x


def _in_utc_session(plain: Column, anywhere: Column) -> Column:
    """``plain`` where the session's zone is UTC, else ``anywhere``, which gives the same in any zone; the optimizer leaves one of them."""
    return F.when(F.current_timezone().isin("UTC", "Etc/UTC", "Z"), plain).otherwise(anywhere)


def _pattern(precision: int) -> str:
    return "yyyy-MM-dd'T'HH:mm:ss" + ("." + "S" * precision if precision else "") + "'Z'"


def _stamp(x: Column, precision: int = 6) -> Column:
    """ISO text with a ``Z`` of a timestamp without zone: ``date_format`` goes through the session's zone, so in others than UTC it is the timestamp's own text."""
    raw = x.cast("string")
    whole = F.replace(F.substring_index(raw, ".", 1), F.lit(" "), F.lit("T"))
    digits = F.when(raw.contains("."), F.substring_index(raw, ".", -1)).otherwise(F.lit(""))
    own = F.concat(whole, F.lit("."), F.substring(F.rpad(digits, 6, "0"), 1, precision), F.lit("Z")) if precision else F.concat(whole, F.lit("Z"))
    return _in_utc_session(F.date_format(x, _pattern(precision)), own)


def in_utc(x: Column) -> Column:
    """An instant as a timestamp without zone that shows UTC, whatever the session's zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(x), F.expr("timestamp_ntz'1970-01-01 00:00:00'"))


def _local(x: Column, zone: str) -> Column:
    x = x.cast("timestamp_ntz")
    return x if zone.upper() == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), x)


def instant(x: Column) -> Column:
    return _in_utc_session(F.date_format(x, _pattern(6)), _stamp(in_utc(x)))


def naive(x: Column, zone: str = "UTC") -> Column:
    """A timestamp without zone, as it stands, or taken as local time of ``zone``."""
    return _stamp(_local(x, zone))


def _rounded(micros: Column, precision: int) -> Column:
    """Half up to ``precision`` digits of a second, in whole numbers; also right before 1970."""
    unit = 10 ** (6 - precision)
    up = micros + F.lit(unit // 2)
    return up - F.pmod(up, F.lit(unit))


def rounded_instant(x: Column, precision: int, zone: str = "UTC", has_zone: bool = True) -> Column:
    """Half up to ``precision`` digits of a second: half a unit more, and the digits beyond are cut."""
    plain = in_utc(x) if has_zone else _local(x, zone)
    return _stamp(F.timestamp_add("MICROSECOND", F.lit(10 ** (6 - precision) // 2).cast("long"), plain), precision)


def date(x: Column) -> Column:
    return x.cast("date").cast("string")


DAY = 86_400_000_000


def micros_of_day(x: Column, kind: T.DataType) -> Column:
    """Microseconds since midnight of a TIME column, of a timestamp that JDBC made of one, or of a number that already is that."""
    if isinstance(kind, T.IntegralType):
        return x.cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        local = x.cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", F.date_trunc("DAY", local).cast("timestamp_ntz"), local)
    return F.call_function("time_diff", F.lit("MICROSECOND"), F.expr("time'00:00:00'"), x)


def clock(micros: Column, precision: int = 6) -> Column:
    if precision < 6:
        micros = F.pmod(_rounded(micros, precision), F.lit(DAY))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    whole = F.concat_ws(":", *[two(F.floor(micros / F.lit(u)) % F.lit(m)) for u, m in ((3_600_000_000, 24), (60_000_000, 60), (1_000_000, 60))])
    out = whole if not precision else F.concat(whole, F.lit("."), F.substring(F.lpad((micros % F.lit(1_000_000)).cast("string"), 6, "0"), 1, precision))
    return F.when(micros.isNotNull(), out)


def uuid(x: Column) -> Column:
    bare = F.replace(x.cast("string"), F.lit("-"), F.lit(""))
    return F.lower(F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def binary(x: Column) -> Column:
    return F.lower(F.hex(x))


def json(x: Column, kind: T.DataType) -> Column:
    """Keys sorted, spaces gone, of equal keys the last one; text that isn't JSON stays as it is."""
    if type(kind).__name__ == "VariantType":
        return F.to_json(x)
    raw = x.cast("string")
    return F.coalesce(F.to_json(F.try_parse_json(raw)), raw)


def array(x: Column, kind: T.ArrayType, options: Options) -> Column:
    """``[a,b]``, the elements by their own rules, NULL elements as the marker; arrays in it likewise.

    Brackets, commas and backslashes of an element's text get a backslash before them, and an empty text is
    ``\\e``, so no two different arrays have one text; numbers, dates and plain words look as they do alone.
    """
    from tallymark.operators.matching import rule_of_type

    rule, element = rule_of_type(kind.elementType), kind.elementType
    scale = element.scale if isinstance(element, T.DecimalType) else 0

    def each(e: Column) -> Column:
        text = by_rule(e, rule, element, options, scale=scale)
        if not isinstance(element, T.ArrayType):
            text = F.when(text == "", F.lit("\\e")).otherwise(F.regexp_replace(text, r"([\[\],\\])", r"\\$1"))
        return F.coalesce(text, F.lit(MARKER))

    return F.when(x.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(x, each), ","), F.lit("]")))


def _inner(x: Column, kind: T.DataType, options: Options) -> Column:
    """``x`` ready for JSON: maps sorted by key at every depth, floats and timestamps by their rules, what JSON can't hold exactly as text."""
    if isinstance(kind, T.StructType):
        fields = [_inner(x.getField(f.name), f.dataType, options).alias(f.name) for f in kind.fields]
        return F.when(x.isNotNull(), F.struct(*fields)) if fields else x
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _inner(e, kind.elementType, options))
    if isinstance(kind, T.MapType):
        by_key = lambda a, b: F.when(a["key"] < b["key"], F.lit(-1)).when(a["key"] > b["key"], F.lit(1)).otherwise(F.lit(0))
        inner = lambda e: F.struct(e["key"].alias("key"), _inner(e["value"], kind.valueType, options).alias("value"))
        return F.map_from_entries(F.transform(F.array_sort(F.map_entries(x), by_key), inner))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return floating(x, options.float_precision, False)
    if isinstance(kind, T.TimestampType):
        return instant(x)
    if isinstance(kind, T.TimestampNTZType):
        return naive(x, options.assume_tz)
    return x


def other(x: Column, kind: T.DataType, options: Options = Options()) -> Column:
    """Maps and structs as JSON, maps in them at any depth with sorted keys, NULL fields shown; anything else as Spark's own text."""
    if isinstance(kind, (T.MapType, T.StructType)):
        return F.to_json(_inner(x, kind, options), {"ignoreNullFields": "false"})
    return x.cast("string")


def by_rule(x: Column, rule: Rule, kind: T.DataType, options: Options, scale: int = 0, precision: int = 6) -> Column:
    """Canonical text of ``x``; NULL stays NULL."""
    if rule is Rule.INT:
        return integer(x)
    if rule is Rule.DEC:
        return decimal(x, scale)
    if rule is Rule.FLT:
        return floating(x, options.float_precision, options.exact_floats)
    if rule is Rule.STR_FOLDED:
        return folded(x, options.trim, options.case_insensitive)
    if rule is Rule.TS:
        return instant(x)
    if rule is Rule.TS_NAIVE:
        return naive(x, options.assume_tz)
    if rule is Rule.TS_ROUNDED:
        if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return clock(micros_of_day(x, kind), precision)
        return rounded_instant(x, precision, options.assume_tz, isinstance(kind, T.TimestampType))
    if rule is Rule.DATE:
        return date(x)
    if rule is Rule.TIME:
        return clock(micros_of_day(x, kind))
    if rule is Rule.UUID:
        return uuid(x)
    if rule is Rule.BIN:
        return binary(x)
    if rule is Rule.JSON:
        return json(x, kind)
    if rule is Rule.ARR and isinstance(kind, T.ArrayType):
        return array(x, kind, options)
    if rule is Rule.UNKNOWN:
        return other(x, kind, options)
    return text(x)


def nullable_canonical(x: Column, rule: Rule, kind: T.DataType, options: Options = Options(), scale: int = 0, precision: int = 6) -> Column:
    return by_rule(x, rule, kind, options, scale, precision)


def canonical(x: Column, rule: Rule, kind: T.DataType, options: Options = Options(), scale: int = 0, precision: int = 6) -> Column:
    """As ``nullable_canonical``, with NULL as the marker."""
    return F.coalesce(by_rule(x, rule, kind, options, scale, precision), F.lit(MARKER))
