"""Hashes of canonical text: of a row, and of a set of rows in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts the fields where the text has to equal other engines'.
SEPARATOR = "\x1f"
MODULUS = 1 << 64


def joined(texts: list[Column]) -> Column:
    """The fields (without NULLs) parted by the separator; equal for every engine, but a field may itself hold a separator."""
    return F.concat_ws(SEPARATOR, *texts)


def framed(texts: list[Column]) -> Column:
    """The fields each behind its length, NULL as ``-``: no two different rows have the same text."""
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def signed_hash(text: Column) -> Column:
    """The first eight bytes of MD5, big-endian, as a signed 64-bit number."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def row_hash(texts: list[Column]) -> Column:
    return signed_hash(joined(texts))


def aggregate_hash(hashes: Column) -> Column:
    """The sum modulo 2 ** 64, of any order and partitioning; summed as decimals, so it can't overflow."""
    return F.pmod(F.sum(hashes.cast("decimal(20,0)")), F.expr(f"cast({MODULUS} as decimal(20,0))")).cast("decimal(20,0)")
