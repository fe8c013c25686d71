"""Places of regular-expression matches, by DataFrame functions only.

A text with its matches marked is split at the marks into the pieces between matches and the matches,
by turns, so the running sum of their lengths gives every match's place in code points. The sum is a
doubling scan over the array, as deep as the array is long: a text with very many matches costs n log n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scan covers 2 ** DOUBLINGS matches in one text, more than a string of 2 GB can hold of six characters each.
DOUBLINGS = 29
#: A character for private use; texts that have it themselves are split another way.
MARK = "\ue0f7"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(numbers: Column, doubling: int = 0) -> Column:
    step = 1 << doubling
    if doubling == DOUBLINGS:
        return numbers
    deeper = lambda a: let(F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - F.lit(step)), F.lit(0))), lambda b: running_sum(b, doubling + 1))
    return F.when(F.size(numbers) <= step, numbers).otherwise(deeper(numbers))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, match, before, after>> of the leftmost non-overlapping matches; ``before`` is the text since the last one, ``after`` that up to the next.

    Null and empty texts, and texts without a match, give an empty array.
    """
    kind = "array<struct<start: int, stop: int, match: string, before: string, after: string>>"
    by_turns = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    # two more passes, for the few texts with the mark in them
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    woven = F.when(F.size(found) > 0, F.flatten(F.transform(gaps, lambda g, i: F.filter(F.array(g, F.get(found, i)), lambda x: x.isNotNull())))).otherwise(F.array(text))

    def place(parts: Column) -> Column:
        number = F.floor((F.size(parts) - 1) / 2).cast("int")
        each = F.sequence(F.lit(0), number - 1)
        sizes = F.transform(each, lambda i: F.length(F.get(parts, 2 * i)) + F.length(F.get(parts, 2 * i + 1)))
        struct = lambda ends, i: F.struct((F.get(ends, i) - F.length(F.get(parts, 2 * i + 1))).alias("start"), F.get(ends, i).alias("stop"), F.get(parts, 2 * i + 1).alias("match"), F.get(parts, 2 * i).alias("before"), F.get(parts, 2 * i + 2).alias("after"))
        return F.when(number > 0, let(let(sizes, lambda a: running_sum(a)), lambda ends: F.transform(each, lambda i: struct(ends, i)))).otherwise(F.expr(f"cast(array() as {kind})"))

    # most texts have no match at all: a pass without copies tells
    return F.when(text.rlike(pattern), let(F.when(text.contains(MARK), woven).otherwise(by_turns), place)).otherwise(F.expr(f"cast(array() as {kind})"))


def written(spans: Column) -> Column:
    """``kind:start:stop`` of an array of structs with these fields, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
