"""Mix sources to target weights, by DataFrame operations only.

Rows get hash-random keys, a source's rows are ordered by key range (the leading digits of the key
are the range, so that no source has to fit in one task), and word counts are summed along that order: totals of the
ranges before, then, in the one range of a source that the budget ends in, the rows before. That gives a key at which the
source's order is cut at its exact budget; a budget above the source's size takes whole epochs first. So what is
taken of a row follows from its key and its source's cut, and no text is ever moved for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm.common import WORD, Workspace, table

#: Weights of the sources in code point order, repeating; what share of all words the mix takes; how often a source may be taken at most.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Leading hexadecimal digits of the key that make a range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for each source.

    Sharing the excess again by weight until no target is above its cap comes to one water level:
    with the sources in order of cap / weight, the first k are full and the rest get level x weight,
    for the smallest k at which the next one isn't full; levels for larger k are lower, so it is the
    highest of those that fit. The windows run over sources, not rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = F.when(F.col("left_weight") > 0, (F.col("total") * share - F.col("full_before")) / F.col("left_weight")).otherwise(F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("full_before", F.coalesce(F.sum("cap").over(fill), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(rest))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", level)
        .withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
        .select("source", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, key, size, carried_*): the key is a hash of id and text, so only equal rows share one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(text), F.lit("mix")))
    return docs.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), key.alias("key"), word_count(F.col(text_col)).alias("size"), *[F.col(c).alias(f"carried_{c}") for c in carry])


def source_cuts(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, epochs, cut, part), a row for each source of ``rows`` (source, key, size).

    Rows with a key below ``cut`` are taken once more than ``epochs`` times, and ``part`` words of each row with that key. The
    windows run over the ranges, and over the rows of the ranges in which a budget ends.
    """
    span = F.substring("key", 1, RANGE_DIGITS)
    ranges = rows.select("source", span.alias("range"), "size").groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before_range", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    t = targets.select(F.col("source").alias("source_t"), "rest")
    last = ranges.join(t, F.col("source").eqNullSafe(F.col("source_t"))).where((F.col("before_range") <= F.col("rest")) & (F.col("rest") < F.col("before_range") + F.col("range_size")))
    last = last.select(F.col("source").alias("source_l"), F.col("range").alias("range_l"), (F.col("rest") - F.col("before_range")).alias("left"))
    # equal rows are one step, however many
    inside = rows.withColumn("range", span).join(last, F.col("source").eqNullSafe(F.col("source_l")) & (F.col("range") == F.col("range_l")))
    steps = inside.groupBy("source", "left", "key").agg(F.sum("size").alias("sizes"), F.count("*").alias("n"))
    within = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("before", F.coalesce(F.sum("sizes").over(within), F.lit(0)))
    cut = steps.where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("sizes")))
    cut = cut.select(F.col("source").alias("source_c"), F.col("key").alias("cut"), F.expr("(left - before) div n").alias("part"))
    return targets.join(cut, F.col("source").eqNullSafe(F.col("source_c")), "left").select("source", "source_size", "target", "epochs", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("part", F.lit(0)).alias("part"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken, source) of each document, and the columns named in ``carry``.

    ``size`` is the number of words, ``taken`` the words the mix takes of the document, repeats
    counted: its size for each whole epoch, and once more for the documents that the rest of the
    budget reaches in key order; the document at the cut gives only the words still missing, so a
    source's taken words are its target rounded down. Equal rows get equal results: of n at the cut each gives the n-th part, and up to n - 1 words stay missing.
    Null text: size 0 and nothing taken; null source: a source of its own, last; rows of one id, or of none, are apart by
    their texts; a table without rows gives none. Other columns are not read; a carried column gives way where its name is one of the above.
    """
    work = Workspace(docs.sparkSession)
    carry = tuple(c for c in carry if c.lower() not in {"size", "source_size", "target", "taken", "source", id_col.lower()})
    rows = work.write(keyed(docs, id_col, text_col, source_col), "keys")
    cuts = work.write(source_cuts(rows, weights, share, most), "cuts").withColumnRenamed("source", "source_")
    joined = (keyed(docs, id_col, text_col, source_col, carry) if carry else rows).join(cuts, F.col("source").eqNullSafe(F.col("source_")))
    once = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.col("part")).otherwise(F.lit(0))
    return joined.select(F.col(id_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + once).cast("long").alias("taken"), "source", *[F.col(f"carried_{c}").alias(c) for c in carry])


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')), 'mix')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM d GROUP BY source
), c AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s
), f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS full_before,
         sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM c
), l AS (SELECT *, (total * 1.5::DOUBLE - full_before) / left_weight AS level FROM f),
w AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(water * weight, cap)) AS target FROM w),
g AS (SELECT source, k, size, count(*) AS n FROM d GROUP BY source, k, size),
p AS (
  SELECT g.source, k, size, n, source_size, target,
         coalesce(sum(size * n) OVER (PARTITION BY g.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source
)
SELECT d.doc_id, d.size, source_size, target,
       CAST(epochs * d.size + greatest(0, least(d.size * n, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) // n AS BIGINT) AS taken, d.source
FROM d JOIN p ON d.k = p.k AND d.size = p.size AND d.source IS NOT DISTINCT FROM p.source
"""
