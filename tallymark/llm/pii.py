"""Personal data: fixed patterns, and what their contexts bring to light, by DataFrame functions only.

The fixed patterns find seed entities. Seeds and every other identifier-shaped piece of text are
instances; the word right before an instance, and the one right after it, are its lexical patterns (together with whether the instance
is an address or a number). Spark scores the bipartite graph in rounds: an instance is believed if it is a
seed or a pattern accepted in an earlier round has it, so no pattern ever vouches for itself; a pattern is accepted once so many
distinct believed instances have it and they are nearly all it has. Each round's new instances are the next
one's support, until a round accepts nothing. Instances of accepted patterns that no fixed pattern
found are personal data too, of kind ``context``.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Workspace, table, text_hash, unused
from tallymark.llm.spans import matches, written

KINDS = ("email", "ip", "card", "phone")
# The look-behinds and possessive repeats find what the plain patterns find, in linear time: a match
# can begin inside a run of its first class only where the match before it ended.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0-9A-Za-z_%@"
#: Identifier-shaped: parts joined by dots, dashes or pluses with five digits or with an @ inside, or numbers parted by single spaces or dashes, the first perhaps in parentheses.
INSTANCE = (
    rf"(?<![{_PART}.+-])(?:"
    rf"(?:\+?\([0-9]++\)|\+?[0-9]++)(?:[\x20-][0-9]++){{2,}}+(?![{_PART}])"
    rf"|\+?(?=(?:[A-Za-z_%@.+-]*+[0-9]){{5}}|[{_PART}.+-]*?[A-Za-z0-9]@[A-Za-z0-9])[{_PART}]++(?:[.+-]++[{_PART}]++)*+)"
)
#: Distinct believed instances that a pattern needs, and the share of its instances that they must be.
SUPPORT, BELIEF = 5, 0.9


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits' check sum holds: from the right, every second one doubled, less 9 if above 9."""
    back = F.reverse(digits)
    digit = lambda i: back.substr(i, F.lit(1)).cast("int")
    doubled = lambda d: d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0))
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 1, digit(i)).otherwise(doubled(digit(i))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(match)).between(16, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _patterns(m: Column) -> Column:
    """array<string> of a match: the words right before and after it, whatever stands between that is no letter or digit, each with the kind of instance."""
    word = lambda text, regex: F.lower(F.regexp_extract(text, regex, 1))
    kind = F.when(m["match"].contains("@"), F.lit("@")).otherwise(F.lit("#"))
    sides = F.array(F.struct(F.lit("<").alias("side"), word(m["before"], r"(?<!\p{L})(\p{L}++)[^\p{L}\p{N}]*+$").alias("word")), F.struct(F.lit(">").alias("side"), word(m["after"], r"^[^\p{L}\p{N}]*+(\p{L}++)").alias("word")))
    return F.transform(F.filter(sides, lambda x: x["word"] != ""), lambda x: F.concat(x["side"], kind, x["word"]))


def instances(text: Column) -> tuple[Column, Column]:
    """(base, others): the seeds by kind and start, and identifier-shaped pieces clear of them, as array<struct<kind, start, stop, instance, patterns>>."""
    held = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["stop"].alias("stop"), F.xxhash64(m["match"]).alias("instance"), _patterns(m).alias("patterns"))
    base = F.concat(*[F.transform(F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["match"])), held(kind)) for kind in KINDS])
    return base, F.transform(matches(text, INSTANCE), held("context"))


def accepted_patterns(edges: DataFrame, work: Workspace, support: int = SUPPORT, belief: float = BELIEF) -> DataFrame:
    """(pattern) of those accepted, from the graph's distinct edges (pattern, instance, seed).

    A round is an aggregation by instance, a join on it and an aggregation by pattern, all combined before their
    shuffles; the accepted patterns are written to the shared folder after each. They only ever grow, so the rounds end.
    """
    accepted = work.write(edges.select("pattern").limit(0), "accepted-0")
    for i in itertools.count(1):
        found = edges.join(accepted, "pattern", "left_semi").select("instance").distinct().withColumn("found", F.lit(True))
        open_ = edges.join(accepted, "pattern", "left_anti").join(found, "instance", "left")
        believed = F.col("seed") | F.coalesce("found", F.lit(False))
        scored = open_.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(believed).alias("believed"))
        new = work.write(scored.where((F.col("believed") >= support) & (F.col("believed") >= belief * F.col("n"))).select("pattern"), f"new-{i}")
        if new.isEmpty():
            return accepted
        accepted = work.write(accepted.unionByName(new), f"accepted-{i}")
        work.drop(f"accepted-{i - 1}")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, belief: float = BELIEF) -> DataFrame:
    """(id, text_hash, base, spans): arrays of struct<kind, start, stop>, places in code points, stop exclusive.

    ``base`` is what the fixed patterns find, by kind and start; ``spans`` adds those of kind
    ``context``, which never overlap a base span. A pattern's word is the nearest one on its side with no letter or digit
    between, however long the word or the gap, as far as the next match of the same kind; an instance without such a word has no pattern there. Null and empty texts have none; whole texts are
    searched; every row stays, and equal rows get equal spans; other columns aren't read. ``text_hash`` tells rows
    of one id with different texts apart.
    """
    work = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, others = instances(F.col("text"))
    found = rows.select("id", F.xxhash64("text").alias("text_hash"), base.alias("base"), others.alias("others"))
    clear = F.filter("others", lambda o: ~F.exists("base", lambda b: (b["start"] < o["stop"]) & (b["stop"] > o["start"])))
    found = work.write(found.withColumn("others", clear), "found")
    each = found.select("id", "text_hash", F.explode(F.concat("base", "others")).alias("m")).select("id", "text_hash", "m.*")
    edges = each.select(F.explode("patterns").alias("pattern"), "instance", (F.col("kind") != "context").alias("seed"))
    edges = work.write(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    accepted = accepted_patterns(edges, work, support, belief)
    believed = work.write(edges.join(accepted, "pattern", "left_semi").select("instance").distinct(), "believed")
    more = each.where("kind = 'context'").join(believed, "instance", "left_semi")
    more = more.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("more")).withColumnRenamed("id", "id_").withColumnRenamed("text_hash", "hash_")
    joined = found.join(more, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")
    short = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["stop"].alias("stop")))
    return joined.select(F.col("id").alias(id_col), "text_hash", short.alias("base"), F.when(F.col("more").isNull(), short).otherwise(F.concat(short, "more")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``found`` replaced by its kind in angle brackets, overlapping spans by the first one's.

    Null texts stay null, empty ones empty, rows without a span as they are; equal rows are redacted alike, and every row and column stays.
    """
    own, own_hash, all_spans = unused(docs, "id"), unused(docs, "hash"), unused(docs, "spans")
    spans = found.select(F.col(id_col).alias(own), F.col("text_hash").alias(own_hash), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind")))).alias(all_spans))
    spans = spans.where(F.size(all_spans) > 0).dropDuplicates([own, own_hash])
    joined = docs.join(spans, docs[id_col].eqNullSafe(F.col(own)) & (text_hash(text_col) == F.col(own_hash)), "left")
    text = F.col(text_col)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def take(done: Column, s: Column) -> Column:
        piece = F.when(s["start"] >= done["at"], F.concat(done["out"], text.substr(done["at"] + 1, s["start"] - done["at"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["stop"]).alias("at"), piece.alias("out"))

    clean = F.aggregate(all_spans, begin, take, lambda done: F.concat(done["out"], text.substr(done["at"] + 1, F.length(text))))
    return joined.withColumn(text_col, F.when(F.col(all_spans).isNull(), text).otherwise(clean)).select(docs.columns)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
