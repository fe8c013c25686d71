"""Secrets: fixed patterns, and how many owners share each candidate, by DataFrame functions only.

Candidates are the fixed patterns' values and every long token of mixed letters and digits. Their
hashes are counted over the corpus by distinct documents (a repository each) and by distinct owners
(the sources): what many owners or many repositories hold is a copied example, what one owner holds in few
repositories and looks random is a live-looking credential. The latter, where no fixed pattern has found it, adds a span of kind ``live``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Workspace, safe_id, table
from tallymark.llm.spans import matches, written

KINDS = ("assign", "access", "hex")
# The second and third find what the plain patterns with a length check find: each match is the rest of its run.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
_RUN = "A-Za-z0-9+/_="
#: A token that could be a credential: so long, with a digit, a small and a capital letter.
TOKEN = rf"(?<![{_RUN}-])(?=[a-z+/_=-]*+[0-9A-Z])[{_RUN}-]{{20,}}+"
#: Owners, or repositories of however few owners, from which a candidate counts as a copied example; distinct characters that look random.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, DISTINCT = 3, 10, 12


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, stop, kind, value>> of the fixed patterns by start, then kind."""
    parts = []
    for rank, kind in enumerate(KINDS):
        value = lambda m: F.regexp_extract(m["match"], _VALUE, 1) if kind == "assign" else m["match"]
        found = F.transform(matches(text, PATTERNS[kind]), lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["stop"].alias("stop"), F.lit(kind).alias("kind"), value(m).alias("value")))
        parts.append(F.filter(found, lambda s: F.length(s["value"]) >= 6) if kind == "assign" else found)
    return F.array_sort(F.concat(*parts))


def _looks_live(token: Column) -> Column:
    mixed = token.rlike("[0-9]") & token.rlike("[a-z]") & token.rlike("[A-Z]")
    return mixed & (F.size(F.array_distinct(F.split(token, ""))) >= DISTINCT)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """(id, base, spans, n_example, n_live): arrays of struct<kind, start, stop>, places in code points, stop exclusive.

    ``base`` is what the fixed patterns find, by start and kind; ``spans`` adds owner-specific
    live-looking tokens, which never overlap a base span. ``n_example`` counts the base spans whose value
    ``example_owners`` owners or more hold, or ``example_repositories`` repositories or more, ``n_live`` the spans whose
    value one owner holds in fewer repositories than that. Null
    and empty texts have none; null owners are one owner; equal rows are one repository and get equal results; every
    row stays; other columns aren't read.
    """
    work = Workspace(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"), text.alias("text"))
    tokens = F.filter(matches(F.col("text"), TOKEN), lambda m: _looks_live(m["match"]))
    tokens = F.transform(tokens, lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), m["stop"].alias("stop"), F.lit("live").alias("kind"), m["match"].alias("value")))
    both = rows.select("id", "owner", F.xxhash64("text").alias("text_hash"), base_spans(F.col("text")).alias("base"), tokens.alias("tokens"))
    clear = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (b["stop"] > t["start"])))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"), F.xxhash64(s["value"]).alias("h")))
    found = work.write(both.select("id", "owner", "text_hash", hashed(F.col("base")).alias("base"), hashed(clear).alias("tokens")), "found")
    each = found.select("id", "owner", "text_hash", F.explode(F.concat("base", "tokens")).alias("s"))
    repository = F.xxhash64(safe_id("id"), F.col("text_hash"))
    owned = each.select(F.col("s.h").alias("h"), "owner", repository.alias("repository")).distinct().groupBy("h", "owner").agg(F.count("*").alias("n"))
    held = owned.groupBy("h").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    many = F.col("repositories") >= example_repositories
    verdict = held.select("h", ((F.col("owners") >= example_owners) | many).alias("example"), ((F.col("owners") == 1) & ~many).alias("live"))
    judged = each.withColumn("h", F.col("s.h")).join(verdict, "h")
    per_row = judged.groupBy("id", "owner", "text_hash").agg(
        F.array_sort(F.collect_set(F.when(F.col("s.rank") == len(KINDS), F.when(F.col("live"), F.struct("s.start", "s.rank", "s.stop", "s.kind"))))).alias("more"),
        F.size(F.collect_set(F.when((F.col("s.rank") < len(KINDS)) & F.col("example"), F.struct("s.start", "s.rank")))).cast("long").alias("n_example"),
        F.size(F.collect_set(F.when(F.col("live"), F.struct("s.start", "s.rank")))).cast("long").alias("n_live"),
    )
    per_row = per_row.select(F.col("id").alias("id_"), F.col("owner").alias("owner_"), F.col("text_hash").alias("hash_"), "more", "n_example", "n_live")
    joined = found.join(per_row, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")) & (F.col("owner") == F.col("owner_")), "left")
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    every = F.when(F.col("more").isNull(), short(F.col("base"))).otherwise(F.array_sort(F.concat(short(F.col("base")), F.col("more"))))
    return joined.select(F.col("id").alias(id_col), plain(F.col("base")).alias("base"), plain(every).alias("spans"), F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("n_live", F.lit(0)).alias("n_live"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "n_example", "n_live")
