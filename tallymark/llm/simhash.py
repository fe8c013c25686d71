"""SimHash near-duplicates: exact comparison of all fingerprints, tile by tile.

Fingerprints within r bits also have population counts within r; this holds for each 16-bit word of
them, and the differences of the four words add up to r at most. So distinct fingerprints are tiled
by the population counts of their words, and only tiles whose counts differ by r in sum are
compared: numpy exclusive-or and bit counts on every pair of those tiles. Nothing else is skipped.

What is shuffled are distinct fingerprints (copies are aggregated first), each to its own tile and to
the neighbours that exist; a tile of many rows is cut into chunks of bounded size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import LOWER, Workspace, slices, table
from tallymark.llm.components import components

WORDS, BITS = 4, 16
#: Fingerprints of its own that a tile's chunk holds, about.
CHUNK = 4096
#: Rows and columns of one exclusive-or.
BLOCK = 1024


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is set in over half of the hashes of the word shingles of ``text``; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp): one map over the rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                found = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=[id_col, "fp"])

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fp long")


def neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of the words' counts by ``radius`` in sum at most; of d and -d only one."""
    return [d for d in itertools.product(range(-radius, radius + 1), repeat=WORDS) if sum(map(abs, d)) <= radius and d > (0,) * WORDS]


def _roots(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


class _Tile:
    """The rows of one chunk; compares what comes after with them and keeps a spanning forest of the links."""

    def __init__(self, radius: int):
        self.radius, self.home, self.parent = radius, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _links(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in home, place in rows) within the radius."""
        own, other = [], []
        for a in range(0, len(self.home), BLOCK):
            for b in range(0, len(rows), BLOCK):
                near = np.bitwise_count(self.home[a : a + BLOCK, None] ^ rows[None, b : b + BLOCK]) <= self.radius
                i, j = np.nonzero(near)
                own.append(i + a)
                other.append(j + b)
        return (np.concatenate(own), np.concatenate(other)) if own else (np.zeros(0, int), np.zeros(0, int))

    def _union(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = _roots(self.parent, a), _roots(self.parent, b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)

    def add_home(self, rows: np.ndarray) -> None:
        self.home = np.concatenate([self.home, rows])
        self.parent = np.arange(len(self.home))

    def close_home(self) -> None:
        i, j = self._links(self.home)
        self._union(np.stack([i, j], 1)[i < j])

    def visit(self, rows: np.ndarray) -> list[np.ndarray]:
        i, j = self._links(rows)
        if not len(i):
            return []
        order = np.argsort(j, kind="stable")
        i, j = i[order], j[order]
        first = np.concatenate(([True], j[1:] != j[:-1]))
        lead = i[first][np.cumsum(first) - 1]
        self._union(np.unique(np.stack([lead, i], 1)[lead != i], axis=0))
        return [np.stack([self.home[i[first]], rows[j[first]]], 1)]

    def forest(self) -> list[np.ndarray]:
        bound = np.nonzero(self.parent != np.arange(len(self.parent)))[0]
        return [np.stack([self.home[bound], self.home[self.parent[bound]]], 1)] if len(bound) else []


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(u, v): links that join all fingerprints of ``distinct`` (fp) which ``radius`` bits or fewer tie together.

    Each tile returns a spanning forest of its links, so there are no more rows than fingerprints
    sent, however close together they lie.
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", BITS * w).bitwiseAND(F.lit((1 << BITS) - 1))).cast("int") for w in range(WORDS)]
    side = BITS + 1
    number = lambda parts: sum((p * side**w for w, p in enumerate(parts)), F.lit(0))
    rows = distinct.select("fp", *[c.alias(f"p{w}") for w, c in enumerate(counts)]).withColumn("tile", number([F.col(f"p{w}") for w in range(WORDS)]).cast("int"))
    # at most (BITS + 1) ** WORDS rows, 83,521, however many fingerprints there are
    tiles = F.broadcast(rows.groupBy("tile").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))
    rows = rows.join(tiles, "tile").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    home = rows.select("tile", "chunk", F.lit(0).alias("visits"), "fp")
    inner = rows.where("chunk > 0").select("tile", F.explode(F.sequence(F.lit(0), F.col("chunk") - 1)).alias("chunk"), F.lit(1).alias("visits"), "fp")
    moves = []
    for d in neighbours(radius):
        parts = [F.col(f"p{w}") + F.lit(x) for w, x in enumerate(d)]
        inside = [p.between(0, BITS) for p, x in zip(parts, d, strict=True) if x]
        ok = inside[0]
        for x in inside[1:]:
            ok = ok & x
        moves.append(F.when(ok, number(parts)).cast("int"))
    abroad = rows.select("fp", F.explode(F.filter(F.array(*moves), lambda x: x.isNotNull())).alias("tile")).join(tiles, "tile")
    abroad = abroad.select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("visits"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, key, closed = None, None, False
        for batch in batches:
            tiles_, chunks, visits, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            fps = fps.view(np.uint64) if fps.dtype == np.int64 else fps.astype(np.int64).view(np.uint64)
            cuts = np.nonzero((np.diff(tiles_) != 0) | (np.diff(chunks) != 0) | (np.diff(visits) != 0))[0] + 1
            out: list[np.ndarray] = []
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(fps)]):
                if a == b:
                    continue
                if (tiles_[a], chunks[a]) != key:
                    if tile is not None:
                        if not closed:
                            tile.close_home()
                        out += tile.forest()
                    tile, key, closed = _Tile(radius), (tiles_[a], chunks[a]), False
                if visits[a]:
                    if not closed:
                        tile.close_home()
                        closed = True
                    out += tile.visit(fps[a:b])
                else:
                    tile.add_home(fps[a:b])
            if out:
                yield _edges(out)
        if tile is not None:
            if not closed:
                tile.close_home()
            if out := tile.forest():
                yield _edges(out)

    dealt = home.unionByName(inner).unionByName(abroad).repartition("tile", "chunk").sortWithinPartitions("tile", "chunk", "visits")
    return dealt.mapInArrow(compare, "u long, v long")


def _edges(parts: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(parts).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id): fingerprints as 16 hexadecimal digits, components by their smallest id.

    Texts that are null, empty or blank have fingerprint 0, which links like any other; a text of
    fewer words than a shingle is one shingle. Equal rows are one node; null ids take no part in the minimum, so
    a component of null ids only has a null component_id. Columns other than the two named are not read.
    """
    work = Workspace(docs.sparkSession)
    prints = work.write(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = work.write(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes")
    stars = components(links(nodes.select("fp"), radius), work)
    rooted = nodes.join(stars.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
