"""Near copies by shingle similarity: SimHash fingerprints compared in tiles, the shingle sets decide.

At a similarity of 0.8 fingerprints of 64 bits differ by ten bits or so, at random by thirty-two; so
here a text has 256 bits. The fingerprints of all different texts of like sizes are compared, tile by tile, by numpy exclusive-or
and bit counts as in ``simhash``: no index decides which of them meet. A tile is skipped only where the sets' sizes rule the
similarity out. What is near makes a graph, whose components are blocks; the shingle sets of a block's texts decide.

A row goes to a bounded number of chunks, so what is shuffled grows with the texts, and the comparisons with their square.
A group of copies may be a block of any size. Each of a block's texts is held against the block's pivot, and those
similar to it are tied to it and need no comparison with each other; only the rest make tiles of bounded size, which
all the block's texts visit. So a large group of near copies costs a step a text, and pairs never leave a task.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import LOWER, Workspace, slices, text_hash, unused
from tallymark.llm.components import components
from tallymark.llm.simhash import BLOCK, _edges, _roots

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint.
PRINTS = 4
#: Deviations above the mean that fingerprints of the least similarity may differ by, and the sizes up to which mean and deviation are worked out one by one.
DEVIATIONS, EXACT = 6.5, 48
#: Fingerprints of its own that a tile's chunk holds at least, chunks that a tile has at most, and fingerprints of a side in one exclusive-or.
CHUNK, CHUNKS, SIDE = 4096, 32, 256
#: Bands of a text, and least hashes in a band: at a similarity of 0.8 a band is shared with a chance of 0.26.
BANDS, ROWS = 64, 6
#: Candidates that are verified one by one.
FEW = 4
#: Bytes of shingles in a tile's chunk.
CHUNK_BYTES = 16 << 20
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
_MULTIPLIERS = np.random.default_rng(29).integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = np.random.default_rng(31).integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingles(text: bytes, k: int = SHINGLE, seed: int = 42) -> np.ndarray:
    """Ascending distinct hashes of the k-word shingles (of the whole text, if it has fewer words; none without words)."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(words), min(k, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """PRINTS words of a fingerprint: the majority of each bit of the hashes, mixed anew for each word."""
    out = np.zeros(PRINTS, np.uint64)
    for w in range(PRINTS if len(hashes) else 0):
        h = hashes if not w else (hashes ^ (hashes >> np.uint64(31))) * np.uint64(_MIX[w - 1])
        counts = np.zeros(64, np.int64)
        for i in range(0, len(h), 4096):
            counts += np.unpackbits(h[i : i + 4096].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        out[w] = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _flips(n: int, m: int, shared: int) -> float:
    """The chance that a bit differs between sets of n and m hashes, so many of them shared."""

    def over(size: int) -> np.ndarray:
        """The chance of a majority, by how many of the shared hashes have the bit."""
        own = size - shared
        tail = np.append(np.cumsum([math.comb(own, i) / 2.0**own for i in range(own, -1, -1)])[::-1], 0.0)
        return tail[np.clip(size // 2 + 1 - np.arange(shared + 1), 0, own + 1)]

    a, b = over(n), over(m)
    weights = np.array([math.comb(shared, i) / 2.0**shared for i in range(shared + 1)])
    return float((weights * (a * (1 - b) + b * (1 - a))).sum())


@functools.cache
def radii(threshold: float) -> np.ndarray:
    """[n, m]: bits by which fingerprints of n and m shingles (EXACT: so many or more) may differ; -1 where the sizes alone rule ``threshold`` out."""
    out = np.full((EXACT + 1, EXACT + 1), -1, np.int64)
    out[0, 0] = 0
    for n in range(1, EXACT):
        for m in range(n, EXACT):
            shared = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
            if shared <= n:
                p = _flips(n, m, shared)
                out[n, m] = out[m, n] = math.floor(64 * PRINTS * p + DEVIATIONS * math.sqrt(64 * PRINTS * p * (1 - p)))
    # the larger the sets the fewer bits differ, so what the upper half of the sizes needs is enough for all larger ones
    out[EXACT, 1:] = out[1:, EXACT] = out[EXACT // 2 :, EXACT // 2 :].max()
    return out


#: The most bits that may differ at SIMILARITY.
RADIUS = int(radii(SIMILARITY).max())


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS numbers for each set: hashes of ROWS least hashes each. The empty set has those of no other.

    An index for sets of SIMILARITY or more; ``similar_texts`` doesn't take it, as it compares all fingerprints.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.nonzero(sizes)[0]
    out = np.zeros((len(sets), BANDS), np.uint64)
    if len(full):
        every = np.concatenate([sets[i] for i in full])
        mixed = ((every ^ (every >> np.uint64(32))) * np.uint64(_MIX[2]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(sizes[full]) - sizes[full]
        held = np.full((len(full), BANDS), 0x9E3779B97F4A7C15, np.uint64)
        for i in range(BANDS * ROWS):
            least = np.minimum.reduceat((mixed ^ _SHIFTS[i]) * _MULTIPLIERS[i], starts).astype(np.uint64)
            column = (held[:, i % BANDS] ^ least) * np.uint64(_MIX[0])
            held[:, i % BANDS] = column ^ (column >> np.uint64(29))
        out[full] = held + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_MIX[1])
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets of shingles: shared ones by all; two empty sets are alike."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join a[i] and b[i] for all i at once; parents are always smaller, and all are roots afterwards."""
    while True:
        while ((top := parent[parent]) != parent).any():
            parent[:] = top
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class _Tile:
    """The fingerprints of one chunk, which later ones are held against; no more edges come of it than rows."""

    def __init__(self, threshold: float):
        self.threshold, self.radii = threshold, radii(threshold)
        self.keys, self.sizes, self.prints, self.parent = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, PRINTS), np.uint64), None

    def add(self, keys, sizes, prints) -> None:
        self.keys, self.sizes, self.prints = np.concatenate([self.keys, keys]), np.concatenate([self.sizes, sizes]), np.concatenate([self.prints, prints])

    def close(self) -> None:
        if self.parent is None:
            order, self.parent = np.argsort(self.sizes, kind="stable"), np.arange(len(self.keys))
            self.keys, self.sizes, self.prints = self.keys[order], self.sizes[order], self.prints[order]
            for i, j in self._near(self.sizes, self.prints, within=True):
                _hook(self.parent, i, j)

    def _near(self, sizes, prints, within: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of home rows and of other ones (both by size) whose sizes and fingerprints allow the similarity, SIDE rows of each at a time."""
        own, other = np.ascontiguousarray(self.prints.T), np.ascontiguousarray(prints.T)
        for a in range(0, len(self.keys), SIDE):
            n = self.sizes[a : a + SIDE]
            for b in range(0, a + SIDE if within else len(sizes), SIDE):
                m = sizes[b : b + SIDE]
                if not len(m) or m[-1] < self.threshold * n[0] or n[-1] < self.threshold * m[0]:
                    continue
                x, y = np.minimum(n, EXACT), np.minimum(m, EXACT)
                most = self.radii[x[0] : x[-1] + 1, y[0] : y[-1] + 1].max()
                if most < 0:
                    continue
                # in bytes: a difference of all 256 bits would count as none, and the shingle sets decide
                apart = np.bitwise_count(own[0, a : a + SIDE, None] ^ other[0, None, b : b + SIDE])
                for w in range(1, PRINTS):
                    apart += np.bitwise_count(own[w, a : a + SIDE, None] ^ other[w, None, b : b + SIDE])
                near = apart <= most
                if not near.any():
                    continue
                i, j = np.nonzero(near)
                near = apart[i, j] <= self.radii[x[i], y[j]]
                near &= np.minimum(n[i], m[j]) >= self.threshold * np.maximum(n[i], m[j])
                i, j = i[near] + a, j[near] + b
                if len(i):
                    yield i, j

    def visit(self, keys, sizes, prints) -> list[np.ndarray]:
        self.close()
        order = np.argsort(sizes, kind="stable")
        keys, lead = keys[order], np.full(len(keys), -1)
        for i, j in self._near(sizes[order], prints[order]):
            new = lead[j] < 0
            lead[j[new]] = i[new]
            _hook(self.parent, lead[j], i)
        found = lead >= 0
        return [np.stack([keys[found], self.keys[lead[found]]], 1).view(np.uint64)] if found.any() else []

    def forest(self) -> list[np.ndarray]:
        self.close()
        bound = np.nonzero(self.parent != np.arange(len(self.parent)))[0]
        return [np.stack([self.keys[bound], self.keys[self.parent[bound]]], 1).view(np.uint64)] if len(bound) else []


class _Index:
    """Which of some sets have which shingle."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.values, self.rows, self.number = every[order], np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])[order], len(sets)

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many shingles each set has in common with ``own``."""
        lo, hi = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
        counts = hi - lo
        places = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - lo, counts)
        return np.bincount(self.rows[places], minlength=self.number)


class _Home:
    """The rows of one chunk, which later ones are held against."""

    def __init__(self, threshold: float):
        self.threshold, self.radius = threshold, int(radii(threshold).max())
        self.keys, self.sizes, self.prints = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, PRINTS), np.uint64)
        self.sets: list[np.ndarray] = []
        self.parent = np.zeros(0, np.int64)
        self.closed = False

    def add(self, keys, sizes, prints, sets) -> None:
        self.keys, self.sizes, self.prints = np.concatenate([self.keys, keys]), np.concatenate([self.sizes, sizes]), np.concatenate([self.prints, prints])
        self.sets += sets

    def close(self) -> None:
        if not self.closed:
            self.closed, self.parent = True, np.arange(len(self.keys))
            order = np.argsort(np.bitwise_count(self.prints).sum(1), kind="stable")
            self.keys, self.sizes, self.prints, self.sets = self.keys[order], self.sizes[order], self.prints[order], [self.sets[i] for i in order]
            self.index, self.of, self.shared = _Index(self.sets), None, None
            for i, js in self._candidates(self.sizes, self.prints, within=True):
                for j in self._similar(self.sets[i], js, i):
                    self._join(i, j)

    def _join(self, i: int, j: int) -> None:
        a, b = _roots(self.parent, i), _roots(self.parent, j)
        self.parent[max(a, b)] = min(a, b)

    def _similar(self, own: np.ndarray, js: np.ndarray, place: int | None = None) -> list[int]:
        """A similar home row of each component that ``js`` have one of, but that of ``place``: few are verified one by one, of many the index tells all at once."""
        out = []
        if place is not None:
            js = js[self._all_roots(js) != _roots(self.parent, place)]
        if len(js) and similarity(own, self.sets[js[0]]) >= self.threshold:  # a row of a large group of copies is done with this
            out.append(int(js[0]))
            roots = self._all_roots(js)
            js = js[roots != roots[0]]
        if len(js) <= FEW:
            return out + [j for j in js.tolist() if similarity(own, self.sets[j]) >= self.threshold]
        if self.of is not own:
            self.of, self.shared = own, self.index.shared(own)
        near = js[self.shared[js] / np.maximum(len(own) + self.sizes[js] - self.shared[js], 1) >= self.threshold]
        return out + near[np.unique(self._all_roots(near), return_index=True)[1]].tolist()

    def _all_roots(self, js: np.ndarray) -> np.ndarray:
        root = self.parent[js]
        while (self.parent[root] != root).any():
            root = self.parent[root]
        return root

    def _candidates(self, sizes, prints, within: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """For each row, the home rows whose sizes and fingerprints allow the similarity, a block at a time."""
        counts, own_counts = np.bitwise_count(prints).sum(1, dtype=np.int64), np.bitwise_count(self.prints).sum(1, dtype=np.int64)
        for a in range(0, len(prints), BLOCK):
            for b in range(0, min(len(self.prints), a + BLOCK) if within else len(self.prints), BLOCK):
                p, q = counts[a : a + BLOCK], own_counts[b : b + BLOCK]
                if p.min() - q.max() > self.radius or q.min() - p.max() > self.radius:
                    continue
                apart = sum(np.bitwise_count(prints[a : a + BLOCK, None, w] ^ self.prints[None, b : b + BLOCK, w]).astype(np.int16) for w in range(PRINTS))
                i, j = np.nonzero(apart <= self.radius)
                i, j = i + a, j + b
                small, large = np.minimum(sizes[i], self.sizes[j]), np.maximum(sizes[i], self.sizes[j])
                kept = small >= self.threshold * large
                if within:
                    kept &= j < i
                i, j = i[kept], j[kept]
                if len(i):
                    cuts = np.nonzero(np.diff(i))[0] + 1
                    for x, y in itertools.pairwise([0, *cuts.tolist(), len(i)]):
                        yield int(i[x]), j[x:y]

    def visit(self, keys, sizes, prints, sets) -> list[np.ndarray]:
        self.close()
        lead: dict[int, int] = {}
        for i, js in self._candidates(sizes, prints):
            for j in self._similar(sets[i], js, lead.get(i)):
                if i in lead:
                    self._join(lead[i], j)
                else:
                    lead[i] = j
        return [np.stack([keys[list(lead)], self.keys[list(lead.values())]], 1).view(np.uint64)] if lead else []

    def forest(self) -> list[np.ndarray]:
        self.close()
        bound = np.nonzero(self.parent != np.arange(len(self.parent)))[0]
        return [np.stack([self.keys[bound], self.keys[self.parent[bound]]], 1).view(np.uint64)] if len(bound) else []


def _compare(threshold: float, with_sets: bool):
    """Rows (block, chunk, visits, key, n, prints[, shingles]) in that order to edges: between near fingerprints, or with the sets between similar texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, at = None, None
        for batch in batches:
            block, chunk, visits, keys, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(batch):
                continue
            prints = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(-1, PRINTS)
            sets = [np.frombuffer(s, np.uint64) for s in batch.column(6).to_pylist()] if with_sets else None
            cuts = np.nonzero((np.diff(block) != 0) | (np.diff(chunk) != 0) | (np.diff(visits) != 0))[0] + 1
            out: list[np.ndarray] = []
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(keys)]):
                if (block[a], chunk[a]) != at:
                    if home is not None:
                        out += home.forest()
                    home, at = _Home(threshold) if with_sets else _Tile(threshold), (block[a], chunk[a])
                rows = (keys[a:b], sizes[a:b], prints[a:b], *([sets[a:b]] if with_sets else []))
                if visits[a]:
                    out += home.visit(*rows)
                else:
                    home.add(*rows)
            if out:
                yield _edges(out)
        if home is not None and (out := home.forest()):
            yield _edges(out)

    return run


def _held_to_pivot(threshold: float):
    """Rows (block, key, n, shingles, pivot) to (block, key, n, near)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= threshold for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_())], names=["block", "key", "n", "near"])

    return run


def blocks(nodes: DataFrame, work: Workspace, threshold: float = SIMILARITY) -> DataFrame:
    """(key, block): the texts whose fingerprints are near another one's, by the components of all that are.

    A tile has the texts whose numbers of shingles are ``threshold`` of each other or more, about; a similar one is in the same tile or the next. Every
    fingerprint of a tile meets every other one there and in the next tile, in chunks.
    """
    # a little wider than the threshold asks, so that no rounding puts similar texts two tiles apart
    width = max(math.log(1 / threshold), 0.01) * (1 + 1e-6)
    tile = F.when(F.col("n") > 0, F.floor(F.log(F.col("n").cast("double")) / width)).otherwise(F.lit(-2)).cast("long")
    sized = nodes.select(tile.alias("tile"), "key", "n", "prints")
    tiles = F.broadcast(sized.groupBy("tile").agg(F.least(F.ceil(F.count("*") / CHUNK), F.lit(CHUNKS)).cast("int").alias("chunks")))
    rows = sized.join(tiles, "tile").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    own = rows.select("tile", F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("at"), "chunk", "key", "n", "prints")
    own = own.select("tile", F.col("at").alias("chunk"), F.when(F.col("at") < F.col("chunk"), 1).otherwise(0).alias("visits"), "key", "n", "prints")
    on = sized.withColumn("tile", F.col("tile") + 1).join(tiles, "tile")
    on = on.select("tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("visits"), "key", "n", "prints")
    dealt = own.unionByName(on).repartition("tile", "chunk").sortWithinPartitions("tile", "chunk", "visits")
    stars = components(dealt.mapInArrow(_compare(threshold, False), "u long, v long"), work, "block")
    return work.write(stars.select(F.col("u").alias("key"), F.col("v").alias("block")).union(stars.select("v", "v").distinct()), "blocks")


def similar_texts(docs: DataFrame, row_col: str, text_col: str, work: Workspace, k: int = SHINGLE, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(nodes, stars): nodes (key, row, ...) of the different texts, row being the least of ``row_col``; stars (u, v) tie each key to the least of its component."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shingles(t or b"", k) for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([len(h) for h in found], pa.int64()), pa.array([sketch(h).tobytes() for h in found], pa.binary())], names=["key", "row", "n", "prints"])

    rows = docs.select(text_hash(text_col).alias("key"), F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    sketched = rows.mapInArrow(make, f"key long, row {kind}, n long, prints binary")
    nodes = work.write(sketched.groupBy("key").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "prints")]), "texts")
    member = nodes.join(blocks(nodes, work, threshold), "key").select("block", "key", "n", "prints", F.col("row").alias("row_"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t or b"", k).tobytes() for t in part.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(sets, pa.binary())], names=["block", "key", "n", "prints", "shingles"])

    own = rows.withColumnRenamed("key", "key_")
    texts = own.join(member.hint("shuffle_hash"), (F.col("key_") == F.col("key")) & F.col("row").eqNullSafe(F.col("row_")))
    full = work.write(texts.select("block", "key", "n", "prints", "text").mapInArrow(fetch, "block long, key long, n long, prints binary, shingles binary").dropDuplicates(["key"]), "sets")
    # a block is named by its least key, whose text is the pivot
    pivots = full.where("key = block").select(F.col("block").alias("block_"), F.col("shingles").alias("pivot"))
    held = full.join(pivots, F.col("block") == F.col("block_")).select("block", "key", "n", "shingles", "pivot")
    rings = work.write(held.mapInArrow(_held_to_pivot(threshold), "block long, key long, n long, near boolean"), "rings")
    tied = rings.where("near and key <> block").select(F.col("key").alias("u"), F.col("block").alias("v"))
    tiles = rings.where("not near").groupBy("block").agg(F.ceil(F.sum(8 * F.col("n") + 64) / CHUNK_BYTES).cast("int").alias("chunks"))
    placed = rings.join(tiles, "block").select("key", "near", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int").alias("chunk"), "chunks")
    # those near the pivot visit every chunk of the others; the others are at home in one, and visit the lower ones
    last = F.when(F.col("near"), F.col("chunks") - 1).otherwise(F.col("chunk"))
    visits = placed.select("key", F.explode(F.sequence(F.lit(0), last)).alias("chunk_"), "near", "chunk").select("key", F.col("chunk_").alias("chunk"), F.when(F.col("near") | (F.col("chunk_") < F.col("chunk")), 1).otherwise(0).alias("visits"))
    dealt = full.join(visits, "key").select("block", "chunk", "visits", "key", "n", "prints", "shingles").repartition("block", "chunk").sortWithinPartitions("block", "chunk", "visits")
    verified = work.write(dealt.mapInArrow(_compare(threshold, True), "u long, v long"), "verified")
    return nodes, components(tied.unionByName(verified), work, "similar")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each group of texts tied together by a shingle similarity of ``threshold`` or more.

    It is that of the least id (null ids last), then of the least text hash; of equal rows any one.
    Texts without words (null ones too) are alike. All columns are kept.
    """
    work, row = Workspace(docs.sparkSession), unused(docs, "row")
    marked = docs.withColumn(row, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), text_hash(text_col).alias("hash")))
    nodes, stars = similar_texts(marked, row, text_col, work, k, threshold)
    rooted = nodes.join(stars.withColumnRenamed("u", "key"), "key", "left").select("row", F.coalesce("v", "key").alias("root"))
    kept_name = unused(marked, "kept")
    chosen = work.write(rooted.groupBy("root").agg(F.min("row").alias(kept_name)).select(kept_name), "chosen")
    kept = marked.join(chosen.hint("shuffle_hash"), marked[row].eqNullSafe(F.col(kept_name)), "left_semi")
    # equal rows (one id, one text) are rare, but all of them have just been kept
    times = marked.groupBy(row).agg(F.count("*").alias("n")).where("n > 1").select(F.col(row).alias(kept_name))
    repeated = work.write(times.join(chosen, times[kept_name].eqNullSafe(chosen[kept_name]), "left_semi"), "repeated")
    if repeated.limit(1).count():
        same = marked[row].eqNullSafe(F.col(kept_name))
        once = kept.join(repeated, kept[row].eqNullSafe(F.col(kept_name)), "left_anti")
        kept = once.unionByName(marked.join(repeated, same, "left_semi").dropDuplicates([row]))
    return kept.drop(row)
