"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of ``WINDOW`` words, half overlapping. Over the benchmark's words (the
others can't tell passages apart here) passages have TF-IDF vectors; a randomised SVD of all of them,
summed up distributedly in one pass over the corpus, gives a latent space; passages whose cosine with an item
is high enough in it are candidates. Items longer than a passage are held against passages in pieces no longer than one, any
of which makes a candidate of the whole item. A candidate counts if in one place of the document the longest common subsequence of words covers
enough of the item, or somewhat less of it and most of its answer.

Pieces are taken in blocks, each with a latent space of its own: BLOCK_ITEMS pieces of WINDOW words are 16,384 words at
most, so a block's sketch has 19 MB at most. Blocks make groups by the bytes of their sketches, whatever the
benchmark's size; a group's texts are tokenised once, and each of the three passes over the word numbers serves all
its blocks. The only shuffles are sums over the blocks' words and the final matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Workspace, slices, table, text_hash, unused

WINDOW, STRIDE = 64, 32
#: Pieces of items (most have one) in a block; random directions beside the pieces' own; bytes of sketches, and of items, in a group.
BLOCK_ITEMS, SPARE, GROUP_BYTES, GROUP_TEXT = 256, 32, 64 << 20, 16 << 20
#: Words in more than this share of the documents have no weight (they'd make long vectors that tell little), but for each piece's KEPT rarest ones.
#: The share is smoothed by PRIOR documents without any of the words, for small corpora in which all words look common.
COMMON, KEPT, PRIOR = 0.02, 8, 500
#: Latent cosine of a candidate, and the share of the piece's latent weight that it carries (one rare word makes a cosine, but carries little).
COSINE, CONTAINED = 0.35, 0.3
#: Share of the item's words in common order; that share if the answer is there; share of the answer.
COVERED, COVERED_WITH_ANSWER, ANSWERED = 0.8, 0.6, 0.8
#: Words at an item's end that are its answer, where it has no question mark.
ANSWER_WORDS = 5

words_of = re.compile(r"\w+").findall


def answer_of(text: str) -> list[str]:
    """The words after the last question mark, else the last words."""
    after = words_of(text.lower().rpartition("?")[2]) if "?" in text else []
    return after or words_of(text.lower())[-ANSWER_WORDS:]


def lcs(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel: ``masks`` has the places of each word of the item."""
    v = full = (1 << size) - 1
    for word in text:
        if m := masks.get(word):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def pieces_of(words: list[int]) -> list[list[int]]:
    """An item's words in even pieces of WINDOW at most: a passage can't carry more."""
    n = max(1, -(-len(words) // WINDOW))
    return [words[i * len(words) // n : (i + 1) * len(words) // n] for i in range(n)]


@dataclass
class Block:
    """Pieces whose latent space is one; ``pieces`` are (item's place in the group, words), numbered within the block, ``words`` the group's numbers of those."""

    pieces: list[tuple[int, list[int]]]
    words: list[int]
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    @classmethod
    def of(cls, pieces: list[tuple[int, list[int]]]) -> Block:
        number: dict[int, int] = {}
        own = [(i, [number.setdefault(w, len(number) + 1) for w in ws]) for i, ws in pieces]
        return cls(own, [0, *number])

    @property
    def rank(self) -> int:
        return len(self.pieces) + SPARE

    def local(self, size: int) -> np.ndarray:
        """The block's number of each of the group's words, 0 for none."""
        out = np.zeros(size, np.int32)
        out[self.words[1:]] = np.arange(1, len(self.words))
        return out

    def weigh(self, df: np.ndarray, documents: int) -> None:
        df = df[self.words]
        common = df > COMMON * (documents + PRIOR)
        for _, ws in self.pieces:
            rarest = sorted(set(ws), key=lambda w: (df[w], w))[:KEPT]
            common[rarest] = False
        common[0] = True
        self.idf = np.where(common, 0, np.log1p(documents / (1 + df))).astype(np.float32)

    def vectors(self, unit: bool = True) -> np.ndarray:
        """The pieces' TF-IDF rows."""
        out = np.zeros((len(self.pieces), len(self.idf)), np.float32)
        for i, (_, ws) in enumerate(self.pieces):
            w, n = np.unique(ws, return_counts=True)
            out[i, w] = (1 + np.log(n)) * self.idf[w]
        return out / np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None] if unit else out

    def latent(self) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' unit rows in the latent space, and their norms there before."""
        out = self.vectors(False) @ self.basis
        weight = np.maximum(np.linalg.norm(out, axis=1), 1e-9)
        return out / weight[:, None], weight


@dataclass
class Group:
    """Items that one tokenisation and three passes serve; words are numbered within the group, 0 is none of them."""

    ids: list
    words: list[list[int]]
    answers: list[list[int]]
    vocabulary: dict[str, int]
    blocks: list[Block]

    @classmethod
    def of(cls, items: list[tuple[object, str]]) -> Group:
        vocabulary: dict[str, int] = {}
        number = lambda ws: [vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws]
        words = [number(words_of(t.lower())) for _, t in items]
        pieces = [(i, piece) for i, ws in enumerate(words) for piece in pieces_of(ws)]
        blocks = [Block.of(pieces[a : a + BLOCK_ITEMS]) for a in range(0, len(pieces), BLOCK_ITEMS)]
        return cls([i for i, _ in items], words, [number(answer_of(t)) for _, t in items], vocabulary, blocks)

    @property
    def size(self) -> int:
        return len(self.vocabulary) + 1

    def locals(self) -> list[np.ndarray]:
        return [b.local(self.size) for b in self.blocks]


def passages(ids: np.ndarray, at: np.ndarray, idf: np.ndarray, stride: int) -> tuple[np.ndarray, ...]:
    """The sparse TF-IDF rows of all passages with a weight: (word, value, where each begins, its document, its first word, its norm).

    ``ids`` are the word numbers of documents end to end, ``at`` where each begins; value is divided by the norm.
    """
    place = np.nonzero(idf[ids] > 0)[0]
    doc = np.searchsorted(at, place, side="right") - 1
    last = (place - at[doc]) // stride
    number = at[doc] // stride + doc + last  # grows with place, and no two documents share one
    if stride < WINDOW:
        before = last > 0
        place, doc, number, last = (np.concatenate([a, b[before]]) for a, b in ((place, place), (doc, doc), (number, number - 1), (last, last - 1)))
    key, first, tf = np.unique(number.astype(np.int64) * len(idf) + ids[place], return_index=True, return_counts=True)
    if not len(key):
        return (*(np.zeros(0, np.int64),) * 6,)
    number, word = key // len(idf), (key % len(idf)).astype(np.int64)
    starts = np.nonzero(np.concatenate(([True], number[1:] != number[:-1])))[0]
    value = ((1 + np.log(tf)) * idf[word]).astype(np.float32)
    norm = np.sqrt(np.add.reduceat(value**2, starts))
    value /= np.repeat(norm, np.diff(np.append(starts, len(value))))
    return word, value, starts, doc[first[starts]], last[first[starts]] * stride, norm


def _documents(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    lists = batch.column(column).to_pylist()
    at = np.cumsum([0, *(len(x) // 4 for x in lists)])
    return np.frombuffer(b"".join(lists), np.int32), at


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield from slices(batch, "words", 1 << 20)


def tokenise(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[str, int]) -> DataFrame:
    """(id, text_hash, words): the number of each word as int32, 0 for words of no item."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [np.array([get(w, 0) for w in words_of(t.lower())] if t else [], np.int32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(rows, pa.binary())], names=["id", "text_hash", "words"])

    rows = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(number, f"id {rows.schema[0].dataType.simpleString()}, text_hash long, words binary")


def document_frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for part in _pieces(batch):
                ids, at = _documents(part, "words")
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                total += np.bincount(np.unique(doc * size + ids) % size, minlength=size)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["word", "n"])

    df = np.zeros(size, np.int64)
    for row in tokens.select("words").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        df[row["word"]] = row["n"]
    return df


def latent_bases(tokens: DataFrame, group: Group, seed: int = 3) -> list[np.ndarray]:
    """For each block the leading right singular vectors of the passages' TF-IDF matrix A, words by rank, from one pass over the corpus.

    The sketch is Y = A'A S, S holding the pieces' directions and random ones; with C = S'Y, the
    singular vectors of Y C^(-1/2) are those of A within the sketch (the Nystrom form of the randomised SVD).
    """
    rng = np.random.default_rng(seed)
    sketches = [np.concatenate([b.vectors(), rng.normal(size=(SPARE, len(b.idf))).astype(np.float32) / np.sqrt(len(b.idf))]).T.copy() for b in group.blocks]
    sent = tokens.sparkSession.sparkContext.broadcast((sketches, [b.idf for b in group.blocks], group.locals()))
    shapes = [s.shape for s in sketches]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(shape, np.float32) for shape in shapes]
        for batch in batches:
            for part in _pieces(batch):
                ids, at = _documents(part, "words")
                for s, idf, local, total in zip(*sent.value, totals, strict=True):
                    word, value, starts, *_ = passages(local[ids], at, idf, WINDOW)
                    if not len(word):
                        continue
                    z = np.add.reduceat(s[word] * value[:, None], starts, axis=0)
                    back = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(word))))
                    order = np.argsort(word, kind="stable")
                    first = np.nonzero(np.concatenate(([True], np.diff(word[order]) != 0)))[0]
                    total[word[order][first]] += np.add.reduceat(z[back[order]] * value[order, None], first, axis=0)
        yield from _sums(totals)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, w, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y = np.frombuffer(y, np.float32).astype(np.float64)
                if (b, w) in totals:
                    totals[b, w] += y
                else:
                    totals[b, w] = y
        places = list(totals)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in places], pa.int32()), pa.array([p[1] for p in places], pa.int64()), pa.array([totals[p].tobytes() for p in places], pa.binary())], names=["block", "word", "y"])

    schema = "block int, word long, y binary"
    ys = [np.zeros(shape) for shape in shapes]
    for row in tokens.select("words").mapInArrow(project, schema).repartition("block", "word").mapInArrow(add, schema).toLocalIterator():
        ys[row["block"]][row["word"]] = np.frombuffer(row["y"], np.float64)
    return [_basis(s, y) for s, y in zip(sketches, ys, strict=True)]


def _sums(totals: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for b, total in enumerate(totals):
        found = np.nonzero(total.any(1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b, np.int32)), pa.array(found), pa.array([total[i].tobytes() for i in found], pa.binary())], names=["block", "word", "y"])


def _basis(sketch: np.ndarray, y: np.ndarray) -> np.ndarray:
    c = sketch.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    kept = values > max(values.max(initial=0), 0) * 1e-7
    if not kept.any():
        return np.zeros((len(sketch), 0), np.float32)
    basis, strength, _ = np.linalg.svd(y @ (vectors[:, kept] / np.sqrt(values[kept])), full_matrices=False)
    return basis[:, strength > strength[0] * 1e-4].astype(np.float32)


def _candidates(z: np.ndarray, length: np.ndarray, norm: np.ndarray, latent: np.ndarray, weight: np.ndarray, owner: np.ndarray, cosine: float) -> Iterator[tuple[int, int]]:
    """(passage, item) where the passage is near enough to one of the item's pieces and carries enough of it."""
    near = z @ latent.T
    p, piece = np.nonzero((near >= cosine * length[:, None]) & (near * norm[:, None] >= CONTAINED * weight))
    yield from np.unique(np.stack([p, owner[piece]], 1), axis=0).tolist()


def holds(covered: float, answered: float) -> bool:
    return covered >= COVERED or covered >= COVERED_WITH_ANSWER and answered >= ANSWERED


class _Search:
    """Items held against places of one document after another; what each task keeps of a group."""

    def __init__(self, group: Group):
        self.group, self.masks, self.answers = group, [_masks(w) for w in group.words], [_masks(w) for w in group.answers]

    def place(self, item: int, near: list[int]) -> tuple[float, float] | None:
        """(covered, answered) of an item in a place that holds it."""
        n = len(self.group.words[item])
        covered = lcs(self.masks[item], n, near) / n
        if covered < COVERED_WITH_ANSWER:
            return None
        m = len(self.group.answers[item])
        answered = lcs(self.answers[item], m, near) / m
        return (covered, answered) if holds(covered, answered) else None

    def best(self, item: int, text: np.ndarray, first: int, tried: set[int]) -> tuple[float, float] | None:
        """Of the places around the passage at ``first`` that hold the item, the one with most of it; places in ``tried`` are done."""
        n, found = len(self.group.words[item]), None
        lo, hi = max(0, first - n), min(len(text), first + WINDOW + n)
        span, step = n + n // 2 + 2, max(1, n // 4)
        lo -= lo % step  # so that the passages of one document look at the same places, each once
        for s in range(lo, max(lo + 1, hi - span + step), step):
            if s in tried:
                continue
            tried.add(s)
            got = self.place(item, text[s : s + span].tolist())
            if got and (found is None or got > found):
                found = got
        return found


def matches_of(tokens: DataFrame, group: Group, cosine: float) -> DataFrame:
    """(id, text_hash, item_id, covered, answered) of the candidates that hold."""
    sent = tokens.sparkSession.sparkContext.broadcast(group)
    item_kind = pa.int64() if all(isinstance(i, int) for i in group.ids) else pa.string()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        held = _Search(g)
        spaces = [(b, local, *b.latent(), np.array([i for i, _ in b.pieces])) for b, local in zip(g.blocks, g.locals(), strict=True)]
        for batch in batches:
            for part in _pieces(batch):
                ids, at = _documents(part, "words")
                best: dict[tuple[int, int], tuple[float, float]] = {}
                tried: dict[tuple[int, int], set[int]] = {}
                for b, local, latent, weight, owner in spaces:
                    word, value, starts, doc, first, norm = passages(local[ids], at, b.idf, STRIDE)
                    if not len(word):
                        continue
                    z = np.add.reduceat(b.basis[word] * value[:, None], starts, axis=0)
                    length = np.maximum(np.linalg.norm(z, axis=1), 1e-9)
                    for p, item in _candidates(z, length, norm, latent, weight, owner, cosine):
                        key = (int(doc[p]), int(item))
                        if best.get(key, (0, 0))[0] == 1:
                            continue
                        got = held.best(item, ids[at[doc[p]] : at[doc[p] + 1]], int(first[p]), tried.setdefault(key, set()))
                        if got and got > best.get(key, (0, 0)):
                            best[key] = got
                if best:
                    rows = part.take(pa.array([d for d, _ in best]))
                    covered, answered = zip(*best.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([g.ids[i] for _, i in best], item_kind), pa.array(covered, pa.float64()), pa.array(answered, pa.float64())], names=["id", "text_hash", "item_id", "covered", "answered"])

    return tokens.mapInArrow(search, f"id {tokens.schema[0].dataType.simpleString()}, text_hash long, item_id {'long' if item_kind == pa.int64() else 'string'}, covered double, answered double")


class _Sketches:
    """Bytes of the sketches that items make as they are added."""

    def __init__(self) -> None:
        self.closed, self.pieces, self.words = 0, 0, set()

    def add(self, words: list[str]) -> int:
        for piece in pieces_of(words):
            if self.pieces == BLOCK_ITEMS:
                self.closed, self.pieces, self.words = self.closed + self._open(), 0, set()
            self.pieces += 1
            self.words.update(piece)
        return self.closed + self._open()

    def _open(self) -> int:
        return 4 * (len(self.words) + 1) * (self.pieces + SPARE)


def groups(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Group]:
    """The items with words, in groups whose sketches and texts have GROUP_BYTES and GROUP_TEXT, and at most an item more. The driver holds one group at a time."""
    items, sketches, size = [], _Sketches(), 0
    for item, text in benchmark.where(F.col(text_col).isNotNull()).select(item_col, text_col).distinct().orderBy(item_col, text_col).toLocalIterator():
        words = words_of(text.lower())
        if not words:
            continue
        items.append((item, text))
        size += len(text)
        if sketches.add(words) > GROUP_BYTES or size > GROUP_TEXT:
            yield Group.of(items)
            items, sketches, size = [], _Sketches(), 0
    if items:
        yield Group.of(items)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """(id, text_hash, item_id, covered, answered): each benchmark item that each document holds.

    ``covered`` is the share of the item's words in common order in the place of the document that holds most of it, ``answered`` that of its answer there.
    Null, empty and wordless texts hold none, and such items are held by none. Whole documents are searched, and very long items
    by their pieces; a document of any length has one task. Equal rows get equal matches, equal items count once; ``text_hash`` tells
    rows of one id with different texts apart. Clean documents have no row. Other columns are not read.
    """
    spark, work, found = docs.sparkSession, Workspace(docs.sparkSession), None
    for i, group in enumerate(groups(benchmark, item_col, item_text_col)):
        tokens = work.write(tokenise(docs, id_col, text_col, group.vocabulary), f"tokens-{i}")
        df, documents = document_frequencies(tokens, group.size), tokens.count()
        for block in group.blocks:
            block.weigh(df, documents)
        for block, basis in zip(group.blocks, latent_bases(tokens, group), strict=True):
            block.basis = basis
        held = work.write(matches_of(tokens, group, cosine), f"held-{i}")
        work.drop(f"tokens-{i}")
        found = held if found is None else found.unionByName(held)
    if found is None:
        found = spark.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, text_hash long, item_id {benchmark.schema[item_col].dataType.simpleString()}, covered double, answered double")
    return found.withColumnRenamed("id", id_col)


def remove_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a benchmark item.

    Null and empty texts stay, as they hold none; of equal rows all go or all stay, and rows of one id are told apart by
    their texts. All columns are kept, whatever their names.
    """
    own, own_hash = unused(docs, "id"), unused(docs, "hash")
    held = found.select(F.col(id_col).alias(own), F.col("text_hash").alias(own_hash)).distinct()
    return docs.join(held, docs[id_col].eqNullSafe(F.col(own)) & (text_hash(text_col) == F.col(own_hash)), "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "answered").distinct()
