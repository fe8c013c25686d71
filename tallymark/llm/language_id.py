"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are the hashed 3- and 4-byte pieces of its lower-cased letters. Each piece has an
embedding; their average goes through a linear layer and a softmax whose temperature is fitted on
rows kept out of the training. As everything up to the softmax is linear, prediction sums one small
row of scores a piece.

Training reads a bounded sample of labelled rows: the ``sample`` rows of least hash, as counts of
pieces (at most ``BUCKETS`` a row), made by the executors. Prediction is one map over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import safe_id, slices, table, utf8

BUCKETS = 1 << 14
#: Places of a text that are looked at together; a number for each of them and each label is in memory at once, however long the text.
PART = 1 << 17
#: Bound on the labelled rows that the driver trains on.
SAMPLE = 3000
#: Share of rightly predicted rows that rejection may cost, and the highest threshold it may take.
COST, HIGHEST = 0.0005, 0.4
UNKNOWN = "und"
# Bytes of ASCII that are no letters become spaces; those of other letters stay.
_PIECES = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased letters of all texts in one line, other ASCII as spaces, and where each text begins: a space before it and three or more behind."""
    data, at = utf8(pc.utf8_lower(texts))
    n, sizes = len(at) - 1, np.diff(at)
    starts = at[:-1] + 4 * np.arange(n)
    line = np.full(int(at[-1]) + 4 * n + 4, 32, np.uint8)
    for i in range(n):
        np.take(_PIECES, data[at[i] : at[i + 1]], out=line[starts[i] + 1 : starts[i] + 1 + sizes[i]])
    return line, starts


def pieces(texts: pa.Array, part: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, whether each counts, place of the first in ``lines``) of PART places after another. Two buckets a place: its 3 and its 4 bytes on."""
    line, _ = lines(texts)
    part = part or PART
    for a in range(0, len(line) - 3, part):
        here = line[a : a + part + 3]
        wide = here.astype(np.uint32)
        three = wide[:-3] | (wide[1:-2] << 8) | (wide[2:-1] << 16)
        four = three | (wide[3:] << 24)
        shift = np.uint32(32 - 14)
        hashed = np.empty((len(three), 2), np.uint16)
        hashed[:, 0] = (three * np.uint32(2654435761)) >> shift
        hashed[:, 1] = ((four ^ np.uint32(0x5BD1E995)) * np.uint32(2246822519)) >> shift
        yield hashed, here[1:-2] != 32, a  # a piece counts if its second byte is of a letter: a first one may be a space, for beginnings of words


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)


def lines_of(texts: pa.Array) -> np.ndarray:
    """Where each text begins in ``lines``, from the sizes alone."""
    sizes = pc.fill_null(pc.binary_length(pc.utf8_lower(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes + 4) - sizes - 4


def piece_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of some text's pieces, and how many each has."""
    found = np.zeros(BUCKETS, np.int64)
    for hashed, counts, _ in pieces(texts):
        found += np.bincount(hashed[counts].ravel(), minlength=BUCKETS)
    ids = np.nonzero(found)[0]
    return ids, found[ids]


@dataclass
class LanguageModel:
    labels: list[str]
    scores: np.ndarray  # a row of label scores for each bucket
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The best label's place and its calibrated probability for each text."""
        starts = lines_of(texts)
        total, number = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), np.int64)
        for hashed, counts, a in pieces(texts):
            each = self.scores[hashed[:, 0]]
            each += self.scores[hashed[:, 1]]
            each[~counts] = 0
            first = max(int(np.searchsorted(starts, a, "right")) - 1, 0)
            here = starts[first : int(np.searchsorted(starts, a + len(hashed)))]
            cuts = np.maximum(here - a, 0)
            if len(cuts):
                total[first : first + len(cuts)] += np.add.reduceat(each, cuts, axis=0, dtype=np.float64)
                number[first : first + len(cuts)] += np.add.reduceat(counts.astype(np.int64), cuts)
        logits = total / np.maximum(2 * number, 1)[:, None] + self.bias
        p = softmax(logits / self.temperature)
        best = p.argmax(1)
        return best, p[np.arange(len(best)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], names: list[str], width: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Train by stochastic gradient descent; every fifth row only sets the temperature and the threshold. Should the steps be too long for the data, shorter ones are tried."""
    labels = sorted(set(names))
    y = np.array([labels.index(x) for x in names])
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 1 / width, (BUCKETS, width))
    weights, bias = np.zeros((width, len(labels))), np.zeros(len(labels))
    weights += rng.normal(0, 0.1, weights.shape)
    shares = [n / n.sum() for _, n in rows]
    train = [i for i in range(len(rows)) if i % 5] or [*range(len(rows))]
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            ids, share = rows[i][0], shares[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ table_[ids]
            p = softmax((hidden @ weights + bias)[None])[0]
            p[y[i]] -= 1
            back = weights @ p
            weights -= lr * np.outer(hidden, p)
            bias -= lr * 0.1 * p
            table_[ids] -= (lr * len(ids) ** 0.5 * share)[:, None] * back
    if not np.isfinite(table_ @ weights).all() or np.abs(table_ @ weights).max() > 1e6:
        return fit(rows, names, width, epochs, rate / 4, seed)
    held = [i for i in range(len(rows)) if i % 5 == 0]
    logits = np.array([shares[i] @ (table_[rows[i][0]] @ weights) + bias for i in held])
    truth = y[held]

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean())

    temperature = min(np.geomspace(0.1, 10, 61).tolist(), key=loss)
    p = softmax(logits / temperature)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    threshold = min(HIGHEST, float(right[int(len(right) * COST)])) if len(right) else 0.0
    return LanguageModel(labels, (table_ @ weights).astype(np.float32), bias, float(temperature), threshold)


def held_out(id_col: str) -> Column:
    """Rows kept out of the training: crc32 of the id as text, modulo 4, is 2 (a null id counts as empty text)."""
    return F.crc32(safe_id(id_col).cast("binary")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """A model of the labelled rows that aren't held out; None if there are none with a letter.

    It learns from the ``sample`` different rows of least hash, which is also all that reaches the driver, however often a row occurs;
    null labels, null and empty texts and those without a letter take no part. Other columns are not read.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(id_col) & F.col(text_col).rlike(r"\p{L}"))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(safe_id(id_col), F.col(text_col), F.col(lang_col)).alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [piece_counts(batch.column(0).slice(i, 1)) for i in range(len(batch))]
            yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.int32).tobytes() for i, _ in out]), pa.array([n.astype(np.int32).tobytes() for _, n in out]), *batch.columns[1:]], names=["ids", "n", "lang", "h"])

    # the hash alone decides which rows: texts are looked at for the chosen ones only, and of equal rows one is fetched
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return None
    chosen = rows.where(F.col("h") <= last).mapInArrow(count, "ids binary, n binary, lang string, h long")
    got = chosen.groupBy("h").agg(*[F.first(c).alias(c) for c in ("ids", "n", "lang")]).collect()
    got = sorted(got, key=lambda r: (r["h"], r["lang"]))
    features = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["n"], np.int32)) for r in got]
    kept = [i for i, f in enumerate(features) if len(f[0])]
    return fit([features[i] for i in kept], [got[i]["lang"] for i in kept]) if kept else None


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, rejected) of each document.

    ``lang_pred`` is a learned label, or ``und`` with score 0 where the text is null or has no
    letter (or nothing could be learned). ``rejected`` marks those, and texts whose calibrated score is below the
    model's threshold. Whole texts are read, however long; every row stays; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels numbers, whatever the corpus

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text")
                letter = has_letter(texts)
                if known is None:
                    best, score = np.zeros(len(part), int), np.zeros(len(part))
                    letter[:] = False
                else:
                    best, score = known.predict(pc.fill_null(texts, ""))
                names = np.array([*(known.labels if known else []), UNKNOWN], object)
                score = np.where(letter, score, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names[np.where(letter, best, len(names) - 1)], pa.string()), pa.array(score), pa.array(~(letter & (score >= (known.threshold if known else 1))))],
                    names=[id_col, "held_out", "lang_pred", "score", "rejected"],
                )

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``identify`` rejects; one map over the rows, which keeps all their columns, whatever their names.

    Null and empty texts and those without a letter go, as do all where nothing could be learned; equal rows go or stay together.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                texts = part.column(text_col)
                fine = has_letter(texts)
                fine &= known.predict(pc.fill_null(texts, ""))[1] >= known.threshold if known else False
                yield part.filter(pa.array(fine))

    return docs.mapInArrow(keep, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
