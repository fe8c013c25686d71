"""Token counts of byte-level pair encodings, without the token identifiers.

A text is cut into pre-tokens; each distinct pre-token starts as its bytes in a linked list, a heap
holds the adjacent pairs by merge rank and place, and the lowest is merged again and again. The
count is the number of bytes minus the number of merges. Pre-tokens repeat, so a worker remembers
the counts it has made (a bounded memory).

The plan is one map over the rows: no shuffle, and memory bounded by a batch and the vocabulary.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import slices, table

# Fixed value: the pre-token pattern of byte-level encodings, as published with them.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker forgets its counts when it holds so many.
REMEMBERED = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files: itself where it is printable Latin-1, else the next free one from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PairMerger:
    """Counts tokens by the merge list of one vocabulary."""

    def __init__(self, merges: list[tuple[str, str]], specials: list[str]):
        self.symbol = {s: i for i, s in enumerate(byte_symbols())}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            new = self.symbol.setdefault(left + right, len(self.symbol))
            self.merge.setdefault((self.symbol[left], self.symbol[right]), (rank, new))
        self.known: dict[str, int] = {}
        self.find = regex.compile(PRETOKEN).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None

    @classmethod
    def from_file(cls, path: str) -> PairMerger:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in held["model"]["merges"]]
        return cls(merges, [t["content"] for t in held.get("added_tokens", [])])

    def merges(self, word: str) -> int:
        """How many merges the bytes of ``word`` go through."""
        ids = list(word.encode("utf-8", "surrogatepass"))
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(got[0], i, ids[i], ids[i + 1], got[1]) for i in range(n - 1) if (got := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i] if ids[i] == left else n
            if j >= n or ids[j] != right:
                continue  # one of the two is gone
            done += 1
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if got := merge.get((new, ids[k])):
                    heapq.heappush(heap, (got[0], i, new, ids[k], got[1]))
            if (h := before[i]) >= 0 and (got := merge.get((ids[h], new))):
                heapq.heappush(heap, (got[0], h, ids[h], new, got[1]))
        return done

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("find",)} | {"known": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.find = regex.compile(PRETOKEN).findall

    def _plain(self, text: str) -> int:
        known, total = self.known, 0
        words = self.find(text)
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        for word in words:
            count = known.get(word)
            if count is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                count = len(word.encode("utf-8", "surrogatepass")) - self.merges(word)
                if len(word) <= 64:
                    known[word] = count
            total += count
        return total

    def count(self, text: str) -> int:
        """Tokens of ``text``; each special string in it is one token."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each text by the vocabulary file at ``vocabulary``.

    The driver reads the file and sends it along (its size is the vocabulary's, whatever the
    corpus). Null and empty texts have 0 bytes and 0 tokens; whole texts are counted, however long;
    every row stays, repeated ones too; columns other than the two named are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(PairMerger.from_file(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                tokens = [counter.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
