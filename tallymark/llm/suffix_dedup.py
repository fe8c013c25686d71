"""Removal of repeated passages by sorted suffixes.

A passage of ``LENGTH`` bytes that also starts elsewhere is to go, whatever documents it is in.
Sorting a suffix for every byte would move the corpus two hundredfold, so only suffixes that can matter
are moved: every window of LENGTH bytes has an anchor, the place of the least hash among its grams
of ``GRAM`` bytes, which depends on the window's bytes alone. Equal windows have equal anchors at equal offsets.

1. Anchors are made for all texts (one per about eighty bytes), and grams that occur once are dropped
   by a count over all of them. An anchor's context is all the windows that have it.
2. Of each different context (by a 128-bit digest) one occurrence is fetched with its bytes, and a second one where there are more.
   They are range-partitioned by the suffix at the anchor, with sampled splitters, and each bucket sorts them by
   multikey quicksort. Two of one digest must be the same bytes there, which makes all windows of that context repeated;
   if they aren't, all is done again with a longer digest. Where a gram has several contexts, the suffixes of all their
   windows are sorted too, and equal neighbours repeat.
3. The first and the last gram of a bucket may go on in the next one: their windows are compared across
   buckets by 128-bit hashes, packed by slots of the hash, so that a very common gram is spread over all tasks in few rows.

Every shuffle has plain rows of anchors or of texts; groups are only counted, never gathered, and
documents meet their own spans only.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Workspace, distinct_rows, slices, table, utf8

LENGTH, GRAM = 200, 40
#: Bytes that a worker looks at together; contexts in a bucket.
CHUNK, BUCKET = 1 << 18, 10_000
#: Bytes of a suffix that splitters look at; no fewer than a gram.
LEADING = 96
#: Bits of a context's digest to begin with; all 128 unless a test weakens it.
DIGEST_BITS = 128
#: Suffixes below which a part is sorted by whole remainders.
SMALL = 2048
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_U = np.uint64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i up to n (an odd base has an inverse)."""
    if base not in _powers or len(_powers[base][0]) <= n:
        n = max(n, 1 << 16)
        up, down = np.full(n + 1, base, _U), np.full(n + 1, pow(base, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up), np.cumprod(down)
    return _powers[base]


class Rolling:
    """Polynomial hashes modulo 2 ** 64 of any part of some bytes."""

    def __init__(self, data: np.ndarray, base: int):
        up, self.down = _power_table(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by running minima of blocks from both ends."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def digests(data: np.ndarray, start: np.ndarray, stop: np.ndarray, back: np.ndarray, bits: int) -> np.ndarray:
    """Two 64-bit numbers for each part of ``data`` and the place of the anchor in it; of ``bits`` bits in all."""
    view, digest = memoryview(data), hashlib.blake2b
    each = [digest(view[a:b], digest_size=16, salt=n.to_bytes(2, "little")).digest() for a, b, n in zip(start.tolist(), stop.tolist(), back.tolist(), strict=True)]
    out = np.frombuffer(b"".join(each), _U).reshape(-1, 2).copy()
    for i, kept in enumerate((min(bits, 64), max(bits - 64, 0))):
        out[:, i] &= _U((1 << kept) - 1)
    return out


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, gram hash, anchor, first window, last window) of the texts data[at[i]:at[i + 1]] laid end to end; places are in ``data``."""
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < length:
        return none
    rolling = Rolling(data, BASES[0])
    n = len(data) - gram + 1
    grams = mixed(rolling.of(slice(0, n), slice(gram, gram + n)))
    least = sliding_minimum((grams & _U(0xFFFFFFFF00000000)) | np.arange(n, dtype=_U), length - gram + 1)
    sizes = np.diff(at)
    enough = np.nonzero(sizes >= length)[0]
    if not len(enough):
        return none
    counts = sizes[enough] - length + 1
    text = np.repeat(enough, counts)
    window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(at[enough], counts)
    place = (least[window] & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.nonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))[0]
    last = np.append(first[1:], len(place)) - 1
    return text[first], grams[place[first]], place[first], window[first], window[last]


def _parts(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row, start in the row's text) of some texts; long ones are cut, each cut window staying in one part."""
    data, at = utf8(batch.column("text"))
    parts, size = [], 0
    for row in np.nonzero(np.diff(at) >= length)[0].tolist():
        a, b = int(at[row]), int(at[row + 1])
        while a + length <= b:
            stop = min(b, a + CHUNK + length - 1)
            parts.append((row, a, stop))
            size += stop - a
            if size >= CHUNK:
                yield _laid(data, at, parts)
                parts, size = [], 0
            a = stop - length + 1
    if parts:
        yield _laid(data, at, parts)


def _laid(data: np.ndarray, at: np.ndarray, parts: list[tuple[int, int, int]]):
    rows = np.array([p[0] for p in parts])
    return np.concatenate([data[a:b] for _, a, b in parts]), np.cumsum([0, *(b - a for _, a, b in parts)]), rows, np.array([p[1] for p in parts]) - at[rows]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def gram_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram): the hash of the gram at each anchor."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, _, _ in _parts(batch, length):
                yield pa.RecordBatch.from_arrays([_signed(anchors(data, at, length, gram)[1])], names=["gram"])

    return docs.select("text").mapInArrow(make, "gram long")


def anchor_rows(docs: DataFrame, length: int, gram: int, bits: int) -> DataFrame:
    """(gram, c1, c2, id, hash, spot): the context's digest; spot packs the anchor's place in the text and how far before it the first and last window begin."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, rows, begin in _parts(batch, length):
                text, g, x, lo, hi = anchors(data, at, length, gram)
                if not len(text):
                    continue
                c = digests(data, lo, hi + length, x - lo, bits)
                spot = ((x - at[text] + begin[text]) << 16) | ((x - lo) << 8) | (x - hi)
                own = pa.array(rows[text])
                yield pa.RecordBatch.from_arrays([_signed(g), _signed(c[:, 0]), _signed(c[:, 1]), batch.column("id").take(own), batch.column("hash").take(own), pa.array(spot)], names=["gram", "c1", "c2", "id", "hash", "spot"])

    return docs.mapInArrow(make, f"gram long, c1 long, c2 long, id {docs.schema['id'].dataType.simpleString()}, hash long, spot long")


def _unpack(spot):
    """(anchor, first window, last window) of a packed spot."""
    x = spot >> 16
    return x, x - ((spot >> 8) & 255), x - (spot & 255)


def multikey_quicksort(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[at[i]:at[i] + length], and for each of the order whether it equals the one before.

    Three-way partition by a pivot on eight bytes at a time; a part that equals the pivot goes on with
    the next eight. Small parts are sorted by their remaining bytes at once.
    """
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    words = np.zeros(len(data) + length, _U)
    for j in range(8):
        words |= padded[j : j + len(words)].astype(_U) << _U(56 - 8 * j)
    windows = np.lib.stride_tricks.sliding_window_view(padded, length)
    order, same = np.empty(len(at), np.int64), np.zeros(len(at), bool)
    todo, done = [(np.arange(len(at)), 0)], 0
    while todo:
        part, depth = todo.pop()
        if depth >= length:
            order[done : done + len(part)] = part
            same[done + 1 : done + len(part)] = True
        elif len(part) <= SMALL:
            rest = np.ascontiguousarray(windows[at[part]][:, depth:])
            by = np.argsort(rest.view(f"S{rest.shape[1]}").ravel(), kind="stable")
            order[done : done + len(part)] = part[by]
            same[done + 1 : done + len(part)] = (rest[by[1:]] == rest[by[:-1]]).all(1)
        else:
            key = words[at[part] + depth]
            if depth + 8 > length:
                key = key >> _U(8 * (depth + 8 - length))
            sample = np.sort(key[:: max(1, len(key) // 63)])
            pivot = sample[len(sample) // 2]
            # taken from the end: the smaller ones first
            todo += [(p, d) for p, d in ((part[key > pivot], depth), (part[key == pivot], depth + 8), (part[key < pivot], depth)) if len(p)]
            continue
        done += len(part)
    return order, same


def _ranges(places: np.ndarray) -> bytes:
    """Runs of ascending numbers as pairs (first, last) of int16."""
    cut = np.nonzero(np.diff(places) != 1)[0]
    return np.stack([places[np.append(0, cut + 1)], places[np.append(cut, len(places) - 1)]], 1).astype(np.int16).tobytes()


BUCKET_SCHEMA = "c1 long, c2 long, ranges binary, slot int, packed binary"
#: A window sent to be compared across buckets, and an answer; place -1: no answer is needed.
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("c1", "<i8"), ("c2", "<i8"), ("place", "<i4")])
ANSWER = np.dtype([("c1", "<i8"), ("c2", "<i8"), ("place", "<i4")])


def _packed(records: np.ndarray, slots: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The records of each slot, end to end."""
    order = np.argsort(slots, kind="stable")
    records, slots = records[order], slots[order]
    cuts = [0, *(np.nonzero(np.diff(slots))[0] + 1).tolist(), len(slots)]
    return slots[cuts[:-1]].tolist(), [records[a:b].tobytes() for a, b in itertools.pairwise(cuts)]


def _by_slot(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The records of each slot together, from rows (slot, packed) in the slots' order."""
    slot, held = None, []
    for batch in batches:
        for s, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if s != slot:
                if held:
                    yield np.frombuffer(b"".join(held), kind)
                slot, held = s, []
            held.append(packed)
    if held:
        yield np.frombuffer(b"".join(held), kind)


def shared_windows(slots: int):
    """Rows (slot, packed windows) to (slot, packed answers): windows that more than one bucket has sent."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sent in _by_slot(batches, WINDOW):
            sent = sent[np.lexsort((sent["h2"], sent["h1"]))]
            same = (sent["h1"][1:] == sent["h1"][:-1]) & (sent["h2"][1:] == sent["h2"][:-1])
            shared = (np.append(False, same) | np.append(same, False)) & (sent["place"] >= 0)
            if shared.any():
                out = np.empty(int(shared.sum()), ANSWER)
                for name in ANSWER.names:
                    out[name] = sent[name][shared]
                to, packed = _packed(out, (mixed(np.ascontiguousarray(out["c1"]).view(_U)) % _U(slots)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(packed, pa.binary())], names=["slot", "packed"])

    return meet


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, packed answers) to the repeated windows of each context."""
    for got in _by_slot(batches, ANSWER):
        got = got[np.lexsort((got["place"], got["c2"], got["c1"]))]
        cuts = np.nonzero((np.diff(got["c1"]) != 0) | (np.diff(got["c2"]) != 0))[0] + 1
        spans = list(itertools.pairwise([0, *cuts.tolist(), len(got)]))
        first = [a for a, _ in spans]
        yield pa.RecordBatch.from_arrays([pa.array(got["c1"][first]), pa.array(got["c2"][first]), pa.array([_ranges(got["place"][a:b]) for a, b in spans], pa.binary())], names=["c1", "c2", "ranges"])


def _confirmed(c1: np.ndarray, c2: np.ndarray, back: np.ndarray, lists: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each different context, whether its windows repeat as a whole): second occurrences with the first one's bytes are dropped."""
    order = np.lexsort((kind, c2, c1))
    kept, whole = np.ones(len(kind), bool), kind == AGAIN
    for i, j in itertools.pairwise(order.tolist()):
        if kind[i] == kind[j] == TWO and c1[i] == c1[j] and c2[i] == c2[j] and kept[i] and back[i] == back[j] and lists[i] == lists[j]:
            kept[j], whole[i] = False, True
    return kept, whole


def bucket_repeats(length: int, gram: int, slots: int):
    """Rows (bytes, back, c1, c2, kind) of one bucket to: all of a context that was found twice, the repeated windows of each lone one, and the different windows of the first and last gram.

    Of the latter, those that repeat in the bucket need no answer.
    """

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not sum(map(len, got)):
            return
        held = pa.Table.from_batches(got).combine_chunks()
        lists = held.column("bytes").to_pylist()
        back, c1, c2, kind = (held.column(n).to_numpy() for n in ("back", "c1", "c2", "kind"))
        kept, whole = _confirmed(c1, c2, back, lists, kind)
        if whole.any():
            yield _found(c1[whole], c2[whole], [_ranges(np.arange(n)) for n in np.array([len(b) for b in lists])[whole] - length + 1])
        lists, back, c1, c2, kind, whole = [b for b, k in zip(lists, kept.tolist(), strict=True) if k], back[kept], c1[kept], c2[kept], kind[kept], whole[kept]
        size = np.array([len(b) for b in lists])
        data = np.frombuffer(b"".join(lists), np.uint8)
        at = np.cumsum(size) - size
        # contexts by the gram at their anchors; a gram's windows are sorted if they could meet others that don't repeat for certain
        order, same = multikey_quicksort(data, at + back, gram)
        run = np.empty(len(order), np.int64)
        run[order] = np.cumsum(~same) - 1
        number, alone = np.bincount(run), np.bincount(run, weights=~whole)
        edge = (run == 0) | (run == run.max())
        open_ = np.nonzero(((number > 1) & (alone > 0))[run] | edge)[0]
        counts = size[open_] - length + 1
        row = np.repeat(open_, counts)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        order, same = multikey_quicksort(data, at[row] + place, length)
        repeated = whole[row]
        near = np.zeros(len(row), bool)
        near[order] = same | np.append(same[1:], False)
        found = np.nonzero(near & (kind[row] == LONE))[0]
        repeated |= near | (kind[row] != LONE)
        if len(found):
            rows = row[found]
            cuts = [0, *(np.nonzero(np.diff(rows))[0] + 1).tolist(), len(rows)]
            own = rows[cuts[:-1]]
            yield _found(c1[own], c2[own], [_ranges(place[found[a:b]]) for a, b in itertools.pairwise(cuts)])
        heads_of_runs = order[~same]
        sent = heads_of_runs[edge[row[heads_of_runs]]]
        if len(sent):
            r, p = row[sent], place[sent]
            starts = at[r] + p
            out = np.empty(len(sent), WINDOW)
            out["h1"], out["h2"] = (mixed(Rolling(data, b).of(starts, starts + length)) for b in BASES)
            out["c1"], out["c2"], out["place"] = c1[r], c2[r], np.where(repeated[sent], -1, p)
            to, packed = _packed(out, (out["h1"] % _U(slots)).astype(np.int64))
            none = pa.nulls(len(to), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(to), pa.binary()), pa.array(to, pa.int32()), pa.array(packed, pa.binary())], names=["c1", "c2", "ranges", "slot", "packed"])

    return sort


def _found(c1: np.ndarray, c2: np.ndarray, ranges: list[bytes]) -> pa.RecordBatch:
    n = len(c1)
    return pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), pa.array(ranges, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["c1", "c2", "ranges", "slot", "packed"])


#: How a fetched context occurs: alone, as one of two that stand for all, or in a row that itself occurs again.
LONE, TWO, AGAIN = 0, 1, 2


def fetch_contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(bytes, back, c1, c2, kind) of the contexts (c1, c2, kind, id, hash, spot) in ``wanted``; ``docs`` has no row twice, and texts meet the list of their own."""
    lists = wanted.groupBy("id", "hash").agg(F.collect_list(F.struct("c1", "c2", "kind", "spot")).alias("spots")).hint("shuffle_hash")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(slices(b, "text") for b in batches):
            out: list[tuple] = []
            for text, spots in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spots"), strict=True):
                spots = spots.values
                x, lo, hi = (v.tolist() for v in _unpack(spots.field("spot").to_numpy()))
                for a, b, n, *own in zip(lo, hi, x, *(spots.field(f).to_pylist() for f in ("c1", "c2", "kind")), strict=True):
                    out.append((text[a : b + length], n - a, *own))
                    if len(out) == 5_000:
                        yield _fetched(out)
                        out = []
            if out:
                yield _fetched(out)

    own = docs.withColumnRenamed("id", "id_").withColumnRenamed("hash", "hash_")
    joined = own.join(lists, F.col("id_").eqNullSafe(F.col("id")) & (F.col("hash_") == F.col("hash"))).select("text", "spots")
    return joined.mapInArrow(cut, "bytes binary, back int, c1 long, c2 long, kind int")


def _fetched(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bytes", "back", "c1", "c2", "kind"])


def _cut_spans(length: int, names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in itertools.chain.from_iterable(slices(b, "text") for b in batches):
            out = []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text = text or b""
                runs: list[list[int]] = []
                for s in sorted(spans or ()):
                    first, last = s >> 32, (s & 0xFFFFFFFF) + length
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], last)
                    else:
                        runs.append([first, last])
                kept = b"".join(text[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(text)], strict=True))
                out.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept)[: len(names) - 1])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())[: len(names) - 1]
            columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return cut


def repeated_contexts(rows: DataFrame, left: DataFrame, length: int, gram: int, work: Workspace) -> DataFrame | None:
    """(c1, c2, first, last): the windows that repeat of each context in ``left``, counted from its first one; None if two contexts share a digest."""
    place = F.struct("id", "hash", "spot")
    contexts = work.write(left.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("other")), "contexts")
    same = F.col("one").eqNullSafe(F.col("other"))
    kind = F.when(F.col("n") == 1, F.lit(LONE)).when(same, F.lit(AGAIN)).otherwise(F.lit(TWO))
    wanted = contexts.select("c1", "c2", kind.alias("kind"), F.explode(F.when(same, F.array("one")).otherwise(F.array("one", "other"))).alias("at")).select("c1", "c2", "kind", "at.*")
    fetched = work.write(fetch_contexts(rows, wanted, length), "fetched")
    buckets = max(1, -(-fetched.count() // BUCKET))
    # the suffix at the anchor by its leading bytes; the hash splits what has them in common, but not equal contexts
    leading = F.substr(F.col("bytes"), F.col("back") + 1, F.lit(LEADING))
    sorted_ = work.write(fetched.repartitionByRange(buckets, leading, F.xxhash64("bytes")).mapInArrow(bucket_repeats(length, gram, buckets), BUCKET_SCHEMA), "sorted")
    work.drop("fetched")
    dealt = lambda df: df.select("slot", "packed").repartition("slot").sortWithinPartitions("slot")
    answers = dealt(sorted_.where("slot is not null")).mapInArrow(shared_windows(buckets), "slot int, packed binary")
    across = dealt(answers).mapInArrow(_gather, "c1 long, c2 long, ranges binary")
    pair = "array<struct<first: int, last: int>>"
    found = sorted_.where("ranges is not null").select("c1", "c2", "ranges").unionByName(across).mapInArrow(_read_ranges, f"c1 long, c2 long, ranges {pair}")
    found = work.write(found.select("c1", "c2", F.inline("ranges")), "found")
    several = contexts.where("n > 1").select("c1", "c2")
    missed = several.join(found, ["c1", "c2"], "left_anti")
    return found if missed.isEmpty() else None


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, with_kept: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each document; without ``kept``, if not asked for.

    Each byte that is covered by a string of ``length`` bytes which starts anywhere else too, in the
    same document or another, is removed; strings are judged on the input. ``kept`` holds the bytes left, which need
    not be whole characters. Null texts are empty; texts shorter than ``length`` lose nothing; equal rows are copies of each other, so long ones
    lose everything, and of any number of them one is fetched and all get one list of spans; null ids are kept apart by their texts. A very long
    text is cut by one task, with a list of spans of a tenth of its size. Other columns are not read.
    """
    if not gram <= LEADING or not gram < length <= 256:
        raise ValueError(f"the gram must be shorter than the length and {LEADING + 1}, the length 256 bytes at most")
    work = Workspace(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))
    # written, so that the join is one of two plain sides and a very common gram can be split
    twice = work.write(gram_rows(rows, length, gram).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "twice")
    once, found = distinct_rows(rows, work), None
    for bits in dict.fromkeys((DIGEST_BITS, 128)):
        left = work.write(anchor_rows(rows, length, gram, bits).join(twice, "gram").drop("gram"), "anchors")
        found = repeated_contexts(once, left, length, gram, work)
        if found is not None:
            break
    if found is None:
        raise RuntimeError("different passages have one 128-bit digest")
    lo = F.shiftright("spot", 16) - F.shiftright("spot", 8).bitwiseAND(F.lit(255))
    spans = left.join(found, ["c1", "c2"]).select("id", "hash", (F.shiftleft(lo + F.col("first"), 32) + lo + F.col("last")).alias("span"))
    spans = spans.groupBy("id", "hash").agg(F.collect_set("span").alias("spans")).withColumnRenamed("id", "id_").withColumnRenamed("hash", "hash_").hint("shuffle_hash")
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")), "left").select("id", "text", "spans")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_kept else [])]
    return work.write(joined.mapInArrow(_cut_spans(length, names), f"`{id_col}` {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept), "cut")


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        lists = [[{"first": int(a), "last": int(b)} for a, b in np.frombuffer(r, np.int16).reshape(-1, 2)] for r in batch.column("ranges").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("c1"), batch.column("c2"), pa.array(lists, kind)], names=["c1", "c2", "ranges"])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
