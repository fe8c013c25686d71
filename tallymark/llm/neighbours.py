"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search in it.

Equal vectors are one node. The graph starts from neighbours within short blocks of a few orders of
the nodes by random projections, and then improves in rounds of Spark joins: the neighbours of a node, forwards
and backwards, meet at that node with their vectors, and each pair of them that is closer than what
either has becomes a candidate edge; rounds go on until few edges change. Queries start from their own node and expand the
closest unexpanded nodes of their beams, again by joins, until a beam has no unexpanded node left.

Every shuffle is linear in the number of nodes: K + REVERSE rows with a coded vector each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm.common import Workspace, table

#: Neighbours kept for a node; backward neighbours that join in a round, and that a search follows; orders to start from, their blocks, and neighbours taken from each.
K, REVERSE, ORDERS, BLOCK, FIRST = 40, 20, 4, 2048, 20
#: Signs of random projections that make a code: ORDERS x 2 ** BITS codes at most.
BITS = 16
#: Rounds of improvement end when fewer than this share of the edges change.
SETTLED = 0.02
#: Beam of a query, and nodes expanded in a step; steps go on until a beam has none to expand.
BEAM, EXPAND = 256, 64


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors that aren't null, empty or zero and hold finite numbers only, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def _top(edges: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark also limits the groups before the shuffle, so none is gathered whole."""
    return edges.withColumn("rank_", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank_") <= n).drop("rank_")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float32)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, about; from the middle of ``b``, as a far origin would cost digits."""
    middle = b.mean(0, dtype=np.float64).astype(np.float32)
    a, b = a - middle, b - middle
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each value of the first column together, from batches in its order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if a == b:
                continue
            if held and held[0].column(0)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def _edges(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d.astype(np.float64))], names=["a", "b", "d"])


EDGE = "a long, b long, d double"


def centre(nodes: DataFrame, dims: int) -> np.ndarray:
    """The mean vector: a sum from each task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims), 0
        for batch in batches:
            total += _matrix(batch.column(0), dims).sum(0, dtype=np.float64)
            n += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["one", "total", "n"])

    sums = nodes.select("v").mapInArrow(add, "one int, total array<double>, n long").groupBy("one").agg(*[F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(dims)], F.sum("n").alias("n")).first()
    return np.array([sums[f"s{i}"] for i in range(dims)]) / max(sums["n"], 1) if sums else np.zeros(dims)


def starting_edges(nodes: DataFrame, dims: int, mean: np.ndarray, work: Workspace, seed: int = 11) -> DataFrame:
    """Candidate edges (a, b, d): the nearest within blocks of nodes that lie next to each other by random projections.

    A block is a run of codes, in their order, with BLOCK nodes or more; a code of very many nodes is split by a hash of them. So blocks
    are bounded, and follow from the nodes alone.
    """
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(ORDERS, BITS, dims)).astype(np.float32)
    mean = mean.astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), dims) - mean
            for o in range(ORDERS):
                code = ((m @ planes[o].T > 0) << np.arange(BITS)[::-1]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), o, np.int32)), pa.array(code.astype(np.int32)), batch.column(0)], names=["o", "code", "node"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids, m = group.column("node").to_numpy(zero_copy_only=False), _matrix(group.column("v"), dims)
            kept = min(FIRST, len(ids) - 1)
            for s in range(0, len(ids) if kept else 0, BLOCK):
                d = _squares(m[s : s + BLOCK], m)
                d[np.arange(len(d)), s + np.arange(len(d))] = np.inf
                best = np.argpartition(d, kept - 1, axis=1)[:, :kept]
                yield _edges(np.repeat(ids[s : s + BLOCK], kept), ids[best].ravel(), np.take_along_axis(d, best, 1).ravel())

    placed = work.write(nodes.mapInArrow(place, "o int, code int, node long"), "placed")
    # at most ORDERS * 2 ** BITS rows, 262,144, however many nodes there are
    codes = placed.groupBy("o", "code").agg(F.count("*").alias("n"))
    before = Window.partitionBy("o").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    codes = codes.withColumn("block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BLOCK)).withColumn("parts", F.ceil(F.col("n") / (2 * BLOCK)))
    grouped = placed.join(F.broadcast(codes), ["o", "code"]).select(F.xxhash64("o", "block", F.when(F.col("parts") > 1, F.struct(F.col("code"), F.pmod(F.xxhash64("node"), F.col("parts"))))).alias("group"), "node")
    dealt = grouped.join(nodes, "node").select("group", "node", "v").repartition("group").sortWithinPartitions("group", "node")
    return dealt.mapInArrow(near, EDGE)


def _pairs(dims: int):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (node, u, far, fresh, scale, code): pairs of neighbours of a node that either would rather have."""
        out: list[tuple] = []
        size = 0
        for group in _groups(batches):
            u, first = np.unique(group.column(1).to_numpy(zero_copy_only=False), return_index=True)
            if len(u) < 2:
                continue
            far = group.column(2).to_numpy(zero_copy_only=False)[first]
            fresh = group.column(3).to_numpy(zero_copy_only=False)[first].astype(bool)
            m = (_matrix(group.column(5), dims)[first] * group.column(4).to_numpy(zero_copy_only=False)[first, None]).astype(np.float32)
            d = _squares(m, m)
            np.fill_diagonal(d, np.inf)
            i, j = np.nonzero((d < far[:, None]) & (fresh[:, None] | fresh[None, :]))
            out.append((u[i], u[j], d[i, j]))
            size += len(i)
            if size > 100_000:
                yield _edges(*(np.concatenate(x) for x in zip(*out, strict=True)))
                out, size = [], 0
        if out:
            yield _edges(*(np.concatenate(x) for x in zip(*out, strict=True)))

    return join


def neighbour_graph(nodes: DataFrame, dims: int, work: Workspace, k: int = K, reverse: int = REVERSE, settled: float = SETTLED) -> DataFrame:
    """(a, b, d): about the k nearest nodes b of each node a of ``nodes`` (node, v array<float>), d the squared distance."""
    # in the rounds a vector is what parts it from the mean, in steps of a 32,767th of the largest component: half the bytes
    mean = centre(nodes, dims)
    apart = nodes.select(F.col("node").alias("u"), F.zip_with("v", F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m).alias("x"))
    scale = F.greatest(F.array_max(F.transform("x", lambda x: F.abs(x))), F.lit(1e-30)) / 32767
    codes = apart.select("u", scale.cast("float").alias("scale"), F.transform("x", lambda x: F.round(x / scale).cast("short")).alias("code"))
    codes = work.write(codes, "codes")
    graph = work.write(_top(starting_edges(nodes, dims, mean, work).groupBy("a", "b").agg(F.min("d").alias("d")), "a", ["d", "b"], k).withColumn("fresh", F.lit(True)), "graph-0")
    for i in itertools.count(1):
        far = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("far")).withColumnRenamed("a", "u")
        back = _top(graph.select(F.col("b").alias("node"), F.col("a").alias("u"), "fresh"), "node", [F.desc("fresh"), F.xxhash64("u", F.lit(i))], reverse)
        meet = graph.select(F.col("a").alias("node"), F.col("b").alias("u"), "fresh").unionByName(back)
        full = meet.join(codes.join(far, "u", "left"), "u")
        full = full.select("node", "u", F.coalesce("far", F.lit(float("inf"))).alias("far"), "fresh", "scale", "code").repartition("node").sortWithinPartitions("node")
        found = full.mapInArrow(_pairs(dims), EDGE).groupBy("a", "b").agg(F.min("d").alias("d"))
        both = graph.select("a", "b", "d", F.lit(False).alias("fresh")).unionByName(found.select("a", "b", "d", F.lit(True).alias("fresh")))
        both = both.groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
        graph = work.write(_top(both, "a", ["d", "b"], k), f"graph-{i}")
        work.drop(f"graph-{i - 1}")
        changed = graph.agg(F.count("*").alias("n"), F.count_if("fresh").alias("fresh")).first()
        if changed["fresh"] <= settled * changed["n"]:
            return graph.select("a", "b", "d")


def search(asked: DataFrame, nodes: DataFrame, links: DataFrame, work: Workspace, n: int) -> DataFrame:
    """(q, b, d): the nodes nearest to each q of ``asked`` (q, qv) that a greedy search along ``links`` (a, b) finds, exactly measured."""
    short = nodes.select(F.col("node").alias("b"), F.col("v").cast("array<float>").alias("v"))
    briefly = asked.select("q", F.col("qv").cast("array<float>").alias("qv"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                dims = len(batch.column(2)[0])
                d = ((_matrix(batch.column(2), dims) - _matrix(batch.column(3), dims)) ** 2).sum(1, dtype=np.float64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(d)], names=["q", "b", "d"])

    measured = lambda pairs: pairs.join(short, "b").join(briefly, "q").select("q", "b", "v", "qv").mapInArrow(measure, "q long, b long, d double")
    beam = work.write(asked.select("q", F.col("q").alias("b"), F.lit(0.0).alias("d"), F.lit(False).alias("done")), "beam-0")
    for i in itertools.count(1):
        front = work.write(_top(beam.where("not done"), "q", ["d", "b"], EXPAND).select("q", F.col("b").alias("a")), f"front-{i}")
        if front.isEmpty():
            break
        reached = front.join(links, "a").select("q", "b").distinct().join(beam.select("q", "b"), ["q", "b"], "left_anti")
        opened = beam.join(front.select("q", F.col("a").alias("b"), F.lit(True).alias("now")), ["q", "b"], "left").select("q", "b", "d", (F.col("done") | F.coalesce("now", F.lit(False))).alias("done"))
        # a node that has left the beam may come again, but what it was measured against has only come closer
        beam = work.write(_top(opened.unionByName(measured(reached).withColumn("done", F.lit(False))), "q", ["d", "b"], BEAM), f"beam-{i}")
        work.drop(f"beam-{i - 1}")
    last = _top(beam, "q", ["d", "b"], 2 * n).select("q", "b").join(nodes.withColumnRenamed("node", "b"), "b").join(asked, "q")
    return last.select("q", "b", distance(F.col("qv"), F.col("v")).alias("d"))


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", n: int = 10, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the n nearest rows found for each row that ``is_query`` (over vec_id) holds for.

    Nearest first, ties by smaller id, the Euclidean distance in double precision on the original
    vectors; the row's own id is no candidate. Vectors that are null, empty, zero or hold nulls or numbers that aren't
    finite take no part, nor do null ids; vectors of different lengths have no distance, so each length is searched by itself. Equal (id, vector) rows
    count once. Columns other than the two named are not read.
    """
    spark, found = rows.sparkSession, None
    valid = Workspace(spark).write(valid_vectors(rows, id_col, vector_col), "valid")
    for dims in [r[0] for r in valid.groupBy(F.size("v").alias("dims")).agg(F.count("*")).orderBy("dims").select("dims").toLocalIterator()]:
        got = _nearest_of_length(valid.where(F.size("v") == dims), dims, is_query, Workspace(spark), n, k)
        found = got if found is None else found.unionByName(got)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _nearest_of_length(valid: DataFrame, dims: int, is_query: Column, work: Workspace, n: int, k: int) -> DataFrame:
    # one node a distinct vector, named by its least id; of its members the n + 1 least ids can be in a result
    nodes = work.write(valid.groupBy("v").agg(F.min("vec_id").alias("node")), "nodes")
    member = work.write(valid.join(nodes, "v").select("node", "vec_id").distinct(), "member")
    shown = _top(member, "node", ["vec_id"], n + 1)
    graph = neighbour_graph(nodes.select("node", F.col("v").cast("array<float>").alias("v")), dims, work, k)
    # a search follows a node's own edges, and of the others that lead to it the shortest: many may lead to a hub
    own = graph.select("a", "b")
    others = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "d").join(own, ["a", "b"], "left_anti")
    links = work.write(own.unionByName(_top(others, "a", ["d", "b"], REVERSE).select("a", "b")), "links")
    asked = member.where(is_query).select(F.col("node").alias("q")).distinct()
    asked = work.write(asked.join(nodes.withColumnRenamed("node", "q").withColumnRenamed("v", "qv"), "q"), "asked")
    beam = search(asked, nodes, links, work, n)
    queries = member.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("node").alias("q"))
    hits = queries.join(beam, "q").select("query_id", F.col("b").alias("node"), "d").join(shown, "node").where("vec_id <> query_id")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).where(F.col("rank") <= n)
    return ranked.select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
