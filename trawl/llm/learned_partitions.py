"""Nearest neighbours by cosine through learned partitions.

A bounded sample of the vectors gives a neighbour graph, whose nodes are split into parts of equal
size that cut few edges. A softmax classifier learns the part of a vector from the vector alone.
It then assigns every row of the table to its most probable part and routes each query to its
several most probable ones, whose vectors are scored exactly. How many parts a query visits is
set on the sample, so that ``RECALL`` of the true neighbours lie in them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.tables import constant_table, let_workers_import, stored

#: Vectors at most that the graph and the classifier are fitted to.
SAMPLE_ROWS = 8192
#: Neighbours per node of the graph, and nodes compared with all others at a time.
DEGREE = 10
GRAPH_ROWS = 128
#: One part for so many vectors of the sample.
SAMPLE_PER_PART = 250
#: A part may hold this much more than its even share of the sample.
IMBALANCE = 1.05
#: Part of the sample's true neighbours that the visited parts must hold.
RECALL = 0.96
PROBES = 400
STEPS = 300
#: Rows and queries that one task compares at a time.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 2048
#: Products of blocks may be off by this much before scores are computed pair by pair.
SLACK = 1e-9


@dataclass
class Router:
    weights: np.ndarray
    offsets: np.ndarray
    visits: int

    def logits(self, units: np.ndarray) -> np.ndarray:
        return units @ self.weights + self.offsets


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def neighbours(units: np.ndarray, queries: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest other rows of each row in ``queries``."""
    found = []
    for at in range(0, len(queries), GRAPH_ROWS):
        rows = queries[at:at + GRAPH_ROWS]
        scores = units[rows] @ units.T
        scores[np.arange(len(rows)), rows] = -np.inf
        # A copy: a slice would keep the whole row of places alive for every node.
        found.append(np.argpartition(-scores, count - 1, axis=1)[:, :count].copy())
    return np.concatenate(found)


def balanced_parts(units: np.ndarray, graph: np.ndarray, parts: int, random) -> np.ndarray:
    """Part of each node: even sizes, and few edges of the graph between parts.

    Nodes first go to the nearest of ``parts`` centres with room; then each node moves to the part
    of most of its neighbours while that part has room, in several sweeps.
    """
    size = len(units)
    room = int(np.ceil(IMBALANCE * size / parts))
    centres = units[random.choice(size, parts, replace=False)]
    for _ in range(8):
        near = units @ centres.T
        part = np.full(size, -1)
        filled = np.zeros(parts, np.int64)
        for node in np.argsort(-near.max(axis=1), kind="stable"):
            order = np.argsort(-near[node], kind="stable")
            chosen = order[filled[order] < room][0]
            part[node] = chosen
            filled[chosen] += 1
        centres = unit(np.stack([units[part == p].sum(axis=0) for p in range(parts)]) + 1e-12)
    both = [set(row) for row in graph.tolist()]
    for node, row in enumerate(graph.tolist()):
        for other in row:
            both[other].add(node)
    for _ in range(6):
        moved = 0
        for node in random.permutation(size):
            votes = np.bincount(part[list(both[node])], minlength=parts)
            votes[(filled >= room) & (np.arange(parts) != part[node])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[node]]:
                filled[part[node]] -= 1
                filled[best] += 1
                part[node] = best
                moved += 1
        if not moved:
            break
    return part


def fit(vectors: np.ndarray, parts: int, seed: int = 11) -> Router:
    """The router learned from a sample of vectors."""
    units, random = unit(vectors), np.random.default_rng(seed)
    size, dimension = units.shape
    parts = min(parts, size // (2 * DEGREE))
    if parts < 2:
        return Router(np.zeros((dimension, 1)), np.zeros(1), 1)
    graph = neighbours(units, np.arange(size), DEGREE)
    part = balanced_parts(units, graph, parts, random)
    # A node's target is the mix of its own part and those of its neighbours.
    target = np.zeros((size, parts))
    np.add.at(target, (np.repeat(np.arange(size), DEGREE), part[graph].reshape(-1)), 0.5 / DEGREE)
    target[np.arange(size), part] += 0.5
    weights, offsets = np.zeros((dimension, parts)), np.zeros(parts)
    moments = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(offsets), np.zeros_like(offsets)]]
    for step in range(1, STEPS + 1):
        logits = units @ weights + offsets
        share = np.exp(logits - logits.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        wrong = (share - target) / size
        for value, change, (first, second) in zip((weights, offsets), (units.T @ wrong, wrong.sum(axis=0)), moments):
            first += 0.1 * (change - first)
            second += 0.01 * (change * change - second)
            value -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    router = Router(weights, offsets, parts)
    logits = router.logits(units)
    probes = random.choice(size, min(PROBES, size), replace=False)
    near = neighbours(units, probes, 5)
    place = np.argsort(np.argsort(-logits[probes], axis=1, kind="stable"), axis=1)
    turn = np.take_along_axis(place, logits.argmax(axis=1)[near], axis=1)
    for visits in range(1, parts + 1):
        if (turn < visits).mean() >= RECALL:
            router.visits = visits
            break
    return router


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of rows that take part, all of the most frequent length."""
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    fit_rows = named.filter("vec_id IS NOT NULL AND size(vector) > 0").filter(finite)
    fit_rows = fit_rows.filter((length > 0) & (length < float("inf")))
    sizes = fit_rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fit_rows.filter(F.size("vector") == (sizes.n if sizes else -1))


def _assigner(shared, visits: int):
    """Adds to each row the ``visits`` most probable parts, most probable first."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        for batch in batches:
            if not len(batch):
                continue
            logits = router.logits(unit(_matrix(batch.column("vector"))))
            order = np.argsort(-logits, axis=1, kind="stable")[:, :visits].astype(np.int32)
            ends = np.arange(len(batch) + 1, dtype=np.int32) * order.shape[1]
            parts = pa.ListArray.from_arrays(pa.array(ends), pa.array(order.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts], names=[*batch.schema.names, "parts"])

    return assign


def best_pairs(query_ids, queries, row_ids, rows, k: int) -> tuple[list, list, list]:
    """Of each query the ``k`` nearest rows with another id: ``(query id, row id, score)``.

    Rows with equal vectors are compared once, for their ``k + 1`` smallest ids.
    """
    order = np.argsort(row_ids, kind="stable")
    row_ids, rows = row_ids[order], rows[order]
    distinct, group = np.unique(rows, axis=0, return_inverse=True)
    group = group.reshape(-1)
    by_group = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[by_group], np.arange(len(distinct) + 1))
    lengths = np.sqrt(np.einsum("ij,ij->i", distinct, distinct))
    query_lengths = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    close = (queries / query_lengths[:, None]) @ (distinct / lengths[:, None]).T
    take = min(k + 1, len(distinct))
    floor = -np.partition(-close, take - 1, axis=1)[:, take - 1] - SLACK
    found = ([], [], [])
    for i, query in enumerate(queries):
        some = np.flatnonzero(close[i] >= floor[i])
        # The exact measure, pair by pair, so that equal vectors get equal scores in every block.
        scores = np.einsum("ij,j->i", distinct[some], query) / (lengths[some] * query_lengths[i])
        pairs = [
            (-score, row_ids[row]) for score, own in zip(scores, some)
            for row in by_group[starts[own]:starts[own + 1]][:k + 1]]
        nearest = [p for p in sorted(pairs) if p[1] != query_ids[i]][:k]
        found[0].extend([query_ids[i]] * len(nearest))
        found[1].extend(p[1] for p in nearest)
        found[2].extend(-p[0] for p in nearest)
    return found


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, every: int = 50, k: int = 5,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, nearest first.

    Queries are the given rows, or the rows of ``vectors`` whose id is divisible by ``every``; rows
    with the query's own id are no candidates, and ties go to the smaller id. Rows with a null id, or
    whose vector is null, empty, zero, of another length than most, or holds a null or non-finite
    number, take no part. Queries that repeat an id count once. A query for which the visited parts
    hold fewer than ``k`` candidates visits all parts.
    """
    spark = vectors.sparkSession
    let_workers_import(spark)
    usable = _usable(vectors, id_col, vector_col)
    total = usable.count()
    rate = min(1.0, 1.2 * SAMPLE_ROWS / max(1, total))
    hashed = usable.filter(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1 << 30)) <= int(rate * (1 << 30)))
    sample = np.array([r[0] for r in hashed.select("vector").limit(SAMPLE_ROWS).collect()])
    parts = max(1, len(sample) // SAMPLE_PER_PART)
    router = fit(sample, parts) if len(sample) else Router(np.zeros((1, 1)), np.zeros(1), 1)
    shared = spark.sparkContext.broadcast(router)

    placed = usable.mapInArrow(_assigner(shared, 1), "vec_id long, vector array<double>, parts array<int>")
    indexed = stored(placed.select("vec_id", "vector", F.col("parts")[0].alias("part")))
    asked = indexed.filter(F.col("vec_id") % every == 0) if queries is None else _usable(queries, id_col, vector_col)
    asked = asked.select(F.col("vec_id"), "vector").dropDuplicates(["vec_id"])
    sizes = {r[0]: r[1] for r in indexed.groupBy("part").count().collect()}
    routed = asked.mapInArrow(_assigner(shared, len(router.offsets)), "vec_id long, vector array<double>, parts array<int>")
    routed = stored(routed.select(
        F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), F.slice("parts", 1, router.visits).alias("near"),
        "parts"))
    held = F.create_map(*[x for part, n in sizes.items() for x in (F.lit(part), F.lit(n))]) if sizes else None
    if held is not None:
        enough = F.aggregate("near", F.lit(0).cast("long"), lambda n, p: n + F.coalesce(held[p], F.lit(0))) > k
        routed = routed.withColumn("near", F.when(enough, F.col("near")).otherwise(F.col("parts")))
    visits = stored(routed.select("query_id", "query", F.explode("near").alias("part")))
    asks = {r[0]: r[1] for r in visits.groupBy("part").count().collect()}
    # A part meets its queries in blocks, so that no task holds more than one block of each.
    shape = [(p, -(-n // BLOCK_ROWS), -(-asks.get(p, 0) // BLOCK_QUERIES)) for p, n in sizes.items()]
    shapes = F.broadcast(constant_table(spark, shape, "part int, blocks long, chunks long"))
    rows = indexed.join(shapes, "part").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    rows = rows.withColumn("chunk", F.explode(F.expr("IF(chunks > 0, sequence(0, chunks - 1), array())")))
    wanted = visits.join(shapes, "part").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks"))
    wanted = wanted.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
    keys = ["part", "block", "chunk"]
    names = ["query_id", "vec_id", "score"]

    def compare(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        found = ([], [], [])
        if len(candidates) and len(asking):
            found = best_pairs(
                asking.column("query_id").to_numpy(), _matrix(asking.column("query")),
                candidates.column("vec_id").to_numpy(), _matrix(candidates.column("vector")), k)
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=names)

    met = rows.select(*keys, "vec_id", "vector").groupBy(*keys).cogroup(
        wanted.select(*keys, "query_id", "query").groupBy(*keys)).applyInArrow(
        compare, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
