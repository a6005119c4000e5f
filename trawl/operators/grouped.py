"""Exact cosine top-k with angular bounds: groups of rows that cannot hold a hit are not read.

A stored table lies in groups around pivots, some of its own rows. Every row belongs to the nearest
pivot, and a group knows the least and the largest angle between its rows and its pivot. By the
triangle inequality no row of a group is closer to a query than the difference of the query's angle
to the pivot and those bounds. The groups nearest to a query give a floor for its n-th best score;
then only groups whose bound reaches the floor are searched. Hits are those of a full search.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.vectors import norm
from trawl.operators.dense import candidates, cosine_top_k
from trawl.operators.topk import DIGITS, top_k
from trawl.session import qualified, scratch_dir, stored

# Pivots at most: they and a bound for each are all that the driver and every task hold.
PIVOTS = 1024
# Rows that the pivots are chosen from, at most, and the bytes they may take.
SAMPLE_ROWS = 8192
SAMPLE_BYTES = 64 * 1024 * 1024
# Angles are known to within this much, in radians.
SLACK = 1e-6
# Where more than this share of all pairs of queries and groups is open, everything is read in one pass.
WORTHWHILE = 0.5

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Grouped:
    """A stored table in groups.

    rows      id, embedding, norm, group, angle
    groups    group, pivot (of length 1), least, most, size: bounds of the angles, number of rows
    """

    rows: DataFrame
    groups: DataFrame


def _units(vectors: pa.Array) -> np.ndarray:
    matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return matrix / np.sqrt(np.einsum("ij,ij->i", matrix, matrix))[:, None]


def _assign(pivots: np.ndarray):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            close = _units(batch.column("embedding")) @ pivots.T
            group = close.argmax(axis=1)
            angle = np.arccos(np.clip(close[np.arange(len(group)), group], -1.0, 1.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(group.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "group", "angle"])

    return assign


def _apart(units: np.ndarray, count: int) -> np.ndarray:
    """Rows far from one another: each is the farthest from those before, so that no row is far from all."""
    chosen, close = [0], units @ units[0]
    while len(chosen) < min(count, len(units)):
        chosen.append(int(close.argmin()))
        close = np.maximum(close, units @ units[chosen[-1]])
    return units[chosen]


def _usable(vectors: DataFrame, column: str) -> DataFrame:
    length = norm(F.col(column))
    return vectors.filter(F.col(column).isNotNull() & (length > 0) & (length < float("inf")))


def group_table(table: DataFrame, path: str | None = None, pivots: int | None = None) -> Grouped:
    """Store ``table (id, embedding)`` in groups; rows without a cosine are left out.

    ``pivots`` defaults to the square root of the number of rows, ``PIVOTS`` at most.
    """
    spark = table.sparkSession
    path = qualified(spark, path or scratch_dir(spark))
    rows = table.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = _usable(rows, "embedding").withColumn("norm", norm(F.col("embedding")))
    count = rows.count()
    wanted = min(PIVOTS, pivots or math.ceil(math.sqrt(count)))
    first = rows.select(F.size("embedding")).first()
    sampled = max(wanted, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * first[0]))) if first else 0
    rate = min(1.0, 2 * sampled / max(1, count))
    some = rows.filter(F.pmod(F.xxhash64(F.lit("pivot"), "id"), F.lit(1 << 30)) <= int(rate * (1 << 30)))
    sample = [row.embedding for row in some.select("embedding").limit(sampled).collect()]
    if not sample and count:
        sample = [row.embedding for row in rows.select("embedding").limit(1).collect()]
    units = _apart(_units(pa.array(sample, pa.list_(pa.float64()))), wanted) if sample else np.zeros((1, 1))
    schema = "id string, embedding array<double>, norm double, group int, angle double"
    # Ranges of groups and angles, so that a large group fills several files and a file few groups.
    rows.mapInArrow(_assign(units), schema).repartitionByRange("group", "angle").sortWithinPartitions("group", "angle").write.mode(
        "overwrite").parquet(f"{path}/rows")
    kept = spark.read.schema(schema).parquet(f"{path}/rows")
    bounds = kept.groupBy("group").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count("*").alias("size"))
    names = spark.createDataFrame([(i, unit.tolist()) for i, unit in enumerate(units)], "group int, pivot array<double>")
    bounds.join(names, "group").select("group", "pivot", "least", "most", "size").coalesce(1).write.mode("overwrite").parquet(f"{path}/groups")
    return open_groups(spark, path)


def open_groups(spark: SparkSession, path: str) -> Grouped:
    """A table that ``group_table`` stored."""
    return Grouped(*(spark.read.parquet(f"{path}/{name}") for name in ("rows", "groups")))


def _visits(groups: list, n: int):
    """Adds to each query the groups to visit: without a floor the nearest ones that hold n rows, else those that reach it."""
    pivots = np.array([row.pivot for row in groups])
    number = np.array([row.group for row in groups], np.int32)
    least, most = (np.array([row[name] for row in groups]) for name in ("least", "most"))
    size = np.array([row["size"] for row in groups])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = batch.column("vector")
            if vectors.value_lengths().to_pylist() != [pivots.shape[1]] * len(batch):
                raise ValueError(f"embedding lengths of topics differ from {pivots.shape[1]}")
            angle = np.arccos(np.clip(_units(vectors) @ pivots.T, -1.0, 1.0))
            nearest = np.clip(np.maximum(angle - most, least - angle) - SLACK, 0.0, np.pi)
            chosen = []
            for i, floor in enumerate(batch.column("floor").to_pylist()):
                if floor is None:
                    order = np.argsort(nearest[i] + 1e-3 * angle[i], kind="stable")
                    upto = int(np.searchsorted(np.cumsum(size[order]), n)) + 1
                    chosen.append(number[order[:upto]])
                else:
                    chosen.append(number[np.cos(nearest[i]) >= floor - SLACK])
            yield pa.RecordBatch.from_arrays([batch.column("qid"), vectors, pa.array(chosen, pa.list_(pa.int32()))], names=["qid", "vector", "groups"])

    return visit


def grouped_top_k(table: Grouped, topics: DataFrame, n: int, digits: int | None = DIGITS) -> DataFrame:
    """``(qid, id, score, rank)``: the same hits as ``cosine_top_k`` over all rows."""
    asked = topics.select(F.col("qid").cast("string").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    asked, counted = stored(_usable(asked, "vector"))
    groups = table.groups.collect()
    if not groups or not counted["rows"]:
        return cosine_top_k(table.rows, asked, n, digits)

    def pairs(floors: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        visited = floors.mapInArrow(_visits(groups, n), "qid string, vector array<double>, groups array<int>")
        return stored(visited.select("qid", "vector", F.explode("groups").alias("group")))

    def searched(some: DataFrame) -> DataFrame:
        numbers = [row.group for row in some.select("group").distinct().collect()]
        rows = table.rows.filter(F.col("group").isin(numbers))
        return candidates(rows, some, n, digits, by=("group",)).select("qid", "id", "score")

    near, _ = pairs(asked.withColumn("floor", F.lit(None).cast("double")))
    found, _ = stored(top_k(searched(near), n, digits=None))
    last = found.groupBy("qid").agg(F.min("score").alias("floor"), F.count("*").alias("held"))
    # A list that is not full yet has no floor: everything can enter it.
    least = F.coalesce(F.when(F.col("held") >= n, F.col("floor")), F.lit(-2.0))
    reached, counted = pairs(asked.join(last, "qid", "left").select("qid", "vector", least.alias("floor")))
    if counted["rows"] > WORTHWHILE * len(groups) * asked.count():
        return cosine_top_k(table.rows, asked, n, digits)
    rest = reached.join(near.select("qid", "group"), ["qid", "group"], "left_anti")
    if rest.isEmpty():
        return found.select("qid", "id", "score", "rank")
    return top_k(found.select("qid", "id", "score").unionByName(searched(rest)), n, digits=None)
