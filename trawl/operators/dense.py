"""Exact cosine top-k over embeddings.

Every document vector has to meet every query vector, but no pair becomes a row. The queries are
written once to the shared scratch folder, in files of bounded size. A task reads its documents in
slabs, multiplies each with one file after the other, and passes on the rows that beat the n-th best
score it has seen for their query; the driver sees no vector at all. Of a large table some first rows
are searched beforehand: the n-th best score among them is a floor that every task starts from.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trawl.operators.topk import DIGITS, top_k
from trawl.session import plan_bytes, qualified, scratch_dir

# Queries of one file, bytes of the query matrix multiplied at once, and bytes of the documents a
# task holds at a time.
QUERY_ROWS = 4096
QUERY_BYTES = 64 * 1024 * 1024
SLAB_BYTES = 64 * 1024 * 1024
# Bytes of query files a task keeps from slab to slab.
HELD_BYTES = 256 * 1024 * 1024
# Scores computed at once in a task.
BLOCK_SCORES = 2_000_000
# Rows searched beforehand for floors, of tables larger than so many bytes.
FLOOR_ROWS = 20_000
FLOORS_FROM = 256 * 1024 * 1024

# Executors get these functions inside the task, not by import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles; a null component becomes NaN, another length than ``dim`` fails the job."""
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if lengths != [dim]:
        raise ValueError(f"embedding lengths {lengths} differ from query length {dim}")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit_rows(matrix: np.ndarray, norms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by their norms, and which rows have one: not zero, no null, NaN or infinity."""
    if norms is None:
        norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    usable = np.isfinite(norms) & (norms > 0)
    return matrix[usable] / norms[usable, None], usable


def _n_best(hits: pa.Table, n: int) -> pa.Table:
    """The first n rows of each query by (score desc, id asc)."""
    hits = hits.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
    q = hits["q"].to_numpy()
    first = np.searchsorted(q, q, side="left")
    return hits.filter(pa.array(np.arange(len(q)) - first < n))


def _block_hits(unit: np.ndarray, ids: pa.Array, queries: np.ndarray, floor: np.ndarray, n: int, digits) -> pa.Table:
    """``q, id, score`` of what can be among the n best; raises ``floor`` to the n-th best score seen."""
    scores = unit @ queries.T
    if digits is not None:
        scores = np.round(scores, digits) + 0.0
    if len(scores) >= n:
        np.maximum(floor, np.partition(scores, len(scores) - n, axis=0)[len(scores) - n], out=floor)
    row, q = np.nonzero(scores >= floor)
    # Copies of one vector tie; no more than n of them pass.
    return _n_best(pa.table({"q": q, "id": ids.take(pa.array(row)), "score": scores[row, q]}), n).combine_chunks()


def _slabs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches as tables of about ``rows`` rows."""
    waiting, count = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            waiting.append(part)
            count += part.num_rows
            if count >= rows:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, count = [], 0
    if count:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _corpora(table: pa.Table, by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each corpus."""
    if not by:
        yield (), table
        return
    for key in table.select(by).group_by(by).aggregate([]).to_pylist():
        mask = None
        for name in by:
            same = pc.is_null(table[name]) if key[name] is None else pc.fill_null(pc.equal(table[name], key[name]), False)
            mask = same if mask is None else pc.and_(mask, same)
        yield tuple(key[name] for name in by), table.filter(mask)


class _Files:
    """Tables in the scratch folder, read when their turn comes and kept as far as memory allows.

    One that is gone is an error.
    """

    def __init__(self, uris: list[str]):
        self.uris, self.held = uris, {}

    def table(self, nth: int) -> pa.Table:
        if nth not in self.held:
            system, path = fs.FileSystem.from_uri(self.uris[nth])
            table = pq.read_table(path, filesystem=system, partitioning=None).combine_chunks()
            while self.held and sum(t.nbytes for t in self.held.values()) + table.nbytes > HELD_BYTES:
                self.held.pop(next(iter(self.held)))
            self.held[nth] = table
        return self.held[nth]


class _Queries:
    """Chunks of queries: slices of files that make matrices of bounded size."""

    def __init__(self, files: list[str], shared: list[str], dim: int):
        self.files, self.shared, self.dim = _Files(files), shared, dim
        self.slice = max(1, QUERY_BYTES // (8 * dim))
        self.held: tuple = (None, None)

    def chunks(self) -> Iterator[tuple[int, int]]:
        for nth in range(len(self.files.uris)):
            for at in range(0, QUERY_ROWS, self.slice):
                yield nth, at

    def corpora(self, chunk: tuple[int, int]) -> dict[tuple, tuple[pa.Array, np.ndarray]]:
        """Names and unit vectors of the chunk's queries, by the corpus they are meant for."""
        if self.held[0] != chunk:
            nth, at = chunk
            found = {}
            for key, part in _corpora(self.files.table(nth).slice(at, self.slice).combine_chunks(), self.shared):
                if len(part):
                    unit, usable = _unit_rows(_matrix(part["vector"].combine_chunks(), self.dim))
                    found[key] = part["qid"].combine_chunks().filter(pa.array(usable)), unit
            self.held = chunk, found
        return self.held[1]


def _floors(files: list[str], by: list[str]) -> dict[tuple, float]:
    """The floor of each ``(corpus, qid)`` that has one."""
    tables = _Files(files)
    return {
        (tuple(row[name] for name in by), row["qid"]): row["floor"]
        for nth in range(len(files)) for row in tables.table(nth).to_pylist()}


def _search(files: list[str], floor_files: list[str], dim: int, by: list[str], shared: list[str], n: int, digits, kinds: pa.Schema):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, known = _Queries(files, shared, dim), _floors(floor_files, by)
        floors: dict[tuple, np.ndarray] = {}
        for slab in _slabs(batches, max(1, SLAB_BYTES // (8 * dim))):
            for corpus, rows in _corpora(slab.filter(pc.is_valid(slab["embedding"])), by):
                if not len(rows):
                    continue
                norms = rows["norm"].to_numpy(zero_copy_only=False) if "norm" in rows.column_names else None
                unit, usable = _unit_rows(_matrix(rows["embedding"].combine_chunks(), dim), norms)
                rows = rows.filter(pa.array(usable)).combine_chunks()
                meant = tuple(corpus[by.index(name)] for name in shared)
                for chunk in queries.chunks():
                    names, vectors = queries.corpora(chunk).get(meant, ((), None))
                    if not len(names):
                        continue
                    if (corpus, chunk) not in floors:
                        floors[corpus, chunk] = np.array([known.get((corpus, qid), -np.inf) for qid in names.to_pylist()])
                    floor = floors[corpus, chunk]
                    size = max(1, BLOCK_SCORES // len(names))
                    for at in range(0, len(unit), size):
                        ids = rows["id"].slice(at, size).combine_chunks()
                        hits = _block_hits(unit[at:at + size], ids, vectors, floor, n, digits)
                        where = {name: pa.array([value] * len(hits), kinds.field(name).type) for name, value in zip(by, corpus)}
                        named = where | {"qid": names.take(hits["q"].combine_chunks()), "id": hits["id"], "score": hits["score"]}
                        yield from pa.table(named, schema=kinds).to_batches(max_chunksize=65536)

    return search


def _written(df: DataFrame, folder: str) -> list[str]:
    """Write ``df`` in files of bounded length; gives their addresses, as tasks of pyarrow understand them."""
    df.write.option("maxRecordsPerFile", QUERY_ROWS).parquet(folder)
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = [status.getPath().toString() for status in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
    return sorted(f"file://{uri[5:]}" if uri.startswith("file:/") and uri[6:7] != "/" else uri for uri in found if uri.endswith(".parquet"))


def candidates(
    docs: DataFrame, topics: DataFrame, n: int, digits: int | None = DIGITS, by: tuple[str, ...] = (),
) -> DataFrame:
    """``(by, qid, id, score)``: what the tasks of ``cosine_top_k`` pass on, the n best of each query among it."""
    spark, by = docs.sparkSession, list(by)
    shared = [name for name in by if name in topics.columns]
    fields = {field.name: field for field in docs.schema if field.name in by}
    wanted = topics.select(
        *shared, F.col("qid").cast("string").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    folder = qualified(spark, scratch_dir(spark))
    # The topics are computed once; all that follows reads what was written.
    seen, lengths = Observation(), F.size("vector")
    measured = wanted.filter("vector IS NOT NULL").observe(
        seen, F.count("*").alias("rows"), F.min(lengths).alias("least"), F.max(lengths).alias("dim"))
    files = _written(measured, f"{folder}/topics")
    size = seen.get
    kinds = {name: field.dataType.simpleString() for name, field in fields.items()}
    schema = ", ".join([*(f"`{name}` {kinds[name]}" for name in by), "qid string, id string, score double"])
    if not size.get("rows"):
        return spark.createDataFrame([], schema)
    if size["least"] != size["dim"]:
        raise ValueError(f"embedding lengths of topics run from {size['least']} to {size['dim']}")
    extra = ["norm"] if "norm" in docs.columns else []
    rows = docs.select(*by, F.col("id").cast("string").alias("id"), "embedding", *extra)
    arrow = pa.schema([*(pa.field(name, to_arrow_type(fields[name].dataType)) for name in by),
                       ("qid", pa.string()), ("id", pa.string()), ("score", pa.float64())])

    def searched(some: DataFrame, floors: list[str]) -> DataFrame:
        search = _search(files, floors, int(size["dim"]), by, shared, n, digits, arrow)
        return some.mapInArrow(search, schema)

    floors = []
    if plan_bytes(docs) >= FLOORS_FROM:
        first = top_k(searched(rows.limit(FLOOR_ROWS), []), n, tuple(by), digits=None)
        held = first.groupBy(*by, "qid").agg(F.min("score").alias("floor"), F.count("*").alias("held"))
        floors = _written(held.filter(F.col("held") == n).drop("held"), f"{folder}/floors")
    return searched(rows, floors)


def cosine_top_k(
    docs: DataFrame, topics: DataFrame, n: int, digits: int | None = DIGITS, by: tuple[str, ...] = (),
) -> DataFrame:
    """``(by, qid, id, score, rank)``: the n documents closest to each topic ``(qid, vector)``.

    ``by`` names columns of ``docs`` that tell corpora apart, each with a ranking of its own; topics
    that carry such columns are put to their corpus only. Null vectors, vectors of norm zero and
    vectors that hold a null, NaN or infinite number have no cosine and are left out. A document
    vector whose length differs from the query's fails the job. A ``norm`` column of ``docs``, as
    ``write_table`` stores it, saves computing the norms.
    """
    return top_k(candidates(docs, topics, n, digits, by), n, tuple(by), digits=None)
