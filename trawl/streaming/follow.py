"""Incremental loads: only the new files of a folder are read, each once.

A file source lists the folder, a checkpoint remembers what was read, and one run takes what is there
and ends. A batch that was added but not yet noted when a run broke off comes again; the table or
index then knows it by its name and passes it over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawl import manifest
from trawl.operators.index import extend_index
from trawl.plans.search import index_contents
from trawl.sources.corpus import DEFAULT_DIMENSION, DENSE, SPARSE, load_dense, load_sparse, write_table


def _follow(rows: DataFrame, checkpoint: str, add: Callable[[DataFrame, str], None]) -> None:
    """Run ``add(batch, name)`` for what is new, then end."""
    spark = rows.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        # The checkpoint has an id of its own, so a new one in its place gives other names.
        stream = manifest.read_json(spark, f"{checkpoint}/metadata")["id"]
        if not batch.isEmpty():
            add(batch, f"{stream}/{number}")

    query = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def _new_rows(
    spark: SparkSession, folder: str, kind: str, analyzer: str, pretokenized: bool, dim: int, files_per_batch: int | None,
) -> DataFrame:
    """Rows of the ``.jsonl`` files of a folder, or of the folders a pattern matches, as a stream."""
    if kind not in (SPARSE, DENSE):
        raise ValueError(f"unknown kind: {kind}")
    schema = "id string, contents string" if kind == SPARSE else "id string, vector array<double>"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.jsonl").option("mode", "FAILFAST")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.json(folder)
    return load_sparse(rows, analyzer, pretokenized) if kind == SPARSE else load_dense(rows, dim)


def follow_table(
    spark: SparkSession, folder: str, path: str, kind: str, checkpoint: str, analyzer: str = "english",
    pretokenized: bool = False, dim: int = DEFAULT_DIMENSION, files_per_batch: int | None = None,
) -> None:
    """Add the rows of files that no run with this ``checkpoint`` has read to the stored table ``path``.

    The first run starts the table. An id that is there already fails the run, which adds nothing
    of its batch.
    """
    rows = _new_rows(spark, folder, kind, analyzer, pretokenized, dim, files_per_batch)
    _follow(rows, checkpoint, lambda batch, name: write_table(batch, path, append=True, batch=name))


def follow_index(
    spark: SparkSession, folder: str, path: str, checkpoint: str, flavour: str = "bm25", analyzer: str = "english",
    pretokenized: bool = False, files_per_batch: int | None = None, **options,
) -> None:
    """Add the documents of files that no run with this ``checkpoint`` has read to the index ``path``.

    The first run builds it, with the ``options`` of ``build_index``; later ones extend it and read
    none of the documents before.
    """
    rows = _new_rows(spark, folder, SPARSE, analyzer, pretokenized, DEFAULT_DIMENSION, files_per_batch)

    def add(batch: DataFrame, name: str) -> None:
        if manifest.newest(spark, path) is None:
            index_contents(batch, flavour, path=path, batch=name, **options)
        else:
            extend_index(batch, path, batch=name)

    _follow(rows, checkpoint, add)
