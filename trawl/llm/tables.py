"""Helpers the operators share: written intermediate tables and small constant tables."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.session import scratch_dir

#: Texts go to Python in batches of about this many bytes, which bounds the buffers on both sides.
BATCH_BYTES = 4 * 1024 * 1024
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Join hint for a table much smaller than the texts it meets, but without a bound for a broadcast:
#: texts are hashed to it and need no sorting, at every size of the input alike.
SMALLER = "shuffle_hash"
#: Name of the column that carries a whole input row through an operator, so that no column the
#: operator adds can clash with a column of the input.
RECORD = "record"


def stored(df: DataFrame) -> DataFrame:
    """``df``, written to the shared checkpoint folder and read again.

    Later stages survive lost executors, nothing is computed twice, and Catalyst knows the size of
    the result, so that it broadcasts it only below its own threshold.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def same_text(left: str = "doc_id", right: str = "lost_id") -> Column:
    """Join condition: the same id, null equal to null, and the same text."""
    return F.col(left).eqNullSafe(F.col(right)) & (F.col("digest") == F.col("lost_digest"))


def keep_one(docs: DataFrame, keyed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``keyed (doc_id, digest, kept)`` keeps, each once, all columns unchanged.

    ``kept`` is one value for rows with equal id and text; of those one stays, always the same. The texts are read again rather than
    copied, and shuffled to the lost rows, which are the smaller side of every partition.
    """
    each = stored(keyed.groupBy("doc_id", "digest", "kept").agg(F.count("*").alias("n")))
    pairs = each.select(F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest"), "kept", "n")
    lost = stored(pairs.filter("NOT kept").drop("kept", "n"))
    repeated = stored(pairs.filter("kept AND n > 1").drop("kept", "n"))
    marked = docs.select(
        F.col(id_col).alias("doc_id"), digest_of(whole_text(text_col)).alias("digest"), F.struct(F.col("*")).alias(RECORD))
    left = marked.join(lost.hint(SMALLER), same_text(), "left_anti")
    if not repeated.isEmpty():
        # Of rows that differ in other columns the one whose JSON comes first; they collapse before the shuffle.
        again = left.join(repeated, same_text(), "left_semi")
        first = again.groupBy("doc_id", "digest").agg(F.min_by(RECORD, F.to_json(RECORD)).alias(RECORD))
        left = left.join(repeated, same_text(), "left_anti").unionByName(first)
    return left.select(f"{RECORD}.*")


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of constants of bounded number, as a literal of the plan."""
    names = [field.split()[0] for field in _fields(schema)]
    text = json.dumps([dict(zip(names, row)) for row in rows])
    parsed = F.from_json(F.lit(text), f"array<struct<{', '.join(_typed(f) for f in _fields(schema))}>>")
    return spark.range(1).select(F.inline(parsed))


def _fields(schema: str) -> list[str]:
    """Top-level ``name type`` parts of a schema string; commas inside <> do not split."""
    parts, depth, start = [], 0, 0
    for at, char in enumerate(schema):
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            parts.append(schema[start:at].strip())
            start = at + 1
    return [*parts, schema[start:].strip()]


def _typed(field: str) -> str:
    name, _, kind = field.partition(" ")
    return f"{name}: {kind}"


def whole_text(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def let_workers_import(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, unless they have it anyway.

    Functions so travel by name, and what a worker remembers outlives a task. On a cluster the
    package is installed or sent along; a folder that is not there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def map_texts(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches of bounded size; the session's own bound stays if it is smaller."""
    let_workers_import(df.sparkSession)
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_CONF).removesuffix("b")) > BATCH_BYTES:
        conf.set(BATCH_CONF, BATCH_BYTES)
    return df.mapInArrow(function, schema)


_memo: dict = {"name": None, "value": None}


def worker_memo(name: object, make: Callable[[], object]) -> object:
    """What this Python worker remembers from task to task, for one user at a time.

    Workers serve many stages; another ``name`` drops what the one before has gathered.
    """
    if _memo["name"] != name:
        _memo.update(name=None, value=None)
        _memo.update(name=name, value=make())
    return _memo["value"]
