"""Session helpers: scratch folder, size checks, small-input spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only when its measured size stays below this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes charged per broadcast row on top of its text (hash table and row header).
ROW_OVERHEAD = 64


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trawl")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder of the session.

    Only a local session that names none falls back to a temporary folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="trawl-")
    return f"{base.rstrip('/')}/trawl-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _broadcast_bytes(df: DataFrame) -> Column:
    """Bytes a row of ``df`` would take in a broadcast table."""
    size = F.lit(ROW_OVERHEAD)
    for name, dtype in df.dtypes:
        if dtype == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif dtype == "array<string>":
            size = size + F.coalesce(F.octet_length(F.array_join(name, "  ")), F.lit(0))
        else:
            size = size + F.lit(8)
    return size.cast("long")


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and the bytes it would take as a broadcast table: one aggregate job."""
    measured = df.agg(F.count("*"), F.coalesce(F.sum(_broadcast_bytes(df)), F.lit(0))).first()
    return measured[0], measured[1]


def stored(df: DataFrame, **sums: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` written to the shared scratch folder and read again, and what was counted on the way.

    Counted are ``rows``, the ``bytes`` of a broadcast of them, and the sums of the given columns.
    """
    seen = Observation()
    counts = [F.count("*").alias("rows"), F.sum(_broadcast_bytes(df)).alias("bytes")]
    counts += [F.sum(column).alias(name) for name, column in sums.items()]
    path = scratch_dir(df.sparkSession)
    df.observe(seen, *counts).write.parquet(path)
    counted = {name: value or 0 for name, value in seen.get.items()}
    return df.sparkSession.read.schema(df.schema).parquet(path), counted


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``; for a file scan it comes from the listing Spark has made."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system and without relative parts, as the session's Hadoop sees it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toString()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Redistribute a freshly read input too small to give every core a split.

    Spark packs files into splits of at least ``openCostInBytes``. A large input is left alone, so
    its text is never shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = int(spark.conf.get("spark.sql.files.openCostInBytes").removesuffix("b"))
    return df.repartition(cores, key) if plan_bytes(df) < cores * least else df
