"""Corpora and topics: readers, writers, kind inference."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl import manifest
from trawl.functions.text import replace_nul, tokenize
from trawl.functions.vectors import as_vector, norm, text_precision
from trawl.session import qualified, spread

SPARSE, DENSE = "sparse", "dense"
DEFAULT_DIMENSION = 768


def kind_of(df: DataFrame) -> str:
    """``sparse`` for a table with contents, ``dense`` for one with embeddings."""
    if "contents" in df.columns:
        return SPARSE
    if "embedding" in df.columns:
        return DENSE
    raise ValueError(f"need a 'contents' or an 'embedding' column, got {df.columns}")


def table_name(name: str) -> str:
    return name.replace("-", "_")


def has_files(spark: SparkSession, path: str, glob: str) -> bool:
    """Whether a folder (not its subfolders) holds a file, or the path is one, whose name matches."""
    return not spark.read.option("pathGlobFilter", glob).format("binaryFile").load(path).select("path").isEmpty()


def _lines(spark: SparkSession, path: str, glob: str, skip: str | None = None) -> DataFrame:
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    if skip is not None:
        lines = lines.where(~F.col("_metadata.file_name").contains(skip))
    return lines.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line")).filter("line <> ''")


def _fields(line: Column) -> Column:
    """The object of a JSON line as an ordered map of text values; bad JSON fails the job."""
    return F.from_json(line, "map<string,string>", {"mode": "FAILFAST"})


def choose_text(fields: Column) -> Column:
    """Text of a raw document: title and text, else contents, else every field but the first."""

    def value(name: str) -> Column:
        return F.coalesce(F.try_element_at(fields, F.lit(name)), F.lit("None"))

    both = F.map_contains_key(fields, "title") & F.map_contains_key(fields, "text")
    rest = F.array_join(F.slice(F.map_values(fields), 2, F.greatest(F.size(fields) - 1, F.lit(0))), " ", "None")
    return (
        F.when(both, F.concat_ws(" ", value("title"), value("text")))
        .when(F.map_contains_key(fields, "contents"), value("contents"))
        .otherwise(rest)
    )


def parse_json_lines(lines: DataFrame) -> DataFrame:
    """``(line)`` of JSON objects to ``(id, contents)``; the first field is the id, ``{}`` is skipped."""
    fields = lines.select(_fields(F.col("line")).alias("fields")).filter(F.size("fields") > 0)
    return fields.select(
        F.get(F.map_values("fields"), F.lit(0)).alias("id"), choose_text(F.col("fields")).alias("contents")
    )


def parse_tsv_lines(lines: DataFrame) -> DataFrame:
    """``(line)`` of tab-separated text to ``(id, contents)``; the other columns are joined by spaces."""
    cells = F.split("line", "\t")
    return lines.select(
        F.get(cells, F.lit(0)).alias("id"),
        F.array_join(F.slice(cells, 2, F.size(cells)), " ").alias("contents"),
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw corpus of a file or folder: names containing ``.jsonl``, else ``.tsv``, plain or gzip."""
    json_lines = _lines(spark, path, "*.jsonl*")
    tsv_lines = _lines(spark, path, "*.tsv*", skip=".jsonl")
    return parse_json_lines(json_lines).unionByName(parse_tsv_lines(tsv_lines))


def parse_corpus(raw: DataFrame, analyzer: str = "english") -> DataFrame:
    """Analysed corpus ``(id, contents)``, contents being space-joined tokens."""
    return raw.select("id", tokenize(F.col("contents"), analyzer).alias("contents"))


def write_parsed(parsed: DataFrame, path: str) -> None:
    parsed.select("id", "contents").write.mode("overwrite").json(path, ignoreNullFields=False)


def require_unique(df: DataFrame, key: str = "id") -> DataFrame:
    """Fail when an id occurs twice; one shuffle of the id column only."""
    twice = df.groupBy(key).count().filter("count > 1").select(key).take(3)
    if twice:
        raise ValueError(f"duplicate {key}: {[row[0] for row in twice]}")
    return df


def load_sparse(
    docs: DataFrame, analyzer: str = "english", pretokenized: bool = False, nul_safe: bool = False
) -> DataFrame:
    """``(id, contents)`` table from loaded rows: contents analysed unless they are already.

    ``nul_safe`` replaces NUL characters of contents taken as they are.
    """
    text = F.col("contents")
    if pretokenized:
        text = replace_nul(text) if nul_safe else text
    else:
        text = tokenize(text, analyzer)
    return docs.select(F.col("id").cast("string").alias("id"), text.alias("contents"))


def load_dense(rows: DataFrame, dim: int = DEFAULT_DIMENSION, eight_decimals: bool = False) -> DataFrame:
    """``(id, embedding)`` table from the first two columns of ``rows``; lengths are checked."""
    key, vector = (F.col(f"`{name}`") for name in rows.columns[:2])
    embedding = as_vector(vector, dim)
    if eight_decimals:
        embedding = text_precision(embedding)
    return rows.select(key.cast("string").alias("id"), embedding.alias("embedding"))


def read_table(
    spark: SparkSession,
    path: str | list[str],
    kind: str,
    analyzer: str = "english",
    pretokenized: bool = False,
    dim: int = DEFAULT_DIMENSION,
) -> DataFrame:
    """Load files or folders for indexing: ``.jsonl`` for both kinds, ``.parquet`` for dense only.

    Files with other names are skipped; several paths append to one table.
    """
    if kind not in (SPARSE, DENSE):
        raise ValueError(f"unknown kind: {kind}")
    tables: list[DataFrame] = []
    for one in [path] if isinstance(path, str) else path:
        parquet = one.endswith(".parquet") or has_files(spark, one, "*.parquet")
        if parquet and kind == SPARSE:
            raise ValueError(f"parquet holds embeddings only: {one}")
        if parquet:
            tables.append(load_dense(spark.read.option("pathGlobFilter", "*.parquet").parquet(one), dim))
        if one.endswith(".parquet"):
            continue
        reader = spark.read.option("pathGlobFilter", "*.jsonl").option("mode", "FAILFAST")
        if kind == SPARSE:
            rows = reader.schema("id string, contents string").json(one)
            tables.append(load_sparse(rows, analyzer, pretokenized))
        else:
            tables.append(load_dense(reader.schema("id string, vector array<double>").json(one), dim))
    table = tables[0]
    for more in tables[1:]:
        table = table.unionByName(more)
    return require_unique(table)


def write_table(df: DataFrame, path: str, append: bool = False, batch: str | None = None) -> None:
    """Create, replace or extend a stored sparse or dense table; a dense one stores the norms too.

    The rows are written to a folder of their own and then take effect in one step: a replacement
    that breaks off leaves the table as it was. An id that an append would bring twice is an error,
    and nothing is added. A ``batch`` that the table holds is not added again.
    """
    spark = df.sparkSession
    path = qualified(spark, path)
    kind = kind_of(df)
    columns = ["id", "contents"] if kind == SPARSE else ["id", "embedding", norm(F.col("embedding")).alias("norm")]
    held = manifest.newest(spark, path) if append else None
    parts = held["parts"] if held else []
    if batch is not None and batch in [part["batch"] for part in parts]:
        return
    if parts:
        require_unique(df.select("id").unionByName(open_table(spark, path).select("id")))
    part = {"name": f"part-{uuid.uuid4().hex}", "batch": batch}
    df.select(*columns).write.parquet(f"{path}/{part['name']}")
    older = manifest.publish(spark, path, {"kind": kind, "parts": [*parts, part]})
    if not parts:
        # The table before this one stays, for who has it open; older ones go.
        for name, before in list(older.items())[:-1]:
            kept = {p["name"] for p in list(older.values())[-1]["parts"]}
            manifest.remove(spark, f"{path}/{manifest.FOLDER}/{name}")
            for gone in before["parts"]:
                if gone["name"] not in kept:
                    manifest.remove(spark, f"{path}/{gone['name']}")


def open_table(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``write_table`` stored."""
    path = qualified(spark, path)
    held = manifest.newest(spark, path)
    if held is None:
        raise ValueError(f"no table in {path}")
    return spark.read.parquet(*(f"{path}/{part['name']}" for part in held["parts"]))


def num_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("num_rows"))


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topics ``(qid, contents, vector)`` from one JSONL or TSV file, plain or gzip.

    The id field is ``id``, else ``qid``; of a TSV line only the second column is the query.
    """
    if ".jsonl" in path:
        rows = spark.read.schema("id string, qid string, contents string, vector array<double>").option(
            "mode", "FAILFAST"
        ).json(path)
        return rows.select(F.coalesce("id", "qid").alias("qid"), "contents", "vector")
    if ".tsv" in path:
        cells = F.split("line", "\t")
        return _lines(spark, path, "*").select(
            F.get(cells, F.lit(0)).alias("qid"),
            F.get(cells, F.lit(1)).alias("contents"),
            F.lit(None).cast("array<double>").alias("vector"),
        )
    raise ValueError(f"topics must be .jsonl or .tsv: {path}")


def read_parquet_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Parquet table, spread over the cores when it has few splits."""
    rows = spark.read.parquet(path)
    return spread(rows, rows.columns[0])
