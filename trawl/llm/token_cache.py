"""Token counts through a cache keyed by content digest and tokenizer version.

Texts whose digest the cache knows are never tokenized again; of the others each distinct text is
encoded once, and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.llm.tables import map_texts, stored, whole_text

#: Loaded tokenizers of this Python worker, by version; a worker serves few versions.
_loaded: dict[str, object] = {}


def tokenizer_version(model: bytes, kind: str) -> str:
    """Names a tokenizer: a change of its file is another version."""
    return hashlib.sha256(kind.encode() + b"\0" + model).hexdigest()


def _counter(model: bytes, kind: str, version: str):
    """A function that gives the number of tokens of a text."""
    if version not in _loaded:
        _loaded.clear()
        if kind == "sentencepiece":
            import sentencepiece

            _loaded[version] = sentencepiece.SentencePieceProcessor(model_proto=model)
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(model.decode())
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _loaded[version] = tokenizer
    loaded = _loaded[version]
    if kind == "sentencepiece":
        return lambda text: len(loaded.encode(text, num_threads=1))
    return lambda text: len(loaded.encode(text, add_special_tokens=False).ids)


def open_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """``digest, n_tokens`` of one version; a cache that does not exist yet is started empty.

    Two runs that append the same text at once leave its count twice, which is merged here.
    """
    folder = f"{path.rstrip('/')}/{version}"
    schema = "digest string, n_tokens long"
    spark.range(0).selectExpr("string(id) AS digest", "id AS n_tokens").write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(texts: DataFrame, model: bytes, kind: str) -> DataFrame:
    """``digest, n_tokens`` of rows ``digest, text``."""
    version = tokenizer_version(model, kind)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _counter(shared.value, kind, version)
        for batch in batches:
            counts = [tokens(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return map_texts(texts.select("digest", "text"), count, "digest string, n_tokens long")


def count_tokens(
    docs: DataFrame, cache: str, model_path: str, kind: str = "sentencepiece", limit: int = 4096,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``kind`` is ``sentencepiece`` or ``tokenizers``; no special tokens are added and texts are not
    cut. Texts are normalised only by reading null as empty, since any other change could alter the
    count. Rows may repeat and ids may be null or repeat with other texts: each distinct text is
    encoded once. An empty table gives no rows and leaves the cache as it is.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = file.read()
    version = tokenizer_version(model, kind)
    text = whole_text(text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    keyed = stored(named.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    # Copies collapse before the shuffle; one row of each unknown text stands for all of them, with the
    # id that the fewest copies share.
    each = keyed.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    distinct = each.groupBy("digest").agg(F.min(F.struct("n", "doc_id")).alias("one"))
    misses = stored(distinct.join(open_cache(spark, cache, version), "digest", "left_anti").select("digest", "one.*"))
    stands = (F.col("digest") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("miss_id"))

    def texts_of(some: DataFrame) -> DataFrame:
        one = some.select(F.col("digest").alias("miss"), F.col("doc_id").alias("miss_id"))
        return named.join(one, stands, "left_semi").select("digest", "text")

    texts = texts_of(misses.filter("n = 1"))
    if not (repeated := misses.filter("n > 1")).isEmpty():
        texts = texts.unionByName(texts_of(repeated).dropDuplicates(["digest"]))
    encode_misses(texts, model, kind).write.mode("append").parquet(f"{cache.rstrip('/')}/{version}")
    # Written apart from the aggregate above it, so that Spark can split the rows of a frequent digest.
    counts = stored(open_cache(spark, cache, version).join(distinct.select("digest"), "digest", "left_semi"))
    counted = keyed.join(counts, "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
