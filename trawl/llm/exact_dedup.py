"""Exact copies of texts by a heavy-hitter split.

A Misra-Gries summary of the text digests finds those that may fill a noticeable share of all
rows. Their exact winners and counts come from a map-side aggregate and are broadcast (at most
``HEAVY`` rows), so no row of a large group is ever shuffled. All other digests have groups below
the error bound of the summary and meet in an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.tables import digest_of, keep_one, stored, whole_text

#: Counters of the summary: a digest with more than 3.5 / COUNTERS of all rows cannot be missed.
COUNTERS = 2048
#: Digests treated as heavy at most; more than COUNTERS / 3.5, so every such digest has a place.
HEAVY = 600


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, row`` of every row, written once."""
    return stored(docs.select(
        F.col(id_col).alias("doc_id"),
        digest_of(whole_text(text_col)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    ))


def heavy_digests(keyed: DataFrame) -> DataFrame:
    """At most ``HEAVY`` 64-bit digest keys that may be frequent, by mergeable Misra-Gries counters.

    Every input partition sends one summary of at most ``COUNTERS`` numbers to the last merge.
    """
    items = keyed.select(F.xxhash64("digest").alias("item"))
    top = items.agg(F.expr(f"approx_top_k(item, {HEAVY}, {COUNTERS})").alias("top")).select(F.inline("top"))
    return top.filter((F.col("count") > 1) & F.col("item").isNotNull()).select("item")


def resolve(keyed: DataFrame) -> DataFrame:
    """Adds ``keep_id, keep_row, group_size`` to rows of ``keyed_texts``.

    The row with the largest id stays; a null id is smaller than any other, and of rows that share
    the largest id one stays. No group is too large and none is skipped.
    """
    slim = keyed.select("doc_id", "digest", "row")
    heavy = stored(heavy_digests(slim))
    is_heavy = F.xxhash64("digest") == F.col("item")
    # The counters only nominate: winners and sizes are counted again over all rows, per full digest.
    winner = F.max(F.struct("doc_id", "row")).alias("winner")
    frequent = slim.join(F.broadcast(heavy), is_heavy, "left_semi")
    winners = stored(frequent.groupBy("digest").agg(winner, F.count("*").alias("group_size")))
    mapped = slim.join(F.broadcast(winners), "digest")
    rest = slim.join(F.broadcast(heavy), is_heavy, "left_anti")
    same = Window.partitionBy("digest")
    shuffled = rest.withColumn("winner", F.max(F.struct("doc_id", "row")).over(same)).withColumn(
        "group_size", F.count("*").over(same))
    columns = ["doc_id", "digest", "row", F.col("winner.doc_id").alias("keep_id"), F.col("winner.row").alias("keep_row"),
               "group_size"]
    return mapped.select(*columns).unionByName(shuffled.select(*columns))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row, dropped ones too.

    Texts are equal when identical; null counts as empty, and all empty texts are one group. Of a
    group exactly one row is kept, also when rows repeat with their id. An empty table gives none.
    """
    found = resolve(keyed_texts(docs, id_col, text_col))
    return found.select(
        "doc_id", "keep_id", "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_classes`` keeps, all their columns unchanged."""
    found = resolve(keyed_texts(docs, id_col, text_col))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return keep_one(docs, found.select("doc_id", "digest", kept.alias("kept")), id_col, text_col)
