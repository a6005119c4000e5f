"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``SLOTS`` slots; every shard owns several virtual nodes on it, and a key belongs to
the first virtual node at or after its slot. Keys take their places in ring order, and a key whose
shard is full goes on clockwise to the next virtual node with room. Rows never pass the driver: it
sees the number of rows per slot (a bounded table), walks the ring with these counts, and returns
runs of ranks; rows find their run by their rank within the slot.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.tables import constant_table, stored, whole_text

#: A key's hash is a number of so many hex digits; its top bits are its slot.
HASH_DIGITS = 15
SLOT_BITS = 12
SLOTS = 1 << SLOT_BITS
VIRTUAL_NODES = 64
#: A slot with more than this many times the mean is ranked in several parts.
HOT = 8


def ring_nodes(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """``(slot, shard)`` of all virtual nodes, clockwise. A shard's nodes do not depend on other shards."""
    nodes = []
    for shard in range(shards):
        for copy in range(virtual_nodes):
            digest = hashlib.md5(f"{shard}/{copy}".encode()).digest()
            nodes.append((int.from_bytes(digest[:4], "big") % SLOTS, shard))
    return sorted(nodes)


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may take: equal up to one row, enlarged by ``slack``."""
    if slack:
        return [int((1 + slack) * rows / shards) + 1] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def walk(cells: list[tuple[int, int, int]], shards: int, slack: float, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple]:
    """Runs of each cell ``(slot, part, rows)``: ``(slot, part, [{lo, shard, first}])``.

    Rows from rank ``lo`` on go to ``shard``, where the first of them gets number ``first``.
    """
    nodes = ring_nodes(shards, virtual_nodes)
    room = capacities(sum(rows for _, _, rows in cells), shards, slack)
    filled, runs = [0] * shards, []
    for slot, part, rows in sorted(cells):
        at, lo, pieces = bisect_left(nodes, (slot, -1)), 0, []
        while lo < rows:
            shard = nodes[at % len(nodes)][1]
            taken = min(room[shard] - filled[shard], rows - lo)
            if taken > 0:
                pieces.append({"lo": lo, "shard": shard, "first": filled[shard]})
                filled[shard] += taken
                lo += taken
            at += 1
        runs.append((slot, part, pieces))
    return runs


def _ranked(keyed: DataFrame, spark) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """Rows with their slot, part and rank, and the number of rows of each cell.

    A slot far above the mean (a repeated key) is split into parts by row, so no task ranks it alone.
    There are at most ``SLOTS * (1 + 1 / HOT)`` cells, however large the table.
    """
    counts = [(r[0], r[1]) for r in keyed.groupBy("place").count().collect()]
    bound = HOT * max(1, sum(n for _, n in counts) / SLOTS)
    hot = [(slot, -int(-n // bound)) for slot, n in counts if n > bound]
    cells = [(slot, 0, n) for slot, n in counts if n <= bound]
    keyed = keyed.withColumn("part", F.lit(0))
    if hot:
        splits = constant_table(spark, hot, "place int, parts int")
        part = F.coalesce(F.pmod(F.xxhash64("row"), "parts"), F.lit(0)).cast("int")
        keyed = keyed.join(F.broadcast(splits), "place", "left").withColumn("part", part).drop("parts")
        in_hot = keyed.join(F.broadcast(splits), "place", "left_semi")
        cells += [tuple(r) for r in in_hot.groupBy("place", "part").count().collect()]
    in_order = Window.partitionBy("place", "part").orderBy("hash", "doc_id", "row")
    return keyed.withColumn("rank", F.row_number().over(in_order) - 1), cells


def shard(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
    slack: float = 0.0, virtual_nodes: int = VIRTUAL_NODES,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row.

    ``size`` is the UTF-8 length of the text plus 1, a null text has none and the checksum of the
    empty text. With ``slack=0`` the numbers of rows differ by at most one between shards; a larger
    ``slack`` lets a shard take ``1 + slack`` times the mean and moves fewer rows when shards are
    added. ``slot`` numbers the rows of a shard from 0 without gaps. Rows without an id are spread
    by their place in the table; rows that share an id start at one place and overflow like others.
    """
    spark = docs.sparkSession
    row = F.monotonically_increasing_id()
    sized = docs.select(
        F.col(id_col).alias("doc_id"), row.alias("row"),
        (F.octet_length(whole_text(text_col)).cast("long") + 1).alias("size"),
        F.crc32(whole_text(text_col).cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    hashed = stored(sized.withColumn("hash", F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("long")))
    placed = hashed.withColumn("place", F.shiftright("hash", 4 * HASH_DIGITS - SLOT_BITS).cast("int"))
    ranked, cells = _ranked(placed, spark)
    runs = constant_table(
        spark, walk(cells, shards, slack, virtual_nodes),
        "place int, part int, runs array<struct<lo: bigint, shard: int, first: bigint>>")
    run = F.element_at(F.filter("runs", lambda r: r["lo"] <= F.col("rank")), -1)
    found = ranked.join(F.broadcast(runs), ["place", "part"]).withColumn("run", run)
    return found.select(
        "doc_id", "size", "text_crc32", F.col("run.shard").alias("shard"),
        (F.col("run.first") + F.col("rank") - F.col("run.lo")).cast("long").alias("slot"))
