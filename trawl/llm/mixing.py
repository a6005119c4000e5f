"""Mixing sources to target weights by Pfair scheduling.

Each source is a stream of blocks of equal size. With share a of a period P, its block j (from 0)
is released at floor(j * P / a) and due at ceil((j + 1) * P / a); at every slot the released block
with the earliest deadline goes next. All deadlines are met and no block goes before its release,
so at any time each source is less than one block away from its target. Rows are not cut: a row goes
out whole in the slot of the block it starts in, so the emitted bytes of a source are less than one
block behind and less than one block and its longest row ahead. The schedule repeats every P slots, so a block finds its slot by arithmetic, at any size of the corpus.

A source that has run out leaves, and the others share its weight in a new phase: every row is
placed exactly once, none is dropped or repeated.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.tables import RECORD, SMALLER, constant_table, digest_of, same_text, stored, whole_text
from trawl.session import shuffle_partitions

BLOCK_BYTES = 16 * 1024
#: The stream of all sources without a share of their own.
OTHERS = "*"
#: The shares must add up to this at most; it bounds the table of one period.
MAX_PERIOD = 10_000
#: Hex digits of a row's random key that make its cell; running sums are taken within cells.
CELL_DIGITS = 3


def period_slots(shares: dict[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period: earliest deadline first among released blocks."""
    period = sum(shares.values())
    releases = sorted(
        (j * period // a, -(-(j + 1) * period // a), name) for name, a in shares.items() for j in range(a))
    slots: dict[str, list[int]] = {name: [] for name in shares}
    ready: list[tuple[int, str]] = []
    at = 0
    for slot in range(period):
        while at < len(releases) and releases[at][0] <= slot:
            heapq.heappush(ready, releases[at][1:])
            at += 1
        deadline, name = heapq.heappop(ready)
        assert slot < deadline
        slots[name].append(slot)
    return slots


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[tuple]:
    """``(stream, phase, first, last, base, period, slots)``: blocks first..last-1 of a stream in a phase."""
    left = {name: n for name, n in blocks.items() if n > 0}
    done, base, found = dict.fromkeys(left, 0), 0, []
    for phase in range(len(left)):
        if not left:
            break
        active = {name: shares[name] for name in left}
        period, slots = sum(active.values()), period_slots(active)
        end = min(((n - 1) // active[s]) * period + slots[s][(n - 1) % active[s]] for s, n in left.items()) + 1
        for name in list(left):
            in_rest = sum(slot < end % period for slot in slots[name])
            taken = end // period * active[name] + in_rest
            found.append((name, phase, done[name], done[name] + taken, base, period, slots[name]))
            done[name] += taken
            left[name] -= taken
            if not left[name]:
                del left[name]
        base += end
    return found


def _streams(rows: DataFrame, shares: dict[str, int], default_share: int) -> tuple[DataFrame, dict[str, int]]:
    if any(not isinstance(a, int) or a < 1 for a in [*shares.values(), default_share]):
        raise ValueError("shares are positive whole numbers")
    every = {OTHERS: default_share} | shares
    if sum(every.values()) > MAX_PERIOD:
        raise ValueError(f"shares add up to more than {MAX_PERIOD}")
    named = F.col("source").cast("string").isin([*every])
    return rows.withColumn("stream", F.when(named, F.col("source").cast("string")).otherwise(F.lit(OTHERS))), every


def schedule(rows: DataFrame, shares: dict[str, int], default_share: int = 1, block: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``stream, before, block, phase, slot`` to rows ``doc_id, source, size, row``.

    Within a stream rows come in the random order of the MD5 of their id; ``before`` is the size of
    all earlier rows of the stream, ``block`` the block in which the row starts, ``slot`` its place
    in the mix. A row longer than a block uses up the blocks it covers.
    """
    spark = rows.sparkSession
    rows, every = _streams(rows, shares, default_share)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row").cast("string")))
    rows = rows.withColumn("key", F.md5(key)).withColumn("cell", F.substring("key", 1, CELL_DIGITS))
    # At most 16 ** CELL_DIGITS rows per stream, and as many streams as shares are given.
    cells = stored(rows.groupBy("stream", "cell").agg(F.sum("size").alias("cell_size")))
    earlier = Window.partitionBy("stream").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("stream", "cell", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).alias("offset"))
    totals = {r[0]: r[1] for r in cells.groupBy("stream").agg(F.sum("cell_size")).collect()}
    blocks = {name: max(1, -(-total // block)) for name, total in totals.items()}
    plan: dict[str, list[dict]] = {}
    for name, phase, first, last, base, period, slots in phases(blocks, every):
        plan.setdefault(name, []).append(
            {"phase": phase, "first": first, "base": base, "period": period, "slots": slots})
    pieces = "array<struct<phase: int, first: bigint, base: bigint, period: int, slots: array<int>>>"
    rows_of_plan = [(name, blocks[name] - 1, p) for name, p in plan.items()]
    planned = constant_table(spark, rows_of_plan, f"stream string, last bigint, pieces {pieces}")

    in_cell = Window.partitionBy("stream", "cell").orderBy("key", "doc_id", "row")
    running = F.coalesce(F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The rows already lie by stream and cell, so this join moves only the offsets.
    placed = rows.withColumn("running", running).join(offsets, ["stream", "cell"])
    placed = placed.withColumn("before", F.col("offset") + F.col("running")).join(F.broadcast(planned), "stream")
    # Empty rows at the very end of a stream belong to its last block.
    placed = placed.withColumn("block", F.least(F.floor(F.col("before") / block), F.col("last")))
    placed = placed.withColumn("piece", F.element_at(F.filter("pieces", lambda p: p["first"] <= F.col("block")), -1))
    place, share = F.col("block") - F.col("piece.first"), F.size("piece.slots")
    in_period = F.element_at("piece.slots", (place % share + 1).cast("int"))
    slot = F.col("piece.base") + F.floor(place / share) * F.col("piece.period") + in_period
    return placed.select(
        "doc_id", "source", "size", "row", "stream", "before", "block", F.col("piece.phase").alias("phase"),
        slot.cast("long").alias("slot"))


def mix(
    docs: DataFrame, shares: dict[str, int], default_share: int = 1, block: int = BLOCK_BYTES,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``doc_id, source, size, stream, before, block, phase, slot`` of every row, see ``schedule``.

    The mix is the order by ``slot, before, doc_id``. A null or unlisted source belongs to stream
    ``*``; a null text has size 0; rows without an id are ordered by their place in the table.
    """
    sized = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.octet_length(whole_text(text_col)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")))
    return schedule(sized, shares, default_share, block).drop("row")


def mixed(
    docs: DataFrame, shares: dict[str, int], default_share: int = 1, block: int = BLOCK_BYTES,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """All rows of ``docs`` in the order of the mix: partition by partition, and sorted in each.

    Rows with the same id, source and text are one unit of the mix and stay together. The schedule
    is made of ids and sizes alone; the texts travel twice, to their slots and into their order.
    """
    text = whole_text(text_col)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), digest_of(text).alias("digest"),
        F.octet_length(text).cast("long").alias("size"))
    units = stored(keyed.groupBy("doc_id", "source", "digest").agg(F.sum("size").alias("size")).withColumn(
        "row", F.monotonically_increasing_id()))
    placed = schedule(units.drop("digest"), shares, default_share, block).select("row", "slot", "before")
    slots = stored(placed.join(units.select(
        "row", F.col("doc_id").alias("lost_id"), F.col("source").alias("unit_source"), F.col("digest").alias("lost_digest")), "row"))
    parts = shuffle_partitions(docs.sparkSession)
    end = (slots.agg(F.max("slot")).first()[0] or 0) + 1
    part = F.floor(F.col("slot") * F.lit(parts) / F.lit(end)).cast("int")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), digest_of(text).alias("digest"),
        F.struct(F.col("*")).alias(RECORD))
    together = rows.join(slots.hint(SMALLER), same_text() & F.col("source").eqNullSafe(F.col("unit_source")))
    ordered = together.repartitionById(parts, part).sortWithinPartitions("slot", "before", "row")
    return ordered.select(f"{RECORD}.*")
