"""Packing documents into sequences of fixed length by best-fit decreasing.

A document longer than a sequence is first cut into full windows; the windows fill sequences of
their own. What remains of each document is packed in buckets of bounded size, each in one task:
longest first, every piece into the open window with the least room that still holds it, found by
a segment tree over remaining capacities. Buckets are dealt at random, or are ranges of the order in
which the documents come, where that order counts.
"""

from __future__ import annotations

import hashlib
import json
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.tables import RECORD, let_workers_import, map_texts, stored, whole_text, worker_memo

WINDOW = 2048
#: Closes every document.
END_ID = 1
#: Pieces packed together; more buckets mean more half-filled last windows, one or two per bucket.
BUCKET_PIECES = 4096
#: Words a Python worker remembers with their ids, the longest of them, and characters it works on at a time.
MEMO_WORDS = 500_000
MEMO_CHARS = 64
CHUNK_CHARS = 2_000_000
#: Rows of a file that are counted together to find the place of each piece in the whole order.
CELL_ROWS = 4096
#: Columns of the place of a piece's row in its table, and of the rows counted together with it.
ORDER, CELL = "_order", "_cell"

class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose nodes tell whether any lies below."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.some[node] += change
            node >>= 1

    def add(self, room: int, window: int) -> None:
        if room:
            self.windows[room].append(window)
            self._count(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least ``length``: ``(room, window)``."""
        node = length + self.leaves
        if not self.some[node]:
            # Up to the first subtree to the right that holds a window, then down its left edge.
            while node > 1 and (node & 1 or not self.some[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.some[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._count(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece; ``lengths`` must not increase."""
    open_windows, numbers, offsets, used = OpenWindows(window), [], [], 0
    for length in lengths:
        found = open_windows.tightest(length)
        room, number = found or (window, used)
        used += found is None
        numbers.append(number)
        offsets.append(window - room)
        open_windows.add(room - length, number)
    return numbers, offsets


class WordIds:
    """Token ids of texts as little-endian 32-bit numbers.

    Where the tokenizer drops white space, lower-cases, splits runs of letters from all else and
    works on bytes, as its own description tells, each distinct word of a batch is looked up once:
    Latin words go straight to its merges, and the marks behind a word are looked up apart. With any
    other tokenizer texts are encoded whole.

    Ids of words are remembered. Half of the memory takes new words; when it is full, it becomes the
    other half, which is dropped then but for the words that were met again.
    """

    #: Letters up to here have one lower-case form each, the same in every library, but for one.
    LATIN = 0x250
    ODD = "\u0130"
    #: Split from the letters before them; nothing composes with them.
    MARKS = string.punctuation

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Latin words and marks, with A-Z in lower case; and other words as they stand in the texts.
        self.simple: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.simple_before: dict[str, bytes] = {}
        self.others_before: dict[str, bytes] = {}
        described = json.loads(text)
        normal = [n.get("type") for n in (described.get("normalizer") or {}).get("normalizers", [])]
        split = [p.get("type") for p in (described.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.plain = normal == ["NFC", "Replace", "Lowercase"] and split == ["Split", "ByteLevel"]
        self.model = self.tokenizer.model
        # The printable form in which byte-level models write bytes.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

    def _whole(self, words: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in encoded]

    def _new(self, word: str) -> bytes | None:
        """Ids of a word of Latin letters, or of marks, else None."""
        if not word.isalpha():
            return None if word.strip(self.MARKS) else self._whole([word])[0]
        if word.isascii():
            written = word
        elif max(word) < chr(self.LATIN) and self.ODD not in word:
            written = "".join(map(self.letters.__getitem__, word.lower().encode()))
        else:
            return None
        return array("I", [token.id for token in self.model.tokenize(written)]).tobytes()

    def _simple(self, words: list[str]) -> list[bytes | None]:
        found = list(map(self.simple.get, words))
        for at, ids in enumerate(found):
            if ids is None:
                word = words[at]
                ids = self.simple_before.get(word)
                if ids is None:
                    ids = self._new(word)
                if ids is not None:
                    found[at] = ids
                    if len(word) <= MEMO_CHARS:
                        self.simple[word] = ids
        return found

    def _others(self, words: list[str]) -> list[bytes]:
        known = {word: self.others.get(word, self.others_before.get(word)) for word in words}
        fresh = [word for word, ids in known.items() if ids is None]
        known.update(zip(fresh, self._whole(fresh)))
        self.others.update((word, ids) for word, ids in known.items() if len(word) <= MEMO_CHARS)
        return [known[word] for word in words]

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of each of these words, all different."""
        if len(self.simple) + len(self.others) > MEMO_WORDS // 2:
            self.simple_before, self.simple = self.simple, {}
            self.others_before, self.others = self.others, {}
        # Every word becomes two, its marks at the end being the second.
        cuts = np.repeat(_offsets(words), 2)[:-1]
        cuts[1::2] += pc.binary_length(pc.ascii_rtrim(words, self.MARKS)).to_numpy()
        halves = pa.Array.from_buffers(pa.large_string(), 2 * len(words), [None, pa.py_buffer(cuts), _bytes(words)])
        coded = pc.ascii_lower(halves).dictionary_encode()
        found = self._simple(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = coded.indices.to_numpy().astype("int64")
        rest = np.flatnonzero(np.array([ids is None for ids in found], bool)[codes[::2]])
        codes[2 * rest] = len(found) + np.arange(len(rest))
        found += self._others(words.take(pa.array(rest)).to_pylist())
        codes[2 * rest + 1] = len(found)
        found.append(b"")
        ids = pa.array(found, pa.large_binary()).take(pa.array(codes))
        return _joined(ids, np.arange(0, len(ids) + 1, 2))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if not self.plain:
            every = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            return [array("I", e.ids).tobytes() for e in every]
        if not texts:
            return []
        split = pc.split_pattern(pa.array([text.replace("\n", " ") for text in texts], pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        return _joined(self._words(coded.dictionary).take(coded.indices), split.offsets.to_numpy()).to_pylist()


def _offsets(values: pa.Array) -> np.ndarray:
    """Where each of ``values`` begins in their bytes, and the end."""
    return np.frombuffer(values.buffers()[1], "<i8")[values.offset:values.offset + len(values) + 1]


def _bytes(values: pa.Array) -> pa.Buffer:
    return values.buffers()[2] or pa.py_buffer(b"")


def _joined(parts: pa.Array, bounds: np.ndarray) -> pa.Array:
    """What stands in ``parts`` from each of ``bounds`` to the next, as one each."""
    cuts = pa.py_buffer(_offsets(parts)[bounds])
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, cuts, _bytes(parts)])


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    chunk, chars = [], 0
    for text in texts:
        chunk.append(text.as_py())
        chars += len(chunk[-1])
        if chars >= CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
    if chunk:
        yield chunk


def order_of(docs: DataFrame) -> Column:
    """Where each row comes in ``docs``: its place in the files Spark wrote, else among the partitions.

    Files are read largest first, so that the place of a row among the partitions is not that in the files.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        number = F.coalesce(F.regexp_extract(meta["file_name"], r"^part-(\d+)", 1).try_cast("long"), F.lit(-1))
        in_files = F.struct(number.alias("part"), meta["file_path"].alias("file"), meta["row_index"].alias("at"))
        docs.select(in_files).schema
    except AnalysisException:  # not Parquet files
        return F.struct(
            F.lit(0).cast("long").alias("part"), F.lit("").alias("file"), F.monotonically_increasing_id().alias("at"))
    return in_files


def cut(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    in_order: bool = False,
) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, ids`` of all rows; ``ids`` as little-endian 32-bit numbers.

    A document is its tokens and ``END_ID``; all its pieces but the last fill a window. A null text
    is empty and yields one piece of length 1. Rows that repeat are cut each on its own. With
    ``in_order`` each piece has the place of its row, see ``order_of``, in the column ``ORDER``.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    version = hashlib.sha256(shared.value.encode()).hexdigest()
    end = np.array([END_ID], "<u4").tobytes()
    schema = "doc_id {}, start long, length long, doc_tokens long, ids binary"
    kept = [ORDER] if in_order else []
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_memo(("packing", version), lambda: WordIds(shared.value))
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column("text")):
                rows, starts, lengths, totals, ids = [], [], [], [], []
                for row, found in enumerate(words.ids(texts), at):
                    found += end
                    total = len(found) // 4
                    for start in range(0, total, window):
                        part = found[4 * start:4 * (start + window)]
                        rows.append(row)
                        starts.append(start)
                        lengths.append(len(part) // 4)
                        totals.append(total)
                        ids.append(part)
                at += len(texts)
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(taken), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary()),
                     *(batch.column(name).take(taken) for name in kept)],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", *kept])

    named = docs.select(
        F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), *([order_of(docs).alias(ORDER)] if in_order else []))
    order = "".join(f", {ORDER} {t}" for n, t in named.dtypes if n == ORDER)
    return map_texts(named, pieces, schema.format(kind) + order)


def _ranges(pieces: DataFrame, count: int, buckets: int) -> DataFrame:
    """``bucket`` and ``turn`` of pieces in the order of ``ORDER``: ranges of ``turn``, as even as can be."""
    cell = [F.col(f"{ORDER}.part"), F.col(f"{ORDER}.file"), F.floor(F.col(f"{ORDER}.at") / CELL_ROWS)]
    keyed = pieces.withColumn(CELL, F.struct(*(c.alias(n) for n, c in zip("pfc", cell))))
    # One row for each file or CELL_ROWS rows of it.
    cells = stored(keyed.groupBy(CELL).agg(F.count("*").alias("n")))
    earlier = Window.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(CELL, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(CELL).orderBy(f"{ORDER}.at", "row")
    turns = keyed.withColumn("turn", F.row_number().over(inside) - 1).join(offsets, CELL)
    turns = turns.withColumn("turn", F.col("turn") + F.col("offset")).drop(CELL, ORDER, "offset")
    return turns.withColumn("bucket", F.floor(F.col("turn") * F.lit(buckets) / F.lit(count)).cast("long"))


def place(pieces: DataFrame, window: int = WINDOW, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``doc_id, start, length``; other columns stay.

    Columns of these two names that come in are replaced.

    Every row gets its place, whatever the number of rows; offsets of a sequence have no gaps. Of
    equal lengths the smaller id comes first. Sequence ids are unique, not consecutive.

    Pieces with the column ``ORDER`` keep that order as far as packing allows: a bucket holds the
    pieces of a range of it, sequence ids rise from bucket to bucket, and within one by the place of
    the longest piece; of equal lengths the earlier one comes first. ``ORDER`` itself goes.
    """
    let_workers_import(pieces.sparkSession)
    in_order = ORDER in pieces.columns
    record = F.struct(*(F.col(f"`{c}`") for c in pieces.columns if c not in (ORDER, "sequence_id", "offset")))
    pieces = stored(pieces.select(
        record.alias(RECORD), "doc_id", "start", "length", *([ORDER] if in_order else []), F.monotonically_increasing_id().alias("row")))
    count = pieces.count()
    buckets = max(1, -(-count // bucket_pieces))
    if in_order:
        bucketed, ties = _ranges(pieces, max(1, count), buckets), ["turn"]
    else:
        bucketed, ties = pieces.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets))), ["doc_id", "start", "row"]

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((name, "ascending") for name in ties)])
        numbers, offsets = best_fit(rows.column("length").to_pylist(), window)
        if in_order:
            firsts = rows.column("turn").to_numpy()[np.unique(numbers, return_index=True)[1]]
            numbers = np.argsort(np.argsort(firsts))[numbers]
        ids = (rows.column("bucket").to_numpy() << 32) + np.array(numbers, "int64")
        return rows.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))

    kept = ", ".join(f"`{name}` {kind}" for name, kind in bucketed.dtypes)
    packed = bucketed.groupBy("bucket").applyInArrow(pack, f"{kept}, sequence_id long, offset long")
    return packed.select(f"{RECORD}.*", "sequence_id", "offset")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Packed pieces of all documents with their token ids, see ``cut`` and ``place``."""
    return place(cut(docs, tokenizer_path, window, id_col, text_col), window)


def packed_digests(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False,
) -> DataFrame:
    """Packed pieces with the CRC-32 of their ids in place of the ids, which so are never shuffled."""
    pieces = cut(docs, tokenizer_path, id_col=id_col, text_col=text_col, in_order=in_order)
    return place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
