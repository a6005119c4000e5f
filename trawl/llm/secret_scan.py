"""Secrets in texts: three fixed patterns, and strings in a sensitive place that do not compress.

A string that follows a word like ``authorization`` is a candidate. Its novelty is what it adds to
the size of the text around it, compressed by zstandard with a dictionary of identifiers: names made
of known words cost few bytes, random keys as many as their letters allow at best. The dictionary
holds a fixed list and the identifiers that are frequent in the texts themselves, counted over all
of them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.llm.tables import map_texts, stored, whole_text

# The base patterns and their least lengths, of group 2 in the first, else of the match.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Kinds in the order of spans with the same start; the last is the method's own.
KINDS = ("assign", "access", "hex", "novel")

#: At least 16 characters of a key in some usual alphabet, and what base64 may be filled up with.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Words that make the rest of their line sensitive, as far as ``REACH`` characters.
SENSITIVE = re.compile(
    r"(?i:pass(?:word|wd|phrase|code)|pwd|secret|token|key|auth|bearer|credential|signature)", re.ASCII)
REACH = 64
#: Characters on either side against which a candidate is compressed.
AROUND = 256
#: Reported from so many bytes a character on. Random keys take 0.8 to 1, names of known words 0.4 to 0.8.
LEAST_NOVELTY = 0.8
SHORTEST_MATCH = 4

#: Identifiers of programs and their settings, without regard to a corpus.
IDENTIFIERS = (
    "access account address agent alpha array async auth await base bearer bool boolean break bucket buffer bytes cache "
    "callback case catch char class client cloud code config connection const context control cookie count create "
    "credential data database date debug decode default delete device digest double else email enable encode endpoint "
    "enum error event example exception export extends false field file final find float from function global group "
    "handler hash header hidden host http https identifier import include index init input insert instance integer "
    "interface internal item json label length level library list local login long manager message method model module "
    "name namespace node null number object offset open option order output package page param parent parse password "
    "path pattern payload port prefix print private process profile property protected provider proxy public query queue "
    "random range read record refresh region register release remote remove replace request require reset resource "
    "response result return role root route sample schema scope script search secret select self sequence server service "
    "session setting short signature size socket source start state static status storage store stream string struct "
    "submit suffix super switch sync system table target task template test text thread throw time timeout timestamp "
    "title token tool total trace true type union unique unit unsigned update upload user username util valid value "
    "vector verify version view virtual void while window with worker write yield"
).split()

_CAPITALS = " ".join([*(word.upper() for word in IDENTIFIERS), *(word.capitalize() for word in IDENTIFIERS)])
#: Text that every dictionary holds.
PRIMER = _CAPITALS[:256].encode()

#: An identifier in a text, whole; at most 12 letters, so that no candidate is one.
WORD = r"(?<![A-Za-z0-9])[A-Za-z]{3,12}(?![A-Za-z0-9])"
#: Identifiers with this share of all of them enter the dictionary: 1000 at most, whatever the corpus.
FREQUENT = 0.001
#: Counters of the summary that nominates them; its error is 3.5 / COUNTERS at most, below ``FREQUENT``.
COUNTERS = 8192


def frequent_identifiers(docs: DataFrame, text_col: str = "text", share: float = FREQUENT) -> list[str]:
    """Identifiers with at least ``share`` of all their kind in all texts, rarest first.

    A mergeable summary nominates them, one per task; the nominated are counted exactly. Each text
    counts an identifier once.
    """
    words = docs.select(F.array_distinct(F.regexp_extract_all(whole_text(text_col), F.lit(WORD), F.lit(0))).alias("words"))
    each = words.select(F.explode_outer("words").alias("word")).filter("word IS NOT NULL")
    few = math.ceil(1 / share)
    top = each.agg(F.count("*").alias("total"), F.expr(f"approx_top_k(word, {2 * few}, {COUNTERS})").alias("top"))
    top = stored(top)
    total = top.first().total
    # At most 2 / share words of at most 12 letters.
    nominated = F.broadcast(top.select(F.inline("top")).select(F.col("item").alias("word")))
    counts = each.join(nominated, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    found = counts.filter(F.col("n") >= share * total).collect() if total else []
    return [row.word for row in sorted(found, key=lambda row: (row.n, row.word))]


def dictionary_of(frequent: list[str]) -> bytes:
    """Dictionary content, the most frequent last, where references to it are cheapest."""
    known = set(frequent)
    return " ".join([_CAPITALS, *(word for word in IDENTIFIERS if word not in known), *frequent]).encode()


def compressor_of(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Matches alone compress: letters of their own are stored as they are, so that novel text costs a byte each."""
    fast = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=SHORTEST_MATCH, hash_log=15, window_log=17,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=fast)


def _mixed(text: str) -> bool:
    """Digits among letters, or capitals within a word; plain words are no candidates."""
    letters = any(c.isalpha() for c in text)
    return letters and (any(c.isdigit() for c in text) or not (text[1:].islower() or text.isupper()))


def novelty(compressor: zstandard.ZstdCompressor, text: str, start: int, stop: int) -> float:
    """Marginal compressed bytes of ``text[start:stop]`` in its surroundings, by character: about 1 for random letters.

    Other places of the same string in the surroundings do not count for it. ``PRIMER`` is known to
    the dictionary; behind it no block is so poor in matches that zstandard stores it as it is.
    """
    found = text[start:stop]
    around = PRIMER + (text[max(0, start - AROUND):start] + "\n" + text[stop:stop + AROUND]).replace(found, "").encode()
    added = len(compressor.compress(around + found.encode())) - len(compressor.compress(around))
    return added / len(found)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in order; kinds by their number in ``KINDS``."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def novel_spans(text: str, base: list[tuple[int, int, int]], compressor: zstandard.ZstdCompressor, least: float) -> dict:
    """Novelty of the candidates that reach ``least`` and touch no base span, by ``(start, end)``."""
    found = {}
    for match in CANDIDATE.finditer(text):
        start, stop = match.span()
        if not _mixed(match.group()) or any(a < stop and start < b for a, _, b in base):
            continue
        line = text.rfind("\n", max(0, start - REACH), start) + 1
        if SENSITIVE.search(text, max(line, start - REACH), start):
            added = novelty(compressor, text, start, stop)
            if added >= least:
                found[start, stop] = added
    return found


def secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_novelty: float = LEAST_NOVELTY,
    identifiers: list[str] | None = None,
) -> DataFrame:
    """``doc_id, spans`` of every row, spans being ``kind, start, stop, novelty``.

    Places are code points, ``stop`` is exclusive; spans are in order of start, then of ``KINDS``.
    The kinds assign, access and hex are fixed patterns, leftmost and without overlap within a kind,
    and have no novelty; novel is the method's own, and never overlaps one of the others.
    ``identifiers`` replaces those counted in the texts. Texts are read whole; a null or empty text
    has no spans. Rows with null or repeated ids are rows like others; other columns do not matter.
    """
    frequent = frequent_identifiers(docs, text_col) if identifiers is None else identifiers
    dictionary = dictionary_of(frequent)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("novelty", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = compressor_of(dictionary)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                novel = novel_spans(text, base, compressor, least_novelty)
                every = sorted([*base, *((start, 3, stop) for start, stop in novel)])
                found.append([(KINDS[kind], start, stop, novel.get((start, stop)) if kind == 3 else None)
                              for start, kind, stop in every])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    kind = dict(rows.dtypes)["doc_id"]
    return map_texts(
        rows, scan, f"doc_id {kind}, spans array<struct<kind: string, start: long, stop: long, novelty: double>>")
