"""Registered queries of the operators, with their production parameters, and SQL where it can say the same.

Every query reads its whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from trawl.llm.crf import languages
from trawl.llm.dart_minhash import near_classes
from trawl.llm.exact_dedup import exact_classes
from trawl.llm.learned_partitions import nearest
from trawl.llm.license_scan import licenses
from trawl.llm.mixing import mix
from trawl.llm.packing import packed_digests
from trawl.llm.periodic_runs import periodic_runs
from trawl.llm.ring import shard
from trawl.llm.secret_scan import KINDS, secrets
from trawl.llm.tables import whole_text
from trawl.llm.token_cache import count_tokens
from trawl.llm.warc_zip import archived
from trawl.llm.whitening import whiten
from trawl.session import scratch_dir

#: Target shares of the sources; a source that is not listed shares DEFAULT_SHARE with the other unlisted ones.
SHARES = {"src0": 24} | {f"src{i}": 4 for i in range(1, 20)}
DEFAULT_SHARE = 4
SHARDS = 16
PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COUNTING_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_warc_packages(spark, sf):
    return archived(spark.read.parquet(f"{sf}/pages.parquet"))


def op2_pfair_mix(spark, sf):
    return mix(_documents(spark, sf), SHARES, DEFAULT_SHARE)


def op3_best_fit_packing(spark, sf):
    return packed_digests(_documents(spark, sf), PACKING_TOKENIZER)


def op4_dart_minhash(spark, sf):
    return near_classes(_documents(spark, sf))


def op5_learned_partitions(spark, sf):
    return nearest(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op6_crf_languages(spark, sf):
    return languages(_documents(spark, sf))


def op7_exact_copies(spark, sf):
    return exact_classes(_documents(spark, sf))


def op8_license_scan(spark, sf):
    return licenses(_documents(spark, sf)).drop("starts")


def op9_token_counts(spark, sf):
    """With a cache of its own, so that every run does all the work."""
    return count_tokens(_documents(spark, sf), scratch_dir(spark), COUNTING_TOKENIZER, limit=TOKEN_LIMIT)


def op10_bounded_ring(spark, sf):
    """No slack, so the law is ``rows``: counts of shards are at most one apart."""
    return shard(_documents(spark, sf), SHARDS).select(
        "*", F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def repeated_tails(docs):
    """``doc_id, text``: a tenth of the documents, chosen by id, end in repetitions of a few of their words."""
    chance = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    seed = F.floor(chance / 10).cast("long")
    text = whole_text("text")
    # Only texts that get a tail are cut into words here.
    cut = F.when(chance % 10 == 0, F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    worded = docs.select("doc_id", text.alias("text"), cut.alias("cut"), seed.alias("seed"), F.size(cut).alias("n"))
    placed = worded.withColumn("a", F.when(F.col("n") > 0, F.expr("seed % nullif(n, 0)").cast("int")))
    left = F.col("n") - F.col("a")
    period = (1 + F.floor(left / (3 + F.col("seed") % 8))).cast("int")
    rooted = placed.withColumn("root", F.slice("cut", F.col("a") + 1, period)).withColumn("left", left)
    times = F.ceil(F.col("left") / F.size("root")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat("root", times)), F.lit(1), F.col("left"))
    repeated = F.array_join(F.concat(F.slice("cut", F.lit(1), F.col("a")), tail), " ")
    return rooted.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf):
    found = periodic_runs(repeated_tails(_documents(spark, sf)))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")))
    top = F.array_min(order)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), lines.alias("lines"), "collapsed")
    length = -F.col("top.minus")
    return shown.select(
        "doc_id", "n_runs", F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_embedding_whitening(spark, sf):
    found = whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_secret_scan(spark, sf):
    found = secrets(_documents(spark, sf))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def number_of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(number_of, KINDS[:3])
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES = {name: query for name, query in globals().items() if name.startswith("op") and name[2].isdigit()}

_SHARES = ", ".join(f"('{name}', {share})" for name, share in {**SHARES, "*": DEFAULT_SHARE}.items())

#: The schedule slot by slot: of the released blocks that with the earliest deadline goes next.
_MIX = f"""
        WITH RECURSIVE shares(stream, share) AS (VALUES {_SHARES}),
        sized AS (SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(doc_id::VARCHAR) AS key,
            CASE WHEN source IN (SELECT stream FROM shares) THEN source ELSE '*' END AS stream FROM documents),
        placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY stream ORDER BY key, doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM sized),
        blocks AS (SELECT stream, share::BIGINT AS share, greatest(1, ceil(sum(size) / 16384))::BIGINT AS n
            FROM placed JOIN shares USING (stream) GROUP BY stream, share),
        run AS (SELECT 0::BIGINT AS t, 0::BIGINT AS u, 0 AS phase, NULL::VARCHAR AS stream, NULL::BIGINT AS block, NULL::INT AS in_phase,
                list({{'stream': stream, 'share': share, 'unused': n, 'k': 0::BIGINT, 'done': 0::BIGINT}}) AS s FROM blocks
            UNION ALL SELECT t + 1, CASE WHEN mine.unused = 1 THEN 0 ELSE u + 1 END, phase + (mine.unused = 1)::INT, mine.stream, mine.done, phase,
                list_transform(s, lambda x: {{'stream': x.stream, 'share': x.share, 'unused': x.unused - (x.stream = mine.stream)::BIGINT,
                    'k': CASE WHEN mine.unused = 1 THEN 0 ELSE x.k + (x.stream = mine.stream)::BIGINT END,
                    'done': x.done + (x.stream = mine.stream)::BIGINT}})
            FROM (SELECT *, list_filter(s, lambda x: x.stream = next)[1] AS mine FROM (SELECT *, list_sort(list_transform(
                    list_filter(s, lambda x: x.unused > 0 AND x.k * period // x.share <= u),
                    lambda x: {{'due': ((x.k + 1) * period + x.share - 1) // x.share, 'stream': x.stream}}))[1].stream AS next
                FROM (SELECT *, list_sum(list_transform(list_filter(s, lambda x: x.unused > 0), lambda x: x.share))::BIGINT AS period
                    FROM run) WHERE period IS NOT NULL))),
        slots AS (SELECT stream, block, in_phase AS phase, t - 1 AS slot FROM run WHERE stream IS NOT NULL)
        SELECT p.doc_id, p.source, p.size, p.stream, p.before, s.block, s.phase, s.slot FROM placed p JOIN blocks b USING (stream)
        JOIN slots s ON s.stream = p.stream AND s.block = least(p.before // 16384, b.n - 1)
    """

#: The walk around the ring cell by cell and node by node; CRC-32 byte by byte.
_RING = """
        WITH RECURSIVE bits AS (SELECT range AS byte, 0 AS step, range AS crc FROM range(256)
            UNION ALL SELECT byte, step + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END FROM bits WHERE step < 8),
        crc_table AS (SELECT list(crc ORDER BY byte) AS crcs FROM bits WHERE step = 8),
        hashed AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, ('0x' || md5(doc_id::VARCHAR)[1:15])::BIGINT AS hash FROM documents),
        summed AS (SELECT doc_id, hash, octet_length(raw)::BIGINT + 1 AS size, xor(4294967295, list_reduce(list_transform(
                regexp_extract_all(hex(raw), '..'), lambda pair: ('0x' || pair)::BIGINT),
                lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32
            FROM hashed, crc_table),
        keyed AS (SELECT *, hash >> 48 AS place, row_number() OVER (PARTITION BY hash >> 48 ORDER BY hash, doc_id) - 1 AS nth FROM summed),
        nodes AS (SELECT ('0x' || md5(shard || '/' || twin)[1:8])::BIGINT % 4096 AS place, shard
            FROM range(16) shards(shard), range(64) twins(twin)),
        cells AS (SELECT place, n, (SELECT count(*) FROM nodes WHERE nodes.place < filled.place) AS node
            FROM (SELECT place, count(*) AS n FROM keyed GROUP BY place) filled),
        fixed AS (SELECT (SELECT list(shard ORDER BY place, shard) FROM nodes) AS owners, (SELECT count(*) FROM keyed) AS total,
            (SELECT list({'place': place, 'n': n, 'node': node} ORDER BY place) FROM cells) AS every),
        run AS (SELECT 1::BIGINT AS i, every[1].n AS unplaced, every[1].node AS node, 0::BIGINT AS lo,
                list_transform(range(16), lambda x: 0::BIGINT) AS filled,
                NULL::BIGINT AS place, NULL::BIGINT AS shard, NULL::BIGINT AS from_nth, NULL::BIGINT AS first, 0::BIGINT AS taken FROM fixed
            UNION ALL SELECT CASE WHEN unplaced > took THEN i ELSE i + 1 END, CASE WHEN unplaced > took THEN unplaced - took ELSE every[i + 1].n END,
                CASE WHEN unplaced > took THEN node + 1 ELSE every[i + 1].node END, CASE WHEN unplaced > took THEN lo + took ELSE 0 END,
                list_transform(filled, lambda x, j: x + CASE WHEN j = owner + 1 THEN took ELSE 0 END),
                every[i].place, owner, lo, filled[owner + 1], took
            FROM (SELECT *, least(total // 16 + (owner < total % 16)::BIGINT - filled[owner + 1], unplaced) AS took
                FROM (SELECT i, unplaced, node, lo, filled, every, total, owners[node % 1024 + 1] AS owner FROM run, fixed WHERE i <= len(every))))
        SELECT k.doc_id, k.size, k.text_crc32, 'rows' AS law, r.shard::INT AS shard, r.first + k.nth - r.from_nth AS slot, NULL::INT AS grown_shard
        FROM keyed k JOIN run r ON r.place = k.place AND r.taken > 0 AND k.nth >= r.from_nth AND k.nth < r.from_nth + r.taken
    """

#: Runs period by period: stretches of places whose word stands a period before them too; of several periods of one
#: stretch the smallest counts.
_RUNS = r"""
        WITH RECURSIVE bits AS (SELECT range AS byte, 0 AS step, range AS crc FROM range(256)
            UNION ALL SELECT byte, step + 1, CASE WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END FROM bits WHERE step < 8),
        crc_table AS (SELECT list(crc ORDER BY byte) AS crcs FROM bits WHERE step = 8),
        cut AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda pair: ('0x' || pair)::BIGINT),
                    lambda crc, byte: xor(crc >> 8, crcs[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT)) AS h
            FROM documents, crc_table),
        sized AS (SELECT *, len(words) AS n, h % 10 = 0 AND len(words) > 0 AS tailed, h // 10 AS g FROM cut),
        placed AS (SELECT *, CASE WHEN tailed THEN g % n END AS a FROM sized),
        rooted AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
        word AS (SELECT row, n, i, CASE WHEN tailed AND i >= a THEN words[a + (i - a) % p + 1] ELSE words[i + 1] END AS w
            FROM (SELECT *, unnest(range(n)) AS i FROM rooted)),
        same AS (SELECT x.row, x.i - y.i AS q, x.i FROM word x JOIN word y ON x.row = y.row AND x.w = y.w AND y.i < x.i AND (x.i - y.i) * 4 <= x.n),
        stretch AS (SELECT row, q, min(i) - q AS start, count(*) + q AS length
            FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM same) GROUP BY row, q, island),
        runs AS (SELECT row, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY row, start, length),
        summary AS (SELECT row, count(*) AS n_runs, min({'minus': -length, 'start': start, 'period': period}) AS top,
                string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY row),
        kept AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS collapsed FROM word
            WHERE NOT EXISTS (FROM runs WHERE runs.row = word.row AND i >= start + period AND i < start + length) GROUP BY row)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, -top.minus AS length, top.period AS period,
            (-1000 * top.minus) // top.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
            sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM cut LEFT JOIN summary USING (row) LEFT JOIN kept USING (row)
    """

ORACLES = {
    "op11_periodic_runs": _RUNS,
    "op2_pfair_mix": _MIX,
    "op10_bounded_ring": _RING,
    "op1_warc_packages": """
        WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        firsts AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest,
            min(page_id) OVER (PARTITION BY payload) AS first FROM payloads),
        marked AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first AS again FROM firsts)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN again THEN first END AS refers_to FROM marked
    """,
    "op7_exact_copies": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
