"""Inverted index as tables: postings, document lengths, block bounds, vocabulary, corpus statistics.

``len`` sits in every posting, so a search is one join and one aggregate. A written index buckets its
postings by document id: all postings of a document lie in one bucket, and the per-(query, document)
sum of a search needs no shuffle. Within a bucket documents of similar length form blocks, and the
largest repetition and the least length of each term in each block bound what it can add to a score.

A build stands in a folder of its own. Postings are appended to it under version numbers, and what
follows from them is kept by version as well: document frequencies, lengths and bounds of the new
documents alone, summed when they are read. A small file, the manifest, names the build and the
versions that count. It is written last, under the next number, so a build or an extension that
breaks off leaves the index as it was, and a rebuild leaves no time without one.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trawl import manifest
from trawl.functions.text import ANALYZERS
from trawl.session import plan_bytes, qualified, quoted, scratch_dir, shuffle_partitions

# Documents of the sample that score bounds are taken from, about; a smaller index is sampled whole.
SAMPLE_DOCUMENTS = 50_000
# Default number of buckets: one per so many bytes of input. The postings of a bucket are sorted in one task.
BUCKET_BYTES = 32 * 1024 * 1024
# Sizes above this are no estimate: Spark knows nothing about the input.
UNKNOWN_BYTES = 1 << 60
# Documents of a block.
BLOCK_DOCUMENTS = 128
# Rows of a Parquet page of the postings: what is skipped is skipped by pages.
PAGE_ROWS = 4096
# Words in this share of some first documents count as frequent; an index with positions stores the
# places of pairs with a frequent word. It decides the layout only, not what is found.
FREQUENT_SHARE = 0.3
FREQUENT_FROM = 400
# Kinds of rows of the postings table, a partition each.
DOCUMENT, POSTING, PAIR = 0, 1, 2
# Files a task of a build writes at once: a few buckets with all kinds of rows.
OPEN_FILES = 12
WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"
# Between a token and its place; no analyzer leaves a line feed in a token.
PLACE_MARK = "\n"
# Added to places, so that all are written with the same number of digits.
PLACE_BASE = 1_000_000_000


@dataclass(frozen=True)
class Index:
    """Tables of one index; ``by`` names the columns that tell corpora apart.

    postings  by, id, term, tf, len, block  one row per distinct term of a document; with
                                            ``positional`` also positions, its places in the text
    doclens   by, id, len, terms            every document, empty ones included
    vocab     by, term, df, n, avgdl        n and avgdl repeat the statistics of the corpus
    stats     by, n, avgdl, postings        one row per corpus
    blocks    by, term, block, tf, len      the largest tf and the least len in the block
    sample    as postings                   all postings of some documents, for score bounds
    units     as postings                   postings, and pairs of words with a frequent one among them,
                                            joined by a blank; only with ``positional``
    frequent  the frequent words, rising
    """

    postings: DataFrame
    doclens: DataFrame
    vocab: DataFrame
    stats: DataFrame
    analyzer: str
    by: tuple[str, ...] = ()
    sample: DataFrame | None = None
    positional: bool = False
    blocks: DataFrame | None = None
    units: DataFrame | None = None
    frequent: tuple[str, ...] = ()
    path: str | None = None
    buckets: int | None = None


def analyse(docs: DataFrame, analyzer: str, by: tuple[str, ...] = (), with_id: bool = False) -> DataFrame:
    """``(by, id, tokens)``. ``with_id`` puts the tokens of the id in front of those of the contents.

    An empty token between the two keeps phrases from crossing; it is never a posting.
    """
    tokens = ANALYZERS[analyzer](F.col("contents"))
    if with_id:
        tokens = F.concat(ANALYZERS[analyzer](F.col("id")), F.array(F.lit("")), tokens)
    return docs.select(*by, F.col("id").cast("string").alias("id"), tokens.alias("tokens"))


def count_terms(
    analysed: DataFrame, by: tuple[str, ...] = (), with_id: bool = False, positional: bool = False,
    frequent: tuple[str, ...] = (),
) -> DataFrame:
    """``(by, id, len, counts)``, counts being ``array<struct<term, tf[, positions]>>``: a narrow step.

    Equal tokens lie side by side once sorted; a term's count is the distance between run starts.
    Places are sorted as part of the token's text, which is far quicker than sorting structs.
    ``with_id`` says that the tokens hold the separator of ``analyse``. Two neighbouring tokens of
    which one is ``frequent`` are counted as a term of their own too, joined by a blank.
    """
    tokens = F.filter("tokens", lambda t: t != "") if with_id else F.col("tokens")
    kept = analysed.select(*by, "id", "tokens", F.size(tokens).alias("len"))
    every = tokens
    if positional:
        marked = lambda i: F.concat(F.lit(PLACE_MARK), (i + PLACE_BASE).cast("string"))
        every = F.transform("tokens", lambda t, i: F.concat(t, marked(i)))
        if with_id:
            every = F.filter(every, lambda t: ~t.startswith(PLACE_MARK))
    if positional and frequent:
        known = list(frequent)

        def pair(t: Column, i: Column) -> Column:
            after = F.get("tokens", i + 1)
            apart = F.lit(False) if not with_id else (t == "") | (after == "")
            # Null where there is no token after this one.
            return F.when((t.isin(known) | after.isin(known)) & ~apart, F.concat(t, F.lit(" "), after, marked(i)))

        every = F.concat(every, F.filter(F.transform("tokens", pair), lambda p: p.isNotNull()))
    kept = kept.select(*by, "id", "len", F.sort_array(every).alias("sorted"))
    if positional:
        # The digits have a fixed number, the mark is one more.
        digits = len(str(PLACE_BASE))
        kept = kept.select(
            *by, "id", "len", F.transform("sorted", lambda t: F.substring_index(t, PLACE_MARK, 1)).alias("sorted"),
            F.transform("sorted", lambda t: F.right(t, F.lit(digits)).cast("int") - PLACE_BASE).alias("places"))
    places = ["places"] if positional else []
    sized = kept.select(*by, "id", "len", "sorted", *places, F.size("sorted").alias("entries"))
    run_starts = F.filter(
        F.sequence(F.lit(1), F.col("entries")), lambda i: (i == 1) | (F.get("sorted", i - 1) != F.get("sorted", i - 2)),
    )
    starts = sized.select(
        *by, "id", "len", "sorted", *places, "entries",
        F.when(F.col("entries") > 0, run_starts).otherwise(F.array().cast("array<int>")).alias("starts"),
    )

    def run(start: Column, nth: Column) -> Column:
        end = F.coalesce(F.get("starts", nth + 1), F.col("entries") + 1)
        parts = [F.get("sorted", start - 1).alias("term"), (end - start).alias("tf")]
        if positional:
            parts.append(F.slice("places", start, end - start).alias("positions"))
        return F.struct(*parts)

    return starts.select(*by, "id", "len", F.transform("starts", run).alias("counts"))


def _stats(doclens: DataFrame, by: tuple[str, ...], *more: Column) -> DataFrame:
    return doclens.groupBy(*by).agg(F.count("*").alias("n"), (F.sum("len") / F.count("*")).alias("avgdl"), *more)


def _vocab(postings: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return postings.groupBy(*by, "term").agg(F.count("*").alias("df"))


def postings_of(docs: DataFrame, analyzer: str = "plain", by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, id, term, tf, len)`` without writing anything."""
    counts = count_terms(analyse(docs, analyzer, by), by)
    # The outer form keeps Catalyst from inferring a filter on the array, which would run the whole
    # analysis a second time below.
    flat = counts.select(*by, "id", F.explode_outer("counts").alias("count"), "len")
    return flat.select(*by, "id", "count.*", "len").filter("term IS NOT NULL")


def doc_lengths(docs: DataFrame, analyzer: str = "plain", by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, id, len)``; one row per document already, so nothing is shuffled."""
    return analyse(docs, analyzer, by).select(*by, "id", F.size("tokens").alias("len"))


def doc_freq(docs: DataFrame, analyzer: str = "plain", by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, term, df)``: repeats within a document go before the shuffle."""
    terms = analyse(docs, analyzer, by).select(*by, F.explode_outer(F.array_distinct("tokens")).alias("term"))
    return _vocab(terms.filter("term IS NOT NULL"), by)


def corpus_stats(docs: DataFrame, analyzer: str = "plain", by: tuple[str, ...] = ()) -> DataFrame:
    """``(by, n, avgdl)``."""
    return _stats(doc_lengths(docs, analyzer, by), by)


def default_buckets(docs: DataFrame) -> int:
    """Buckets for an index of ``docs``, by the size of its input as Catalyst knows it.

    They are a multiple of the cores, as the work of a build and of a search goes by buckets: a last
    round of a few tasks would leave the other cores idle for as long as a full one takes.
    """
    spark, size = docs.sparkSession, plan_bytes(docs)
    partitions = shuffle_partitions(spark)
    if size > UNKNOWN_BYTES:
        return partitions
    least = min(partitions, spark.sparkContext.defaultParallelism)
    return least * max(1, math.ceil(size / (BUCKET_BYTES * least)))


def _flat(counts: DataFrame, by: tuple[str, ...], version: int) -> DataFrame:
    """Rows of the postings table: one per document, one per term, one per stored pair.

    ``counts`` lie in their buckets; documents of similar length share a block of their bucket.
    """
    placed = counts.sortWithinPartitions("len", "id").withColumn("place", F.monotonically_increasing_id())
    bucket = F.shiftright("place", 33)
    nth = F.floor(F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) / BLOCK_DOCUMENTS).cast("long")
    # The bucket comes last, so that what lies between two blocks is alike in all buckets: Parquet
    # skips pages by the least and the largest of the blocks asked for.
    block = F.lit(version << 44) + F.shiftleft(nth, 24) + bucket
    kind = dict(counts.dtypes)["counts"].removeprefix("array<").removesuffix(">")
    single = F.filter("counts", lambda c: F.instr(c["term"], " ") == 0) if "positions" in kind else F.col("counts")
    fields = [F.lit(None).cast("string").alias("term"), F.size(single).alias("tf")]
    if "positions" in kind:
        fields.append(F.lit(None).cast("array<int>").alias("positions"))
    every = F.concat(F.array(F.struct(*fields)), "counts")
    flat = placed.select(*by, "id", "len", block.alias("block"), F.explode_outer(every).alias("count"))
    pair = F.instr("count.term", " ") > 0
    row = F.when(F.col("count.term").isNull(), DOCUMENT).when(pair, PAIR).otherwise(POSTING)
    return flat.select(*by, "id", "count.*", "len", "block", F.lit(version).alias("version"), row.alias("kind"))


def _table_name(folder: str) -> str:
    """The catalog name of an index's postings, one per folder."""
    return f"trawl_{hashlib.md5(folder.encode()).hexdigest()}_postings"


def _manifest(spark: SparkSession, path: str) -> dict:
    """What the newest manifest says."""
    facts = manifest.newest(spark, path)
    if facts is None:
        raise ValueError(f"no index in {path}")
    return facts


def _publish(spark: SparkSession, path: str, facts: dict) -> None:
    """Make ``facts`` the newest manifest. The build before this one stays, for who has it open; older ones go."""
    older = manifest.publish(spark, path, facts)
    before = [held["build"] for held in older.values() if held["build"] != facts["build"]]
    for name, held in older.items():
        if held["build"] not in (facts["build"], *before[-1:]):
            for gone in (f"{manifest.FOLDER}/{name}", held["build"]):
                manifest.remove(spark, f"{path}/{gone}")
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(path + '/' + held['build'])}")


def _append(flat: DataFrame, folder: str, buckets: int) -> dict:
    """Write rows of one version; gives the counts that come with the write.

    A task holds one bucket and sorts it by term itself: Spark's own sort for a partitioned and
    bucketed table begins with columns that are alike in the whole task, and is much slower.
    """
    spark, seen = flat.sparkSession, Observation()
    document, posting = F.col("kind") == DOCUMENT, F.col("kind") == POSTING
    flat = flat.observe(
        seen, F.count_if(document).alias("n"), F.coalesce(F.sum(F.when(document, F.col("len").cast("long"))), F.lit(0)).alias("tokens"),
        F.count_if(posting).alias("postings"))
    writer = (
        flat.sortWithinPartitions("term", "block").write.mode("append").format("parquet").option("path", f"{folder}/postings")
        .option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("version", "kind").bucketBy(buckets, "id")
    )
    before = spark.conf.get(WRITERS_CONF)
    spark.conf.set(WRITERS_CONF, OPEN_FILES)
    try:
        writer.saveAsTable(_table_name(folder))
    finally:
        spark.conf.set(WRITERS_CONF, before)
    return seen.get


def _catalogued(spark: SparkSession, folder: str, fields: list[str], buckets: int) -> DataFrame:
    """The postings as a bucketed table of the session's catalog."""
    table = _table_name(folder)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    spark.sql(
        f"CREATE TABLE {table} ({', '.join(fields)}, version INT, kind INT) USING parquet PARTITIONED BY (version, kind) "
        f"CLUSTERED BY (id) INTO {buckets} BUCKETS LOCATION {quoted(folder + '/postings')}"
    )
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def _write(df: DataFrame, folder: str) -> int:
    """Write a table; gives its number of rows."""
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows")).write.parquet(folder)
    return seen.get["rows"]


def _counts_of(docs: DataFrame, facts: dict) -> DataFrame:
    by = tuple(facts["by"])
    analysed = analyse(docs, facts["analyzer"], by, facts["with_id"])
    counts = count_terms(analysed, by, facts["with_id"], facts["positional"], tuple(facts["frequent"]))
    # Counted before the shuffle: one row per document travels, holding each term once.
    return counts.repartition(facts["buckets"], "id")


def _frequent_words(docs: DataFrame, analyzer: str) -> list[str]:
    """Words in a good share of some first documents."""
    # The empty word counts the documents.
    words = F.array_union(ANALYZERS[analyzer](F.col("contents")), F.array(F.lit("")))
    found = docs.limit(FREQUENT_FROM).select(F.explode(words).alias("term")).groupBy("term").count()
    counts = {r.term: r["count"] for r in found.collect()}
    least = FREQUENT_SHARE * counts.pop("", 0)
    return sorted(term for term, n in counts.items() if n > least)


def build_index(
    docs: DataFrame,
    analyzer: str = "plain",
    by: tuple[str, ...] = (),
    with_id: bool = False,
    positional: bool = False,
    path: str | None = None,
    buckets: int | None = None,
    batch: str | None = None,
) -> Index:
    """Analyse ``docs (by, id, contents)`` once and write the index tables.

    ``path`` defaults to a new folder under the shared checkpoint folder; an index that stands there
    is replaced, in one step and after all else. ``positional`` stores the places of terms, for
    phrases. An id that occurs twice in a corpus is an error. ``batch`` names these documents for
    ``extend_index``.
    """
    spark = docs.sparkSession
    path = qualified(spark, path or scratch_dir(spark))
    facts = {
        "build": f"build-{uuid.uuid4().hex}", "analyzer": analyzer, "by": list(by), "buckets": buckets or default_buckets(docs),
        "with_id": with_id, "positional": positional, "frequent": _frequent_words(docs, analyzer) if positional else [],
        "versions": [], "vocab": [],
    }
    return _add(docs, path, facts, 1, batch)


def _add(docs: DataFrame, path: str, facts: dict, version: int, batch: str | None) -> Index:
    """Write ``docs`` as a version of a build, and what follows from them alone; then publish it."""
    spark, by = docs.sparkSession, tuple(facts["by"])
    folder = f"{path}/{facts['build']}"
    flat = _flat(_counts_of(docs, facts), by, version)
    facts = facts | {"fields": [f"`{name}` {kind}" for name, kind in flat.dtypes if name not in ("version", "kind")]}
    if facts["versions"]:
        _catalogued(spark, folder, facts["fields"], facts["buckets"])
    counted = _append(flat, folder, facts["buckets"])
    facts["versions"] = [*facts["versions"], {"version": version, "batch": batch, **counted}]
    table = _rows(spark.table(_table_name(folder)), facts)
    twice = table.filter(F.col("kind") == DOCUMENT).groupBy(*by, "id").count().filter("count > 1").select("id").take(3)
    if twice:
        manifest.remove(spark, f"{folder}/postings/version={version}")
        raise ValueError(f"duplicate id: {[row[0] for row in twice]}")
    own = table.filter(F.col("version") == version)
    bounds = own.filter(F.col("kind") == POSTING).groupBy(*by, "term", "block").agg(
        F.max("tf").alias("tf"), F.min("len").alias("len"), F.count("*").alias("df"))
    _write(bounds.sortWithinPartitions("term", "block"), f"{folder}/blocks/version={version}")
    bounds = spark.read.schema(bounds.schema).parquet(f"{folder}/blocks/version={version}")
    frequencies = bounds.groupBy(*by, "term").agg(F.sum("df").alias("df")).sortWithinPartitions("term")
    facts["vocab"] = [*facts["vocab"], {"name": f"{version}", "rows": _write(frequencies, f"{folder}/vocab/{version}")}]
    if by:
        lengths = own.filter(F.col("kind") == DOCUMENT).groupBy(*by)
        sizes = lengths.agg(F.count("*").alias("n"), F.sum("len").alias("tokens"), F.sum("tf").alias("postings"))
        _write(sizes.coalesce(1), f"{folder}/stats/version={version}")
    facts["vocab"] = _merged(spark, folder, by, facts["vocab"])
    _publish(spark, path, facts)
    return _opened(spark, path, facts, spark.table(_table_name(folder)))


def _merged(spark: SparkSession, folder: str, by: tuple[str, ...], vocab: list[dict]) -> list[dict]:
    """Document frequencies by version, two neighbours of similar size made one: their number grows by a logarithm."""
    while len(vocab) > 1 and vocab[-2]["rows"] <= 2 * vocab[-1]["rows"]:
        name = f"{vocab[-2]['name']}+{vocab[-1]['name']}"
        both = spark.read.parquet(*(f"{folder}/vocab/{part['name']}" for part in vocab[-2:]))
        sums = both.groupBy(*by, "term").agg(F.sum("df").alias("df")).sortWithinPartitions("term")
        # What a merge that broke off has left is written over.
        manifest.remove(spark, f"{folder}/vocab/{name}")
        vocab = [*vocab[:-2], {"name": name, "rows": _write(sums, f"{folder}/vocab/{name}")}]
    return vocab


def _rows(table: DataFrame, facts: dict) -> DataFrame:
    return table.filter(F.col("version").isin([v["version"] for v in facts["versions"]]))


def _statistics(spark: SparkSession, folder: str, facts: dict) -> DataFrame:
    """``(by, n, avgdl, postings)`` of all versions."""
    by, versions = facts["by"], facts["versions"]
    if by:
        parts = spark.read.parquet(*(f"{folder}/stats/version={v['version']}" for v in versions))
        sums = parts.groupBy(*by).agg(*(F.sum(name).alias(name) for name in ("n", "tokens", "postings")))
        return sums.select(*by, "n", (F.col("tokens") / F.col("n")).alias("avgdl"), "postings")
    n, tokens, postings = (sum(v[name] for v in versions) for name in ("n", "tokens", "postings"))
    avgdl = F.lit(tokens / n if n else None).cast("double")
    return spark.range(1 if n else 0).select(F.lit(n).cast("long").alias("n"), avgdl.alias("avgdl"), F.lit(postings).cast("long").alias("postings"))


def _sample(spark: SparkSession, folder: str, schema, facts: dict) -> DataFrame:
    """The postings of whole buckets, as many as hold enough documents; one is thinned out if it holds too many."""
    documents, buckets = sum(v["n"] for v in facts["versions"]), facts["buckets"]
    whole = min(buckets, math.ceil(SAMPLE_DOCUMENTS * buckets / max(1, documents)))
    read = spark.read.schema(schema)
    if whole < buckets:
        read = read.option("pathGlobFilter", "*_{" + ",".join(f"{i:05d}" for i in range(whole)) + "}.c*")
    picked = _rows(read.parquet(f"{folder}/postings"), facts).filter(F.col("kind") == POSTING)
    share = SAMPLE_DOCUMENTS * buckets / max(1, documents * whole)
    if share < 1:
        picked = picked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    return picked


def _opened(spark: SparkSession, path: str, facts: dict, table: DataFrame) -> Index:
    folder, by = f"{path}/{facts['build']}", tuple(facts["by"])
    rows = _rows(table, facts)

    def kind(*kinds: int) -> DataFrame:
        return rows.filter(F.col("kind").isin(*kinds)).drop("version", "kind")

    stats = _statistics(spark, folder, facts)
    vocab = spark.read.parquet(*(f"{folder}/vocab/{part['name']}" for part in facts["vocab"]))
    if len(facts["vocab"]) > 1:
        vocab = vocab.groupBy(*by, "term").agg(F.sum("df").alias("df"))
    if by:
        vocab = vocab.join(stats.select(*by, "n", "avgdl"), list(by))
    else:
        n, tokens = (sum(v[name] for v in facts["versions"]) for name in ("n", "tokens"))
        vocab = vocab.withColumns({"n": F.lit(n).cast("long"), "avgdl": F.lit(tokens / n if n else None).cast("double")})
    blocks = spark.read.parquet(*(f"{folder}/blocks/version={v['version']}" for v in facts["versions"]))
    doclens = kind(DOCUMENT).select(*by, "id", "len", F.col("tf").alias("terms"))
    sample = _sample(spark, folder, table.schema, facts).drop("version", "kind", "positions")
    return Index(
        kind(POSTING), doclens, vocab, stats, facts["analyzer"], by, sample, facts["positional"], blocks.drop("df"),
        kind(POSTING, PAIR) if facts["positional"] else None, tuple(facts["frequent"]), path, facts["buckets"])


def open_index(spark: SparkSession, path: str) -> Index:
    """Read an index written by ``build_index``."""
    path = qualified(spark, path)
    facts = _manifest(spark, path)
    table = _catalogued(spark, f"{path}/{facts['build']}", facts["fields"], facts["buckets"])
    return _opened(spark, path, facts, table)


def extend_index(docs: DataFrame, path: str, batch: str | None = None) -> Index:
    """Add documents to a written index; only they are analysed and counted.

    Of what was indexed before, only the ids are read. An id the index has already, or that occurs
    twice, is an error and changes nothing. A ``batch`` that the index holds is not added again.
    """
    spark = docs.sparkSession
    path = qualified(spark, path)
    facts = _manifest(spark, path)
    if batch is not None and batch in [v["batch"] for v in facts["versions"]]:
        return open_index(spark, path)
    # A version whose extension broke off keeps its number; its rows count no more.
    used = [int(name.split("=")[1]) for name in manifest.names(spark, f"{path}/{facts['build']}/postings") if name.startswith("version=")]
    used += [v["version"] for v in facts["versions"]]
    return _add(docs, path, facts, 1 + max(used), batch)


def drop_index(spark: SparkSession, path: str) -> None:
    """Remove an index, its files and its names in the session's catalog."""
    path = qualified(spark, path)
    for name in manifest.names(spark, path):
        if name.startswith("build-"):
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(f'{path}/{name}')}")
    manifest.remove(spark, path)
