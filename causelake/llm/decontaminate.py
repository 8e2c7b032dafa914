"""Benchmark decontamination in DataFrame functions only.

For each benchmark item, windows of documents as long as the item are fingerprinted by SimHash
over their word shingles.  Fingerprints meet through a multi-index of ``BLOCKS`` wide blocks: the
radius is dealt out to the blocks so that two fingerprints within it are within a block's own small
radius in one block at least; of the item every block value in that radius is a key, of the window
its own.  Only keys and fingerprints are joined; the arrays of shingles come after the Hamming filter.
Candidates are verified exactly: weighted Jaccard similarity of shingles, weights being their counts.

Which windows need a fingerprint is decided without loss: a window as similar as asked for shares
a shingle with the item, so only windows over a shared shingle are built.  What is broadcast has a
bound that is checked (``MAX_ITEM_ROWS`` shingle rows, ``MAX_KEYS`` index rows); beyond it the same
joins shuffle.  Documents with a shared shingle, and those found, are written and counted first: up to
a bound their ids are broadcast to the texts, beyond it the texts shuffle.

Words are what stands between the blanks ``\\x20 \\x09-\\x0D``, lower-cased.  Defined cases: null or
empty texts and items match nothing; an item of fewer than five words is one shingle; a document
shorter than an item is compared whole with it; null ids are kept; findings name a document by its id
and text, so repeated rows of both give one finding, and the filter keeps or drops all of them; of
equally similar windows the first stands; texts of any length are read whole; empty tables give an
empty result; other columns are ignored by the findings and kept by the filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causelake.llm.common import free_name, materialise, sized, table

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprint bits: 60 divide into lanes of 10, 20 or 30 bits and never reach a long's sign.
BITS = 60
#: Hamming radius of the search. A pair at the threshold is 9.1 bits apart on average with a
#: standard deviation of 2.8, so 18 bits lose fewer than one in a thousand at the threshold.
RADIUS = 18
#: Blocks of the multi-index; with 5 a random pair meets in 0.31 keys on average, with ``RADIUS + 1`` in 2.2.
BLOCKS = 5
MAX_ITEM_ROWS = 2_000_000
MAX_KEYS = 2_000_000

BLANKS = " \t\n\x0b\x0c\r"
NO_HASHES = "cast(array() as array<bigint>)"


def words(text: Column) -> Column:
    """Lower-cased words; none for a null or blank text."""
    low = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return F.when(low == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(low, "[\\x20\\x09-\\x0D]+", -1))


def shingles(w: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words of a word array, in order."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, runs).otherwise(F.expr(NO_HASHES))


def simhash(hashes: Column, longest: int) -> Column:
    """60-bit SimHash of up to ``longest`` hashes; a repeated one weighs as often as it occurs.

    Six (or three, or two) bits are counted at once in the lanes of one long.
    """
    lane = next(x for x in (10, 20, 30) if longest < 1 << (x - 1))
    ones = sum(1 << i for i in range(0, BITS, lane))
    half = F.lit((1 << (lane - 1)) - 1) - F.floor(F.size(hashes) / 2)
    out = F.lit(0).cast("long")
    for k in range(lane):
        counts = F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.shiftrightunsigned(h, k).bitwiseAND(F.lit(ones)))  # noqa: B023
        # a lane's top bit says that more than half of the hashes have this bit
        top = F.shiftrightunsigned(counts + half * F.lit(ones), lane - 1).bitwiseAND(F.lit(ones))
        out = out.bitwiseOR(F.shiftleft(top, k))
    return out


def blocks(radius: int = RADIUS, count: int = BLOCKS) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of the blocks that cover the fingerprint.

    The block radii and one each sum to ``radius + 1``: were each block over its own radius, the
    fingerprints would be more than ``radius`` bits apart.
    """
    edges = [i * BITS // count for i in range(count + 1)]
    shares = [(radius + 1) * (i + 1) // count - (radius + 1) * i // count for i in range(count)]
    return [(a, b - a, max(share - 1, -1)) for a, b, share in zip(edges, edges[1:], shares)]


def _block(fingerprint: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fingerprint, shift).bitwiseAND(F.lit((1 << width) - 1))


def window_keys(fingerprint: Column, radius: int) -> Column:
    """``(block, key)`` of a fingerprint: its own value in each block."""
    return F.array(*[F.struct(F.lit(i).alias("block"), _block(fingerprint, a, w).cast("int").alias("key")) for i, (a, w, r) in enumerate(blocks(radius)) if r >= 0])


def item_keys(fingerprint: Column, radius: int) -> Column:
    """``(block, key)`` of all values within each block's radius of a fingerprint."""
    each = []
    for i, (shift, width, r) in enumerate(blocks(radius)):
        if r >= 0:
            near = F.filter(F.sequence(F.lit(0), F.lit((1 << width) - 1)), lambda m: F.bit_count(m) <= r)  # noqa: B023
            own = _block(fingerprint, shift, width).cast("int")
            each.append(F.transform(near, lambda m: F.struct(F.lit(i).alias("block"), own.bitwiseXOR(m).alias("key"))))  # noqa: B023
    return F.concat(*each)


def first_block(difference: Column, radius: int) -> Column:
    """The first block in which two fingerprints (given their XOR) are within the block's radius."""
    out = F.lit(None).cast("int")
    for i, (shift, width, r) in reversed(list(enumerate(blocks(radius)))):
        out = F.when(F.bit_count(_block(difference, shift, width)) <= r, F.lit(i)).otherwise(out)
    return out


def _numbered(hashes: Column) -> Column:
    """Each hash with the number of its occurrence, so that sets of them intersect as multisets."""
    first = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<h:bigint,n:int>>)").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        n = F.when(acc["last"] == h, acc["n"] + 1).otherwise(F.lit(0))
        return F.struct(h.alias("last"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(h.alias("h"), n.alias("n")))).alias("out"))

    return F.aggregate(F.array_sort(hashes), first, step)["out"]


def weighted_similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity (sum of minima over sum of maxima) of two arrays as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(F.size(F.array_intersect(_numbered(a), _numbered(b))))
    union = F.size(a) + F.size(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def _hits(documents: DataFrame, items: DataFrame, size: int, longest: int, bounded: bool, few_keys: bool, similarity: float, radius: int) -> DataFrame:
    """The verified windows for the items that have shingles of ``size`` words."""
    held = F.broadcast if bounded else lambda df: df
    docs = documents.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version"))
    # the items with their fingerprints are a table of their own; a few rows are dealt to all cores
    items = items.repartition(items.sparkSession.sparkContext.defaultParallelism, "item_id", F.xxhash64("item"))
    items = materialise(items.select("item_id", "n", "item", simhash(F.col("item"), longest).alias("item_print")), "items")
    # outer: a plain explode has the optimiser test the array's size first, by computing it again
    grams = held(items.select(F.explode("item").alias("h"), "n").distinct())
    at_words = docs.withColumn("w", words(F.col("text"))).select("doc_id", "version", F.size("w").alias("n_doc"), F.posexplode_outer(shingles(F.col("w"), size)).alias("at", "h"))
    # the windows over a shared shingle, as long as the item and inside the document
    spans = F.transform("ats", lambda at: F.sequence(F.greatest(F.lit(0), at - F.col("n") + size), F.greatest(F.lit(0), F.least(at, F.col("n_doc") - F.col("n")))))
    seeds = (
        at_words.join(grams, "h")
        .groupBy("doc_id", "version", "n", "n_doc").agg(F.collect_set("at").alias("ats"))
        .select(F.col("doc_id").alias("seed_doc"), F.col("version").alias("seed_version"), F.struct("n", F.array_distinct(F.flatten(spans)).alias("starts")).alias("seed"))
        .groupBy("seed_doc", "seed_version").agg(F.collect_list("seed").alias("seeds"))
    )
    seeds = materialise(seeds, "seeds")
    same = F.col("doc_id").eqNullSafe(F.col("seed_doc")) & (F.col("version") == F.col("seed_version"))
    # where few documents have seeds no other text is exchanged
    seeded = docs.join(sized(seeds.select("seed_doc", "seed_version")), same, "left_semi")
    runs = seeded.join(seeds, same).withColumn("w", words(F.col("text"))).select("doc_id", "version", shingles(F.col("w"), size).alias("s"), F.explode("seeds").alias("seed"))
    windows = runs.select("doc_id", "version", "s", F.col("seed.n").alias("n"), F.explode("seed.starts").alias("start")).select(
        "doc_id", "version", "n", "start", F.slice("s", F.col("start") + 1, F.col("n") - (size - 1)).alias("window")
    )
    near = candidates(windows.withColumn("print", simhash(F.col("window"), longest)), items, radius, few_keys)
    same = (near["n"] == items["n"]) & (near["item_print"] == items["item_print"]) & near["item_id"].eqNullSafe(items["item_id"])
    pairs = near.join(held(items), same).select("doc_id", "version", near["item_id"], "start", near["n"], "hamming", "window", "item")
    verified = pairs.select("doc_id", "version", "item_id", "start", "n", "hamming", weighted_similarity(F.col("window"), F.col("item")).alias("similarity"))
    return verified.where(F.col("similarity") >= similarity)


def candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS, few_keys: bool = True) -> DataFrame:
    """Pairs of ``windows`` (``n, print`` and more) and ``items`` (``item_id, n, item_print``) of one length within the radius, each once."""
    index = items.select("item_id", "n", "item_print").distinct()
    index = index.select("item_id", "n", "item_print", F.inline(item_keys(F.col("item_print"), radius)))
    probes = windows.select("*", F.inline(window_keys(F.col("print"), radius)))
    difference = F.col("print").bitwiseXOR(F.col("item_print"))
    near = F.bit_count(difference)
    return (
        probes.join(F.broadcast(index) if few_keys else index, ["n", "block", "key"])
        .where((near <= radius) & (first_block(difference, radius) == F.col("block")))
        .withColumn("hamming", near).drop("block", "key")
    )


def contaminated(
    documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, size: int = SHINGLE
) -> DataFrame:
    """``doc_id, version, item_id, start_word, n_words, hamming, similarity``: each document's best window on each item.

    ``version`` is ``xxhash64`` of the text (a null one as empty).  Of equally similar windows the first one stands.
    """
    items = (
        benchmark.select("item_id", words(F.col("text")).alias("w"))
        .where(F.size("w") > 0)
        .select("item_id", F.size("w").alias("n"), "w")
    )
    # a few numbers of the bounded items table plan the rest: which sizes occur, and the bound itself
    sizes = items.groupBy(F.least("n", F.lit(size)).alias("size")).agg(F.sum("n").alias("rows"), F.max("n").alias("longest"), F.count("*").alias("items")).collect()
    probes = sum(math.comb(w, k) for _, w, r in blocks(radius) for k in range(r + 1))
    parts = [
        _hits(documents, items.where(F.least("n", F.lit(size)) == k).select("item_id", "n", shingles(F.col("w"), k).alias("item")),
              k, longest, rows <= MAX_ITEM_ROWS, held * probes <= MAX_KEYS, similarity, radius)
        for k, rows, longest, held in sorted(map(tuple, sizes))
    ]
    best = F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct("similarity", -F.col("start"))).alias("b")
    kinds = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    none = documents.sparkSession.createDataFrame([], f"{kinds}, version long, start int, n int, hamming int, similarity double")
    found = none
    for part in parts:
        found = found.unionByName(part)
    return found.groupBy("doc_id", "version", "item_id").agg(best).select(
        "doc_id", "version", "item_id", F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"), "b.hamming", "b.similarity"
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` in which no benchmark item was found, with all their columns."""
    hit_id, hit_version = (free_name(c, documents.columns) for c in ("hit_id", "hit_version"))
    found = contaminated(documents, benchmark).select(F.col("doc_id").alias(hit_id), F.col("version").alias(hit_version)).distinct()
    found = sized(materialise(found, "contaminated"))
    same = documents["doc_id"].eqNullSafe(F.col(hit_id)) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == F.col(hit_version))
    return documents.join(found, same, "left_anti")


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("version")
