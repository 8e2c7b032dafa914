"""Bounded, deterministic samples of labelled texts for fitting on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causelake.llm.common import doc_texts, materialise


def fold(modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, kept: Column, per_class: int) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most ``per_class`` labelled ids of each class, and how many ids with a document each class has.

    Ids come in the order of their hash, so the sample is the same on every run; texts are whole.  Null
    labels and ids are left out, as are labels without a document; an id that is labelled twice counts
    with its greater label, and one whose documents repeat with one of their texts (that of least hash),
    so at most ``2 * per_class`` rows reach the driver.
    """
    docs = doc_texts(documents)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & kept)
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), label).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    known = materialise(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labelled")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    sample = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    # at most 2 * per_class ids are broadcast, and as many rows collected
    text = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")
    rows = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(text).select("doc_id", "y", "t.text").collect()
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])], sizes
