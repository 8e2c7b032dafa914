"""Quality scores by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts.  A text is compressed
with each; the difference of the sizes over the text's length says which side it is like, and a
logistic curve, fitted on labelled texts that neither dictionary has seen, makes it a score.

Defined cases: null and empty texts score as a difference of zero; repeated rows score alike;
texts are compressed and learned whole whatever their length, one at a time; an id with several labels counts
with the greater one, of equal scores none comes first; without labelled rows of both classes every
score is the share of label 1 (0.5 without any); other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causelake.llm.common import doc_texts, lean, table, text_slices
from causelake.llm.labelled import fold, labelled_sample

#: Bound of the fitted sample: labelled ids of each class; their texts are taken whole.
PER_CLASS = 4000
DICTIONARY_BYTES = 112_640
#: Bytes of the pieces in which whole sampled texts are given to the dictionaries.
SAMPLE_BYTES = 2000
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries and the logistic curve ``1 / (1 + exp(-(slope * x + offset)))``."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) / length."""
        if not self.good or not self.bad:
            return np.zeros(len(texts))
        sides = []
        for held in (self.bad, self.good):
            d = zstandard.ZstdCompressionDict(held)
            d.precompute_compress(level=LEVEL)
            sides.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)
        bad, good = sides
        return np.array([(len(bad(t)) - len(good(t))) / len(t) if t else 0.0 for t in texts])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z = np.clip(self.slope * self.differences(texts) + self.offset, -60, 60)
        return 1 / (1 + np.exp(-z))


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their text itself is the dictionary
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and offset by Newton steps; x is scaled inside."""
    scale = float(np.std(x)) or 1.0
    design = np.stack((x / scale, np.ones(len(x))), 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        h = design.T @ (design * (weight * p * (1 - p))[:, None]) + (ridge + 1e-3) * np.eye(2)
        step = np.linalg.solve(h, design.T @ (weight * (y - p)) - 1e-3 * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(rows: list[tuple[str, int]], sizes: dict[int, int]) -> CompressionModel:
    """Dictionaries from three of four rows of each class, the curve from the others."""
    by_class = {y: [t.encode() for t, label in rows if label == y and t] for y in (0, 1)}
    if min(map(len, by_class.values())) < 2:
        total = sum(sizes.values())
        share = min(max(sizes.get(1, 0) / total, 1e-6), 1 - 1e-6) if total else 0.5
        return CompressionModel(b"", b"", 0.0, math.log(share / (1 - share)))
    good, bad = ([t[at : at + SAMPLE_BYTES] for i, t in enumerate(by_class[y]) if i % 4 != 1 for at in range(0, len(t), SAMPLE_BYTES)] for y in (1, 0))
    model = CompressionModel(_dictionary(good), _dictionary(bad), 0.0, 0.0)
    held = {y: by_class[y][1::4] for y in (0, 1)}
    x = np.concatenate([model.differences(held[y]) for y in (0, 1)])
    y = np.repeat([0.0, 1.0], [len(held[0]), len(held[1])])
    weight = np.repeat([sizes[0] / len(held[0]), sizes[1] / len(held[1])], [len(held[0]), len(held[1])])
    slope, offset = _logistic(x, y, weight / weight.mean())
    return CompressionModel(model.good, model.bad, slope, offset)


def quality_scores(documents: DataFrame, model: CompressionModel) -> DataFrame:
    """``doc_id, score`` of every whole text; the model (two dictionaries of fixed size) is broadcast."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                texts = [t.encode() for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(held.value.scores(texts))], ["doc_id", "score"])

    return doc_texts(documents).mapInArrow(lean(score), "doc_id long, score double")


def op4_zstd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows, sizes = labelled_sample(documents, labels, "quality", fold(4) != 2, PER_CLASS)
    return quality_scores(documents, fit(rows, sizes)).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
