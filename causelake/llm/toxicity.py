"""Toxicity by multiple-instance learning.

Only whole documents are labelled.  A sentence is toxic with probability sigmoid(BASE + its
features' weights), and a document by noisy-or: 1 - (1 - leak) * product(1 - sentence).  Weights
and leak are fitted to document labels through that product, so blame falls on the sentences that
tell toxic documents from clean ones, and those can then be located.  Features are lower-cased
words and their first four and five letters (inflected forms share these).

Defined cases: null and empty texts have no sentences and score the leak; repeated rows score
alike; whole texts are read, of any length; an id with several labels counts with the greater one; where
no sentence of a toxic document reaches the threshold alone, the likeliest one is located (the first of equal
ones); without labelled rows of both classes the score is the share of
label 1 (0.5 without any); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from causelake.llm.common import doc_texts, lean, small_batches, table, text_slices
from causelake.llm.labelled import fold, labelled_sample

#: Bound of the fitted sample: labelled ids of each class; their texts are taken whole.
PER_CLASS = 2500
#: Log-odds of a sentence without any known feature.
BASE = -7.0
#: Sampled documents that must have a feature, and how much oftener it must be in toxic ones.
LEAST_DOCUMENTS = 4
LEAST_RATIO = 3.0
MEMO = 150_000

#: Signs that end a sentence, full-width, Arabic and Devanagari ones among them.
ENDS = ".!?\n\u3002\uff01\uff1f\uff0e\uff61\u061f\u06d4\u0964"
PIECE = re.compile(rf"[^\W\d_]+|[{ENDS}]+")
SENTENCE = re.compile(rf"[^{ENDS}]+(?:(?!\n)[{ENDS}])*")


def features(word: str) -> tuple[str, ...]:
    """The word and its beginnings of four and five letters."""
    return (word, *(f"^{word[:n]}" for n in (4, 5) if len(word) >= n))


@dataclass
class NoisyOrModel:
    weights: dict[str, float]
    leak: float
    _memo: dict[str, float] = field(default_factory=dict, repr=False)

    def _weight(self, word: str) -> float:
        found = self._memo.get(word)
        if found is None:
            if len(self._memo) >= MEMO:
                self._memo.clear()
            if not word[0].isalpha():
                found = float("nan")  # ends a sentence
            else:
                found = sum(self.weights.get(f, 0.0) for f in features(word))
            self._memo[word] = found
        return found

    def document(self, text: str) -> float:
        """Probability that a text is toxic."""
        clean = np.log1p(-self.leak)
        values = np.fromiter(map(self._weight, PIECE.findall(text.lower())), np.float64)
        hit = np.flatnonzero(values > 0)
        if len(hit):
            sentence = np.cumsum(np.isnan(values))[hit]
            _, which = np.unique(sentence, return_inverse=True)
            z = BASE + np.bincount(which, values[hit])
            clean -= np.logaddexp(0.0, z).sum()  # log(1 - sigmoid(z))
        return float(-np.expm1(clean))

    def located(self, text: str, threshold: float) -> list[tuple[int, int, float]]:
        """The sentences of a toxic text at or over the threshold, or else the likeliest one."""
        found = self.sentences(text)
        over = [f for f in found if f[2] >= threshold]
        return over or ([max(found, key=lambda f: f[2])] if found else [])

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence that has a known feature."""
        out = []
        for m in SENTENCE.finditer(text):
            words = [w for w in PIECE.findall(m.group().lower()) if w[0].isalpha()]
            weight = sum(self._weight(w) for w in words)
            if weight > 0:
                out.append((m.start(), m.end(), float(1 / (1 + np.exp(-(BASE + weight))))))
        return out


def fit(rows: list[tuple[str, int]], sizes: dict[int, int], rounds: int = 300, penalty: float = 1e-3) -> NoisyOrModel:
    """Weights (none below zero) by projected Adam steps on the documents' log-likelihood."""
    y = np.array([label for _, label in rows], np.float64)
    if not rows or y.min() == y.max():
        total = sum(sizes.values())
        return NoisyOrModel({}, min(max(sizes.get(1, 0) / total if total else 0.5, 1e-6), 1 - 1e-6))
    # texts are read twice, so that only counts and known features are held
    seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for (t, _), label in zip(rows, y):
        seen[int(label)].update({f for w in set(PIECE.findall(t.lower())) if w[0].isalpha() for f in features(w)})
    share = {k: max(1, int((y == k).sum())) for k in (0, 1)}
    names = sorted(f for f, n in seen[1].items() if n >= LEAST_DOCUMENTS and n / share[1] >= LEAST_RATIO * (seen[0][f] + 0.5) / share[0])
    del seen
    index = {f: i for i, f in enumerate(names)}
    feature, sentence, document = [], [], []
    for d, (t, _) in enumerate(rows):
        for part in re.split(rf"[{ENDS}]+", t.lower()):
            known = {index[f] for w in set(PIECE.findall(part)) if w[0].isalpha() for f in features(w) if f in index}
            if known:
                feature += sorted(known)
                sentence += [len(document)] * len(known)
                document.append(d)
    feature, sentence, document = (np.array(x, np.int64) for x in (feature, sentence, document))
    cost = np.where(y == 1, sizes.get(1, share[1]) / share[1], sizes.get(0, share[0]) / share[0])
    cost /= cost.sum()
    w, leak = np.full(len(names), 2.0), np.log(0.02)
    moments = np.zeros((2, len(names) + 1))
    for step in range(1, rounds + 1):
        z = BASE + np.bincount(sentence, w[feature], len(document))
        p = 1 / (1 + np.exp(-z))
        l = 1 / (1 + np.exp(-leak))
        clean = np.log1p(-l) + np.bincount(document, -np.logaddexp(0.0, z), len(y))
        toxic = -np.expm1(clean)
        pull = np.where(y == 1, -np.exp(clean) / np.maximum(toxic, 1e-12), 1.0) * cost  # d loss / d -log(clean)
        slope = np.append(np.bincount(feature, (pull[document] * p)[sentence], len(names)) + penalty * w / len(names), (pull * l).sum())
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        move = 0.15 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-10)
        w, leak = np.maximum(0.0, w - move[:-1]), leak - move[-1]
    return NoisyOrModel({f: float(x) for f, x in zip(names, w) if x > 0.05}, float(1 / (1 + np.exp(-leak))))


def toxicity_model(documents: DataFrame, labels: DataFrame) -> NoisyOrModel:
    """The model of the labelled rows whose crc32 mod 5 is not 0."""
    return fit(*labelled_sample(documents, labels, "toxic", fold(5) != 0, PER_CLASS))


def toxicity_scores(documents: DataFrame, model: NoisyOrModel) -> DataFrame:
    """All columns of ``documents`` and ``score``; the model (of a bounded sample) is broadcast."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.leak))
    name = "score"
    while name in documents.columns:
        name += "_"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NoisyOrModel(*held.value)
        for batch in batches:
            for rows in text_slices(batch):
                values = pa.array([own.document(t or "") for t in rows.column("text").to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*rows.columns, values], [*rows.schema.names, name])

    schema = StructType([*documents.schema.fields, StructField(name, DoubleType())])
    return documents.mapInArrow(lean(score), schema)


def without_toxic(documents: DataFrame, model: NoisyOrModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score below the threshold, with all their columns; scored and dropped in one pass."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.leak))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NoisyOrModel(*held.value)
        for batch in batches:
            for rows in text_slices(batch):
                yield rows.filter(pa.array([own.document(t or "") < threshold for t in rows.column("text").to_pylist()], pa.bool_()))

    return documents.mapInArrow(lean(keep), documents.schema)


def toxic_sentences(documents: DataFrame, model: NoisyOrModel, threshold: float = 0.5) -> DataFrame:
    """``doc_id, start, end, score, sentence`` of the sentences at or over the threshold."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.leak))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NoisyOrModel(*held.value)
        for batch in batches:
            for rows in text_slices(batch):
                found = [
                    (d, a, b, p, t[a:b])
                    for d, t in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist())
                    for a, b, p in own.sentences(t)
                    if p >= threshold
                ]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
                columns = [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "score", "sentence"])

    return doc_texts(documents).mapInArrow(lean(locate), "doc_id long, start int, end int, score double, sentence string")


def located_scores(documents: DataFrame, model: NoisyOrModel, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, spans``: of documents at or over the threshold also ``(start, end, score)`` of the sentences to blame."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast((model.weights, model.leak))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = NoisyOrModel(*held.value)
        for batch in batches:
            for rows in text_slices(batch):
                texts = rows.column("text").to_pylist()
                scores = [own.document(t) for t in texts]
                spans = [[dict(zip(("start", "end", "score"), s)) for s in own.located(t, threshold)] if p >= threshold else [] for t, p in zip(texts, scores)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))], ["doc_id", "score", "spans"])

    return doc_texts(documents).mapInArrow(lean(locate), "doc_id long, score double, spans array<struct<start:int,end:int,score:double>>")


def op7_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity_model(documents, table(spark, sf_dir, "labels"))
    return located_scores(documents, model).select(
        "doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias("spans"),
    )
