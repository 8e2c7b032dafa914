"""Language-model scores: stupid backoff, computed relationally.

Documents are cut into slices of many words.  Each slice sends its distinct n-grams (64-bit
hashes, sorted, delta-coded) and their counts to hash partitions; a partition sums them into its
part of the count table and joins the table back to every slice's n-grams; a slice then scores its
documents and sums per document.  N-grams are exploded in numpy, so an occurrence costs bytes in
the exchange and not a row.  A hot n-gram is one entry a slice however often it occurs, and a
partition in which a slice has nothing gets no block, so blocks never outnumber distinct n-grams.

The score of a word after its history is count(n-gram) / count(history) if the n-gram was counted
``LEAST`` times or more, else ``BACKOFF`` times the score after the history without its first word;
at the end count(word) / all words.  Histories begin with a mark of the document's beginning.

Words are what stands between the blanks ``\\x20 \\x09-\\x0D``, A-Z lower-cased.  Defined cases: null,
empty and blank texts have no words and a null score; repeated rows and null ids are kept and
counted; whole texts of any length count; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causelake.llm.common import doc_texts, lean, materialise, table, text_slices
from causelake.llm.shingles import WORD_MIX, mix, word_hashes

ORDER = 3
BACKOFF = 0.4
LEAST = 2
#: Words after which a slice closes, and entries of one hash partition on average.
SLICE_WORDS = 1_600_000
PARTITION_ENTRIES = 1_500_000
BEGIN = np.uint64(0x5BD1E9955BD1E995)

SLICES = "slice long, doc_ids array<long>, counts array<int>, words binary, vocabulary binary, n_words long"


def _pack(a: np.ndarray) -> bytes:
    """Bytes of an array by significance, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def _pack_apart(a: np.ndarray) -> bytes:
    """The same with each plane by itself: a plane of zeros is nothing, one that does not shrink stays as it is.

    Deltas of hashes have random low bytes, which one code for all planes would spread over the others.
    """
    planes, compress, out = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T), zstandard.ZstdCompressor(level=1).compress, []
    for plane in planes:
        raw = plane.tobytes() if plane.any() else b""
        packed = compress(raw) if raw else raw
        out.append(packed if len(packed) < len(raw) else raw)
    return np.array([len(a), *map(len, out)], "<u4").tobytes() + b"".join(out)


def _unpack_apart(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    n, *lengths = np.frombuffer(raw[: 4 * (size + 1)], "<u4").tolist()
    planes, at = np.zeros((size, n), np.uint8), 4 * (size + 1)
    for plane, held in zip(planes, lengths):
        part = raw[at : at + held]
        if held:
            plane[:] = np.frombuffer(part if held == n else zstandard.ZstdDecompressor().decompress(part), np.uint8)
        at += held
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def word_slices(documents: DataFrame) -> DataFrame:
    """Documents as slices: ids, word counts, and words as numbers in the slice's own vocabulary."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        counts: list[np.ndarray] = []
        hashes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            vocabulary, words, occurrences = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-occurrences, kind="stable")  # frequent words have small numbers, which pack well
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            row = [part << 32 | number, ids, np.concatenate(counts), _pack(rank[words]), vocabulary[order].tobytes(), size]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["slice", "doc_ids", "counts", "words", "vocabulary", "n_words"])

        for batch in batches:
            for rows in text_slices(batch):
                h, n = word_hashes(rows.column("text"))
                hashes.append(h)
                counts.append(n.astype(np.int32))
                ids += rows.column("doc_id").to_pylist()
                size += len(h)
                if size >= SLICE_WORDS:
                    yield close()
                    number, size, ids, counts, hashes = number + 1, 0, [], [], []
        if ids:
            yield close()

    return doc_texts(documents).mapInArrow(lean(cut), SLICES)


def _grams(words: bytes, vocabulary: bytes, counts: list[int], order: int) -> tuple[Iterator[np.ndarray], np.ndarray, np.ndarray]:
    """Order by order the hash of the n-gram that ends at each place, how much of its document precedes it, its document.

    Every document with words has its beginning mark in front.
    """
    w, n = np.frombuffer(vocabulary, np.uint64)[_unpack(words, "<u4")], np.asarray(counts, np.int64)
    held = np.flatnonzero(n)
    sizes = n[held] + 1
    starts = np.cumsum(sizes) - sizes
    h = np.empty(len(w) + len(held), np.uint64)
    mark = np.zeros(len(h), bool)
    mark[starts] = True
    h[mark], h[~mark] = BEGIN, w
    place = np.arange(len(h), dtype=np.int32) - np.repeat(starts.astype(np.int32), sizes)

    def grams() -> Iterator[np.ndarray]:
        run = np.zeros(len(h), np.uint64)
        for k in range(order):
            run[k:] += h[: max(0, len(h) - k)] * WORD_MIX[k % len(WORD_MIX)] * np.uint64(2 * (k // len(WORD_MIX)) + 1)
            yield mix(run + np.uint64(k))

    return grams(), place, np.repeat(held.astype(np.int32), sizes)


def _requests(order: int, partitions: int):
    """Rows ``part, slice, block``: the distinct n-grams of a slice in one hash partition (if it has any there), and their counts."""
    edges = np.array([(i << 64) // partitions for i in range(1, partitions)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, place, _ = _grams(row["words"], row["vocabulary"], row["counts"], order)
                blocks: list[list[bytes]] = [[] for _ in range(partitions)]
                sizes = np.zeros(partitions, np.int64)
                for k, g in enumerate(grams):
                    u, c = np.unique(g[place >= k], return_counts=True)
                    cuts = np.concatenate(([0], np.searchsorted(u, edges), [len(u)]))
                    for p in range(partitions):
                        a, b = cuts[p], cuts[p + 1]
                        blocks[p] += [_pack_apart(np.diff(u[a:b], prepend=np.uint64(0))), _pack(c[a:b].astype(np.uint32))]
                        sizes[p] += b - a
                asked = np.flatnonzero(sizes).tolist()
                rows = [pa.array(asked, pa.int32()), pa.array([row["slice"]] * len(asked), pa.int64()), pa.array([blocks[p] for p in asked], pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(rows, ["part", "slice", "block"])

    return ask


def _count(order: int, least: int):
    """A hash partition: sums all slices' counts and answers each slice with the totals of its n-grams."""

    def count(group: pa.Table) -> pa.Table:
        blocks = group.column("block").to_pylist()
        answers: list[list[bytes]] = [[] for _ in blocks]
        for k in range(order):
            grams = [np.cumsum(_unpack_apart(b[2 * k], "<u8"), dtype=np.uint64) for b in blocks]
            counts = np.concatenate([_unpack(b[2 * k + 1], "<u4") for b in blocks])
            _, which = np.unique(np.concatenate(grams), return_inverse=True)
            totals = np.bincount(which, counts).astype(np.uint64)
            if k:
                totals[totals < least] = 0
            at = 0
            for answer, g in zip(answers, grams):
                answer.append(_pack(totals[which[at : at + len(g)]]))
                at += len(g)
        return pa.table([group.column("slice"), group.column("part"), pa.array(answers, pa.list_(pa.binary()))], ["slice", "part", "totals"])

    return count


SCORES = "doc_id long, n_words long, n_backoffs long, log_score double"


def _score(order: int, backoff: float, all_words: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, place, doc = _grams(row["words"], row["vocabulary"], row["counts"], order)
                parts = [a["totals"] for a in sorted(row["answers"] or [], key=lambda a: a["part"])]
                value = steps = before = None
                for k, g in enumerate(grams):
                    valid = place >= k
                    totals = np.concatenate([np.zeros(0, np.uint64), *[_unpack(p[k], "<u8") for p in parts]]).astype(np.float64)
                    at = np.zeros(len(g))
                    at[valid] = totals[np.unique(g[valid], return_inverse=True)[1]]
                    if k:
                        before[1:], before[:1] = before[:-1].copy(), 1.0  # of the history, which ends a place earlier
                        found = (at > 0) & (before > 0)
                        value[valid] += math.log(backoff)
                        value[found] = np.log(at[found] / before[found])
                        steps += valid
                        steps[found] = 0
                    else:
                        value, steps = np.log(np.maximum(at, 1) / max(all_words, 1)), np.zeros(len(at), np.int32)
                    before = at
                word = place > 0
                n = len(row["counts"])
                sums = np.bincount(doc[word], value[word], n)
                words = np.asarray(row["counts"], np.int64)
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(words), pa.array(np.bincount(doc[word], steps[word], n).astype(np.int64)),
                    pa.array(sums, pa.float64(), mask=words == 0),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_backoffs", "log_score"])

    return score


def backoff_scores(documents: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST) -> DataFrame:
    """``doc_id, n_words, n_backoffs, log_score`` (natural logarithm, summed over the words) under the n-grams of all documents."""
    slices = materialise(word_slices(documents), "word-slices")
    all_words = slices.agg(F.sum("n_words")).first()[0] or 0
    partitions = max(4, math.ceil(order * all_words / PARTITION_ENTRIES))
    asked = slices.select("slice", "counts", "words", "vocabulary").mapInArrow(lean(_requests(order, partitions)), "part int, slice long, block array<binary>")
    totals = materialise(asked.groupBy("part").applyInArrow(_count(order, least), "slice long, part int, totals array<binary>"), "totals", release=True)
    answers = totals.groupBy("slice").agg(F.collect_list(F.struct("part", "totals")).alias("answers"))
    return slices.join(answers, "slice", "left").mapInArrow(lean(_score(order, backoff, all_words)), SCORES)


def _means(scores: DataFrame) -> DataFrame:
    return scores.select("doc_id", "n_words", "n_backoffs", F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(backoff_scores(table(spark, sf_dir, "documents")))


ORACLE_SQL = f"""
with docs as (
  select doc_id, row_number() over () as r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
places as (select r, unnest(range(1, len(w) + 1)) as i, w from docs),
words as (
  select r, i, w[i] as word, case when i > 1 then w[i - 1] else '' end as b1, case when i > 2 then w[i - 2] when i = 2 then '' end as b2
  from places),
ones as (select word, count(*) as n from words group by word),
marks as (select '' as word, count(*) as n from docs where len(w) > 0),
history as (select * from ones union all select * from marks),
total as (select count(*) as n from words),
twos as (select b1, word, count(*) as n from words group by b1, word),
threes as (select b2, b1, word, count(*) as n from words where i > 1 group by b2, b1, word having count(*) >= {LEAST}),
scored as (
  select words.r,
         case when threes.n is not null then 0 when twos.n >= {LEAST} then least(words.i - 1, 1) else least(words.i, 2) end as backed,
         case when threes.n is not null then ln(threes.n / h2.n::double)
              when twos.n >= {LEAST} then least(words.i - 1, 1) * ln({BACKOFF}) + ln(twos.n / history.n::double)
              else least(words.i, 2) * ln({BACKOFF}) + ln(ones.n / total.n::double) end as s
  from words join ones using (word) join history on history.word = words.b1 cross join total
  join twos on twos.word = words.word and twos.b1 = words.b1
  left join threes on threes.word = words.word and threes.b1 = words.b1 and threes.b2 = words.b2
  left join twos h2 on h2.word = words.b1 and h2.b1 = words.b2),
sums as (select r, sum(backed) as backed, sum(s) as s from scored group by r)
select docs.doc_id, len(w)::bigint as n_words, coalesce(backed, 0)::bigint as n_backoffs,
       round(s / nullif(len(w), 0), 6) as mean_log_score
from docs left join sums using (r)
"""
