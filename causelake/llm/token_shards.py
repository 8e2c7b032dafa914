"""Token-id output: one compressed wavelet matrix per shard.

A shard file (``WMX2``) is self-contained: a header, the documents' ids and token offsets, a rank
directory, and the bit-planes in chunks of 65,536 bits, a zstandard frame each.  Planes are stable
partitions by bit from the highest bit down, so ``rank`` on the planes answers token access, token
counts in any range and the places where a token occurs without expanding the shard: the directory
says how many ones stand before each chunk, so a rank decompresses one chunk of 8 KB.  Shards travel as a binary column of
a Parquet table: any store that Spark can write works, and the commit of the table is atomic
when executors are lost.

Texts of any length are encoded whole; a document longer than a shard has a shard of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causelake.llm.common import doc_texts, lean, materialise, table, text_slices
from causelake.llm.wordmemo import encode_dropping_space, space_free_memo

MAGIC = b"WMX2"
HEADER = struct.Struct("<4sIQQQ")  # magic, bit-planes, tokens, documents, bytes of the documents' frame
DIRECTORY = struct.Struct("<Q")  # bytes of the frame of the rank directory
#: Tokens after which a shard closes (a longer document has a shard of its own).
SHARD_TOKENS = 1 << 20
WORDS = 64  # bits in a rank block
CHUNK = 1 << 16  # bits in a frame of a plane
CHUNK_WORDS = CHUNK // WORDS

SHARD_SCHEMA = "part int, chunk int, start_in_part long, n_docs long, n_tokens long, shard binary"


def build_shard(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, level: int = 3) -> bytes:
    """The shard of the documents whose ids stand on end in ``ids``; ``ends`` has their ends."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    pack = zstandard.ZstdCompressor(level=level).compress
    chunks = -(-n // CHUNK)
    frames, ranks = [], np.zeros((bits, chunks + 1), "<u8")  # ones before each chunk
    for p, b in enumerate(range(bits - 1, -1, -1)):
        ones = (cur & cur.dtype.type(1 << b)) != 0
        raw = np.zeros(chunks * CHUNK // 8, np.uint8)
        raw[: -(-n // 8)] = np.packbits(ones, bitorder="little")
        ranks[p, 1:] = np.cumsum(np.bitwise_count(raw.view(np.uint64)).reshape(chunks, CHUNK_WORDS).sum(1, dtype=np.uint64))
        view = memoryview(raw)
        frames += [pack(view[i : i + CHUNK // 8]) for i in range(0, len(raw), CHUNK // 8)]
        cur = np.concatenate((np.compress(~ones, cur), np.compress(ones, cur)))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = pack(
        np.diff(np.array([0 if d is None else d for d in doc_ids], "<i8"), prepend=0).astype("<i8").tobytes()
        + np.diff(ends, prepend=0).astype("<i8").tobytes()
        + known.tobytes()
    )
    sizes = np.fromiter(map(len, frames), "<u4", len(frames))
    directory = pack(ranks.tobytes() + sizes.tobytes())
    head = HEADER.pack(MAGIC, bits, n, len(doc_ids), len(docs)) + DIRECTORY.pack(len(directory))
    return b"".join((head, docs, directory, *frames))


class WaveletMatrix:
    """Reads a shard; chunks of planes are decompressed when first asked for."""

    def __init__(self, shard: bytes):
        magic, self.bits, self.n, self.n_docs, held = HEADER.unpack_from(shard)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEADER.size
        (size,) = DIRECTORY.unpack_from(shard, at)
        at += DIRECTORY.size
        self._docs, at = shard[at : at + held], at + held
        self._chunks = -(-self.n // CHUNK)
        self._unpack = zstandard.ZstdDecompressor().decompress
        raw, k = self._unpack(shard[at : at + size]), 8 * self.bits * (self._chunks + 1)
        self._ranks = np.frombuffer(raw[:k], "<u8").reshape(self.bits, -1).astype(np.int64)
        ends = at + size + np.cumsum(np.frombuffer(raw[k:], "<u4"), dtype=np.int64)
        self._ends = [at + size, *ends.tolist()]
        self._shard = shard
        self._zeros = (self.n - self._ranks[:, -1]).tolist()
        # filled chunk by chunk: words of the planes, and ones before each word
        self._words = np.zeros((self.bits, self._chunks * CHUNK_WORDS + 1), np.uint64)
        self._before = np.empty(self._words.shape, np.int64)
        self._before[:, -1] = self._ranks[:, -1]
        self.loaded = np.zeros((self.bits, self._chunks), bool)

    @cached_property
    def _doc_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, k = zstandard.ZstdDecompressor().decompress(self._docs), 8 * self.n_docs
        return (
            np.cumsum(np.frombuffer(raw[:k], "<i8")),
            np.cumsum(np.frombuffer(raw[k : 2 * k], "<i8")),
            np.frombuffer(raw[2 * k :], np.uint8).astype(bool),
        )

    @property
    def doc_ids(self) -> list[int | None]:
        ids, _, known = self._doc_table
        return [int(d) if k else None for d, k in zip(ids, known)]

    @property
    def doc_ends(self) -> np.ndarray:
        return self._doc_table[1]

    def _load(self, plane: int, chunks: np.ndarray) -> None:
        """Decompresses the chunks of a plane that are not yet there, runs of them at once."""
        missing = chunks[~self.loaded[plane, chunks]]
        for run in np.split(missing, np.flatnonzero(np.diff(missing) != 1) + 1):
            if not len(run):
                continue
            first, last = int(run[0]), int(run[-1])
            ends = self._ends[plane * self._chunks + first : plane * self._chunks + last + 2]
            raw = b"".join([self._unpack(self._shard[a:b]) for a, b in zip(ends[:-1], ends[1:])])
            begin, end = first * CHUNK_WORDS, (last + 1) * CHUNK_WORDS
            words = self._words[plane, begin:end]
            words[:] = np.frombuffer(raw, np.uint64)
            before = self._before[plane, begin:end]
            before[0] = self._ranks[plane, first]
            np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64, out=before[1:])
            before[1:] += before[0]
            self.loaded[plane, first : last + 1] = True

    def _rank1(self, plane: int, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w, r = i // WORDS, (i % WORDS).astype(np.uint64)
        chunks = np.unique(w // CHUNK_WORDS)
        self._load(plane, chunks[chunks < self._chunks])
        mask = (np.uint64(1) << r) - np.uint64(1)
        return self._before[plane, w] + np.bitwise_count(self._words[plane, w] & mask).astype(np.int64)

    def access(self, positions) -> np.ndarray:
        """Tokens at positions."""
        i = np.asarray(positions, np.int64)
        if i.size and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("no such position")
        out = np.zeros(i.shape, np.int64)
        for p in range(self.bits):
            ones = self._rank1(p, i)
            bit = self._rank1(p, i + 1) - ones
            out = out * 2 + bit
            i = np.where(bit == 1, self._zeros[p] + ones, i - ones)
        return out

    def _range(self, token: int, begin, end) -> np.ndarray:
        """Where the occurrences of a token in ranges begin and end on the last plane."""
        ends = np.array([begin, end], np.int64)
        if token >> self.bits:
            return np.zeros_like(ends)
        for p in range(self.bits):
            ones = self._rank1(p, ends)
            ends = self._zeros[p] + ones if token >> (self.bits - 1 - p) & 1 else ends - ones
        return ends

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often a token occurs in ``[begin, end)``."""
        return int(self.counts(token, begin, self.n if end is None else end))

    def counts(self, token: int, begin, end) -> np.ndarray:
        """The same for many ranges at once."""
        a, b = self._range(token, begin, end)
        return b - a

    def _select(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the bits number ``k`` (from 0) of that kind: binary search over ranks."""
        low, high = np.zeros(k.shape, np.int64), np.full(k.shape, self.n, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            ones = self._rank1(plane, mid + 1)
            enough = (ones if bit else mid + 1 - ones) > k
            high, low = np.where(enough, mid, high), np.where(enough | (low >= high), low, mid + 1)
        return low

    def occurrences(self, token: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ascending positions of a token in ``[begin, end)``."""
        a, b = self._range(token, begin, self.n if end is None else end).tolist()
        at = np.arange(a, b, dtype=np.int64)
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            at = self._select(p, bit, at - self._zeros[p] if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All tokens in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for p in range(self.bits - 1, -1, -1):
            self._load(p, np.arange(self._chunks))
            ones = np.unpackbits(self._words[p].view(np.uint8), count=self.n, bitorder="little").view(bool)
            z, out = self._zeros[p], np.empty(self.n, kind)
            out[np.flatnonzero(~ones)] = values[:z]
            out[np.flatnonzero(ones)] = values[z:] | kind(1 << (self.bits - 1 - p))
            values = out
        return values


def write_shards(documents: DataFrame, tokenizer_json: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode documents in ascending ``doc_id`` order into shards (not yet written anywhere).

    Null texts count as empty, so each document has at least its end id; rows with a null
    ``doc_id`` come first; rows that repeat a ``doc_id`` are kept and stand side by side.
    An empty table gives no shards.  Columns other than ``doc_id`` and ``text`` are ignored.
    """
    spec = documents.sparkSession.sparkContext.broadcast(tokenizer_json)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = space_free_memo(spec.value)
        part, chunk, before = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        counts: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            blob = build_shard(ids, docs, np.cumsum(np.concatenate(counts)))
            row = [[part], [chunk], [before], [len(docs)], [len(ids)], [blob]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "chunk", "start_in_part", "n_docs", "n_tokens", "shard"])

        for batch in batches:
            for rows in text_slices(batch, limit=9_000_000):
                ids, n = encode_dropping_space(memo, rows.column("text"))
                ends = np.cumsum(n)
                with_end = np.full(len(ids) + len(n), end_id, np.int32)
                with_end[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                held.append(with_end)
                counts.append(n + 1)
                docs += rows.column("doc_id").to_pylist()
                size += int(ends[-1]) + len(n)
                if size >= shard_tokens:
                    yield close()
                    chunk, before = chunk + 1, before + size
                    held, docs, counts, size = [], [], [], 0
        if docs:
            yield close()

    ordered = doc_texts(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(lean(shards), SHARD_SCHEMA)


def read_shards(shards: DataFrame, end_id: int = 1) -> DataFrame:
    """Per document of written shards: ``doc_id, start, n_tokens, ids_crc32, last_id, n_end_ids``.

    The last id is looked up and the end ids are counted by ranks on the planes.  Where each range partition starts is a running sum over one row a partition (their
    number is the shuffle's, not the data's), which is what is broadcast.
    """
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, inside, blob in zip(*(batch.column(c).to_pylist() for c in ("base", "start_in_part", "shard"))):
                shard = WaveletMatrix(blob)
                raw = memoryview(shard.tokens().astype("<u4").tobytes())
                ends = shard.doc_ends
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                values = [shard.doc_ids, starts + base + inside, ends - starts, crc, shard.access(ends - 1), shard.counts(end_id, starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], ["doc_id", "start", "n_tokens", "ids_crc32", "last_id", "n_end_ids"])

    placed = shards.join(F.broadcast(bases), "part").select("base", "start_in_part", "shard")
    return placed.mapInArrow(lean(documents), "doc_id long, start long, n_tokens long, ids_crc32 long, last_id long, n_end_ids long")


def op2_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    return read_shards(materialise(write_shards(table(spark, sf_dir, "documents"), spec), "token-shards"))
