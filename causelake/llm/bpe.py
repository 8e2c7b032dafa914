"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array.  Each round every word merges its leftmost pair
of lowest rank; ranks come from a binary search over sorted pair keys, and after a round only the
pairs beside a merge are looked up again.  Words are told apart first and remembered, so each
distinct word is merged once.  Words of many symbols go by rank instead: a round merges all pairs of
the lowest rank that do not overlap, so a run of 300,000 letters takes about as many rounds as it uses
merges, and the ids are the same.

Defined cases: a null text is the empty one and has no tokens; repeated rows are kept; special
tokens in a text become their ids, as in the library; columns other than ``doc_id`` and ``text``
are ignored; whole texts of any length are encoded; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from causelake.llm.common import doc_texts, flat_take, lean, table, text_slices
from causelake.llm.wordmemo import WordMemo

#: Fixed value: the pattern that parts a text into words for byte-level BPE.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Symbols beyond which a word is merged by rank; the ids are the same either way.
LONG_WORD = 200
NO_RANK = np.int64(1) << 30
#: Bytes (estimated) of remembered words.
MEMO_BYTES = 32 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class ByteBPE:
    """Encoder and decoder of one byte-level BPE vocabulary (a tokenizer's JSON text)."""

    def __init__(self, spec: str):
        described = json.loads(spec)
        model = described["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in described.get("added_tokens", [])}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._word = regex.compile(WORD_PATTERN)
        self._first = np.array([vocab.get(c, -1) for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self._merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        size = max([*vocab.values(), *self.special.values()]) + 1
        made = np.full(size, -1)
        np.maximum.at(made, self._merged, np.arange(len(pairs)))
        self._ascending = bool((np.maximum(made[left], made[right]) < np.arange(len(pairs))).all())
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self._piece_counts = np.fromiter(map(len, pieces), np.int64, size)
        self._piece_starts = np.cumsum(self._piece_counts) - self._piece_counts
        self._pieces = np.frombuffer(b"".join(pieces), np.uint8)
        self.memo = WordMemo(self._encode_words, MEMO_BYTES)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs by binary search over the sorted pair keys."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NO_RANK)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each (non-empty) word."""
        out: list[np.ndarray | None] = [None] * len(words)
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD] if self._ascending else []
        if long:
            for i, ids in zip(long, self._merge_long([words[i] for i in long])):
                out[i] = ids
        short = [i for i, ids in enumerate(out) if ids is None]
        if not short:
            return out
        counts = np.array([len(words[i]) for i in short], np.int64)
        sym = self._first[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        who = np.array(short)
        rank = np.full(len(sym), NO_RANK)
        rank[:-1] = self._rank(sym[:-1], sym[1:])
        rank[np.cumsum(counts) - 1] = NO_RANK  # a word's last symbol has no right neighbour
        while len(sym):
            starts = np.cumsum(counts) - counts
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), starts)
            going = best >> 32 < NO_RANK
            if not going.all():
                ended = np.flatnonzero(~going)
                flat = sym[flat_take(starts[ended], counts[ended])]
                for i, ids in zip(who[ended].tolist(), np.split(flat, np.cumsum(counts[ended])[:-1])):
                    out[i] = ids
                keep = flat_take(starts[going], counts[going])
                moved = best[going] & 0xFFFFFFFF
                old_starts, counts, who = starts[going], counts[going], who[going]
                sym, rank = sym[keep], rank[keep]
                starts = np.cumsum(counts) - counts
                at = moved - old_starts + starts
            else:
                at = best & 0xFFFFFFFF
            if not len(sym):
                break
            sym[at] = self._merged[rank[at]]
            rank[at] = rank[at + 1]  # keeps "no right neighbour" where the word ended
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            last_of_word = np.zeros(len(sym), bool)
            last_of_word[starts + counts - 1] = True
            ends_now = last_of_word[at + 1]
            sym, rank = sym[kept], rank[kept]
            counts = counts - 1
            starts = np.cumsum(counts) - counts
            at = at - np.arange(len(at))
            has_right = ~ends_now
            p = at[has_right]
            rank[p] = self._rank(sym[p], sym[p + 1])
            rank[at[ends_now]] = NO_RANK
            p = at[at > starts]
            rank[p - 1] = self._rank(sym[p - 1], sym[p])
        return out

    def _merge_long(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of long words: rounds by ascending rank over all of them, each merging every free pair of that rank.

        Right where a merge only makes pairs of higher ranks (``_ascending``), as in trained vocabularies.
        """
        counts = np.fromiter(map(len, words), np.int64, len(words))
        sym = self._first[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(counts)
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        after[ends - 1], before[ends - counts] = -1, -1
        rank = np.full(len(sym), NO_RANK)
        alive = np.ones(len(sym), bool)
        waiting: dict[int, list[np.ndarray]] = {}  # places by the rank of the pair that begins there
        ranks: list[int] = []

        def look_up(at: np.ndarray) -> None:
            rank[at] = NO_RANK
            at = at[after[at] >= 0]
            rank[at] = self._rank(sym[at], sym[after[at]])
            at = at[rank[at] < NO_RANK]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1):
                if len(part):
                    r = int(rank[part[0]])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(ranks, r)
                    waiting[r].append(part)

        look_up(np.arange(len(sym)))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            # of pairs that overlap in a run of one symbol every second one, from the left
            place = np.arange(len(at))
            chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
            at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            gone = after[at]
            sym[at], alive[gone] = self._merged[r], False
            after[at] = after[gone]
            inner = at[after[at] >= 0]
            before[after[inner]] = inner
            left = before[at]
            look_up(np.unique(np.concatenate((at, left[left >= 0]))))
        return np.split(sym[alive], np.cumsum([int(n) for n in np.add.reduceat(alive, ends - counts)])[:-1])

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        special = {i: self.special[w[1:]] for i, w in enumerate(words) if w[:1] == "\x00" and w[1:] in self.special}
        filled = [i for i, w in enumerate(raw) if w and i not in special]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        for at in range(0, len(filled), 20_000):
            part = filled[at : at + 20_000]
            for i, ids in zip(part, self.merge([raw[i] for i in part])):
                out[i] = ids
        for i, token in special.items():
            out[i] = np.array([token], np.int64)
        return np.concatenate(out), np.fromiter(map(len, out), np.int64, len(out))

    def _words(self, text: str) -> list[str]:
        if self._special is None or not self._special.search(text):
            return self._word.findall(text)
        out = []
        for piece in self._special.split(text):
            # marked by a byte before it: no word of a text mixes letters with other signs
            out += [f"\x00{piece}"] if piece in self.special else self._word.findall(piece)
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts on end, and how many each has."""
        words = [self._words(t) for t in texts]
        flat = pa.array([w for ws in words for w in ws], pa.string()).dictionary_encode()
        starts, counts, store = self.memo.encode(flat.dictionary.to_pylist())
        at = flat.indices.to_numpy()
        ids = store[flat_take(starts[at], counts[at])]
        ends = np.concatenate(([0], np.cumsum(counts[at])))[np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))]
        return ids, np.diff(ends)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self._pieces[flat_take(self._piece_starts[ids], self._piece_counts[ids])].tobytes()

    def decode(self, ids) -> str:
        """The text; bytes that are not UTF-8 become replacement characters."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_bpe(spec: str) -> ByteBPE:
    return ByteBPE(spec)


def encode_documents(documents: DataFrame, tokenizer_json: str, ids: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every whole text (``ids``: whether they are wanted).

    The hashes are of the ids as little-endian unsigned 32-bit integers and of the UTF-8 of the
    text that they decode to, made beside the ids so that these need not travel for them.
    """
    spec = documents.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = ["doc_id", "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(spec.value)
        for batch in batches:
            for rows in text_slices(batch):
                flat, counts = bpe.encode_batch(rows.column("text").to_pylist())
                ends = np.concatenate(([0], np.cumsum(counts)))
                raw, decoded = memoryview(flat.astype("<u4").tobytes()), memoryview(bpe.decode_bytes(flat))
                byte_ends = np.concatenate(([0], np.cumsum(bpe._piece_counts[flat])))[ends].tolist()
                id_hash = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())]
                said = [hashlib.sha256(str(decoded[a:b], "utf-8", "replace").encode()).hexdigest() for a, b in zip(byte_ends, byte_ends[1:])]
                columns = [rows.column("doc_id"), pa.array(counts, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(id_hash, pa.string()), pa.array(said, pa.string())], names)

    wanted = "ids array<int>, " if ids else ""
    return doc_texts(documents).mapInArrow(lean(encode), f"doc_id long, n_tokens long, {wanted}ids_sha256 string, decoded_sha256 string")


def public_spec(name: str) -> str:
    """The JSON of one of the public tokenizers, read on the driver."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op8_numpy_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_spec("byte_bpe_50k.json"), ids=False)
