"""Encode words once: a bounded memo from word to ids, gathered back with numpy."""

from __future__ import annotations

import os
import string
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from causelake.llm.common import flat_take

#: Bytes (estimated) that one memo remembers; it starts anew beyond them, results do not depend on it.
MEMO_BYTES = 100 << 20
#: Estimated bytes of a remembered word beside its letters and ids.
WORD_BYTES = 120


class WordMemo:
    """``encode_new(list of distinct words) -> (ids on end, how many each has)`` behind a bounded memo."""

    def __init__(self, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = MEMO_BYTES):
        self._encode_new, self._limit = encode_new, limit
        self._reset()

    def _reset(self) -> None:
        self._index: dict[str, int] = {}
        self._flat = np.zeros(1 << 16, np.int32)
        self._starts = np.zeros(1 << 14, np.int64)
        self._counts = np.zeros(1 << 14, np.int32)
        self._used = self._letters = 0

    def _room(self, words: int, ids: int) -> None:
        while self._used + ids > len(self._flat):
            self._flat = np.concatenate((self._flat, np.zeros_like(self._flat)))
        while words > len(self._starts):
            self._starts = np.concatenate((self._starts, np.zeros_like(self._starts)))
            self._counts = np.concatenate((self._counts, np.zeros_like(self._counts)))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: where each one's ids start in the store, how many they are, and the store."""
        which = np.fromiter(map(self._index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(which < 0)
        if self._index and WORD_BYTES * (len(self._index) + len(missing)) + 2 * self._letters + 4 * self._used > self._limit:
            self._reset()
            missing = np.arange(len(words))
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            flat, counts = self._encode_new(new)
            at = len(self._index)
            self._room(at + len(new), len(flat))
            self._flat[self._used : self._used + len(flat)] = flat
            self._counts[at : at + len(new)] = counts
            self._starts[at : at + len(new)] = self._used + np.cumsum(counts) - counts
            self._used += len(flat)
            self._letters += sum(map(len, new))
            which[missing] = np.arange(at, at + len(new))
            self._index.update(zip(new, range(at, at + len(new))))
        return self._starts[which], self._counts[which].astype(np.int64), self._flat


@lru_cache(maxsize=4)
def library_tokenizer(spec: str):
    """A tokenizer of the tokenizers library from its JSON, one thread, no truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def unlike_letters() -> str:
    """Pattern of the letters that normalising and lower-casing do not leave a run of letters.

    Such a letter (a dotted capital I becomes i and a mark) may join the symbols behind it.
    """
    found = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha()]
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in found) + "]"


def blank_free_list(words: pa.Array) -> list[str]:
    """Words without blanks as a list: joined on Arrow's side and parted again, which makes no Arrow scalar a word."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().split(" ")


class LetterWords:
    """Encodes chunks for a tokenizer whose pre-tokens are runs of letters or of symbols.

    A chunk of letters with ASCII symbols behind is its letters' ids and its symbols' ids on end
    (if normalising leaves its letters letters), so each distinct letter word meets the library once, many of them in one call.  Any other
    chunk is encoded as it stands.
    """

    AT_ONCE = 500

    def __init__(self, tokenizer, limit: int = MEMO_BYTES):
        self._tokenizer = tokenizer
        self._letters = WordMemo(self._learn, limit)
        self._others = WordMemo(self._library, limit // 4)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for i in range(0, len(texts), 5000) for e in self._tokenizer.encode_batch(texts[i : i + 5000], add_special_tokens=False)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flats, all_counts = [], []
        for i in range(0, len(words), self.AT_ONCE):
            group = words[i : i + self.AT_ONCE]
            together = self._tokenizer.encode(" ".join(group), add_special_tokens=False)
            flat, counts = np.array(together.ids, np.int32), np.bincount(np.array(together.word_ids, np.int64))
            if len(counts) != len(group):  # some word is more than one run of letters to the library
                flat, counts = self._library(group)
            flats.append(flat)
            all_counts.append(counts)
        return np.concatenate(flats), np.concatenate(all_counts)

    def _look_up(self, memo: WordMemo, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        coded = words.dictionary_encode()
        starts, counts, store = memo.encode(blank_free_list(coded.dictionary))
        at = coded.indices.to_numpy()
        return starts[at], counts[at], store

    def __call__(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        chunk = pa.array(chunks, pa.string())
        letters = pc.utf8_rtrim(chunk, string.punctuation)
        plain = pc.utf8_is_alpha(letters).to_numpy(zero_copy_only=False)
        if not pc.all(pc.string_is_ascii(letters)).as_py():
            plain &= ~pc.match_substring_regex(letters, unlike_letters()).to_numpy(zero_copy_only=False)
        cut = (pc.binary_length(chunk).to_numpy() - pc.binary_length(letters).to_numpy()).tolist()
        other = pa.array([c[len(c) - n :] if p else c for c, n, p in zip(chunks, cut, plain.tolist())], pa.string())
        a_start, a_count, a_store = self._look_up(self._letters, letters.filter(pa.array(plain)))
        b_start, b_count, b_store = self._look_up(self._others, other)
        first = np.zeros(len(chunks), np.int64)
        first[plain] = a_count
        counts = first + b_count
        ends = np.cumsum(counts)
        flat = np.empty(int(counts.sum()), np.int32)
        flat[flat_take((ends - counts)[plain], a_count)] = a_store[flat_take(a_start, a_count)]
        flat[flat_take(ends - b_count, b_count)] = b_store[flat_take(b_start, b_count)]
        return flat, counts


@lru_cache(maxsize=4)
def space_free_memo(spec: str) -> WordMemo:
    """Memo over the library, for a tokenizer that drops white space before it merges."""
    return WordMemo(LetterWords(library_tokenizer(spec)))


def encode_dropping_space(memo: WordMemo, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts on end, and how many each text has; the tokenizer lower-cases.

    Blanks and line ends only part words for such a tokenizer, so a text's ids are its
    blank-free chunks' ids on end.  Words are told apart on Arrow's side.
    """
    if not pc.any(pc.match_substring(texts, "<|")).as_py():  # else it could make a special token
        texts = pc.ascii_lower(texts)
    chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    per_text = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
    words = chunks.flatten().dictionary_encode()
    starts, counts, flat = memo.encode(blank_free_list(words.dictionary))
    at = words.indices.to_numpy()
    counts = counts[at]
    ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(per_text)))]
    return flat[flat_take(starts[at], counts)], np.diff(ends)
