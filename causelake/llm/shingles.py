"""Word-shingle sets of documents as 64-bit hashes, batch-wise in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Fixed odd multipliers, one for each word of a shingle.
WORD_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
SIZE = len(WORD_MIX)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lower-cased words of the texts on end, and how many each text has."""
    texts = pc.ascii_lower(texts)
    for blank in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, blank, " ")
    chunks = pc.split_pattern(texts, " ")
    words = chunks.flatten().dictionary_encode()
    full = np.array([xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    empty = words.dictionary.index("").as_py()
    at = words.indices.to_numpy()
    kept = at != empty
    ends = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(pc.list_value_length(chunks).to_numpy(zero_copy_only=False))))]
    return full[at[kept]], np.diff(ends)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text (none for a text without words)."""
    words, counts = word_hashes(texts)
    n = len(words)
    runs = np.zeros(max(0, n - SIZE + 1), np.uint64)
    for k in range(SIZE):
        runs += words[k : k + len(runs)] * WORD_MIX[k]
    runs = mix(runs)
    at = 0
    for c in counts.tolist():
        if c >= SIZE:
            yield np.unique(runs[at : at + c - SIZE + 1])
        elif c:
            yield np.array([xxhash.xxh64_intdigest(words[at : at + c].tobytes(), seed=c)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)
        at += c
