"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles; two link when their Jaccard similarity
is 0.8 or more.  Then sets of sizes a and b differ in at most (a + b) / 9 shingles.

Parity sketch: shingles fall by hash into blocks, and a block's word is the XOR of the hashes of
its shingles, so a block of equal parity has an equal word and two sets differ in at most as many
blocks as they differ in shingles.  Blocks are cut per size band (a factor of four; a document
within 1.25 of the band below takes part there too), so linked documents meet in a band.

Pigeonhole join: of a band's m blocks, linked sets with at most d differences share m - d.  In one
order of all possible block words (fullest block first, then by hash) each therefore has a shared
word among its first d + 1, and only those are join keys.

Links, not pairs: keys are sorted and streamed.  First each key's members meet only its least
member; verified links are contracted.  Then only members of one key in *different* components
are compared, blockwise, by Hamming distance of dense parity sketches, which bounds the symmetric
difference from below; what passes is verified on the whole texts.  So a group of thousands of
copies costs its size, not its square, and no link between components is lost.  Keys that a sample of
the sets shows to be frequent are dealt out by the sets' hashes: each part has a leader of its own, these
meet in a second step, and the parts' pieces are compared task by task.  The sample only plans; every
row is compared alike.

Sets and shingles are told apart by 64-bit hashes.  Defined cases: null, empty or blank texts
have no shingles and link with nothing; a text of fewer than five words is one shingle; repeated
rows and ids are kept; a null ``doc_id`` never names a component of others; texts of any length are
read whole; of several least ids none matters, as equal ids are one name; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causelake.llm.common import doc_texts, lean, materialise, spread_join, table, text_slices
from causelake.llm.components import connected_components
from causelake.llm.shingles import mix, shingle_sets

BAND = 4
#: Mean shingles in a block for the largest sets of a band.
FULL = 3.5
#: Members of a key that are compared at once.
MEMBERS = 512
#: Set hashes a task remembers, to send the keys of equal sets once.
SEEN = 250_000
#: One set in this many is sampled to find frequent keys; rows of one key that a task should get; keys dealt out at most.
SAMPLE = 16
KEY_ROWS = 1024
MOST_HOT = 10_000
MOST_PARTS = 4096

SET_SCHEMA = "doc_id long, version long, n int, set long, sketch binary, keys array<long>"


def band_of(n: int) -> int:
    """The size band of a set of ``n`` shingles."""
    k = 0
    while BAND ** (k + 1) <= n:
        k += 1
    return k


def differences(a: int, b: int) -> int:
    """Most shingles in which linked sets of these sizes differ."""
    return (a + b) // 9


def sketch_bits(band: int) -> int:
    """Bits of a dense sketch: some four for each shingle of the band's largest set."""
    return max(64, 4 * BAND ** (band + 1))


def dense_sketch(s: np.ndarray, band: int) -> np.ndarray:
    """A band's dense parity sketch: one bit flips for each shingle."""
    bits = sketch_bits(band)
    parity = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(sketch: np.ndarray) -> np.ndarray:
    """The same set's sketch for the band below: its parts XOR."""
    words = next(sketch_bits(k) // 64 for k in range(30, -1, -1) if sketch_bits(k) < 64 * len(sketch))
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def band_keys(s: np.ndarray, band: int, most: int) -> np.ndarray:
    """The first ``most + 1`` block words of a sorted set in a band, as 64-bit keys."""
    m = max(1, int(BAND ** (band + 1) * 1.25 / FULL))
    block = (s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
    first = np.flatnonzero(np.diff(block, prepend=np.uint64(m + 1)))
    words = np.bitwise_xor.reduceat(mix(s + np.uint64(77)), first)
    filled = np.diff(np.append(first, len(s)))
    tag = np.uint64((band + 1) << 40)
    keys = mix(words + mix(block[first] + tag))
    order = np.lexsort((keys, -filled))[: most + 1]
    keys = keys[order]
    if len(keys) <= most:  # blocks without shingles come last
        empty = np.setdiff1d(np.arange(m, dtype=np.uint64), block[first])
        keys = np.concatenate((keys, np.sort(mix(mix(empty + tag)))[: most + 1 - len(keys)]))
    return keys


def set_keys(s: np.ndarray) -> np.ndarray:
    """All join keys of a set; none where only equal sets could link."""
    n = len(s)
    if n < BAND:
        return np.zeros(0, np.uint64)
    own = band_of(n)
    keys = [band_keys(s, own, n // 4)]  # a partner has up to 1.25 n, so n / 4 differences
    if 5 * BAND**own > 4 * n:  # partners of 0.8 n and more reach into the band below, and are smaller
        keys.append(band_keys(s, own - 1, 2 * n // 9))
    return np.concatenate(keys)


def set_table(documents: DataFrame) -> DataFrame:
    """Per document: size and hash of its set; keys and sketch where the task meets the set first."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for rows in text_slices(batch):
                n, ids, sketches, keys, ends = [], [], [], [], [0]
                for s in shingle_sets(rows.column("text")):
                    h = xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else None
                    n.append(len(s))
                    ids.append(None if h is None else h - (1 << 63))
                    if h is None or h in seen:
                        sketches.append(None)
                    else:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(h)
                        sketches.append(dense_sketch(s, band_of(len(s))).tobytes())
                        keys.append(set_keys(s))
                    ends.append(ends[-1] + (len(keys[-1]) if sketches[-1] is not None else 0))
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("version"), pa.array(n, pa.int32()), pa.array(ids, pa.int64()), pa.array(sketches, pa.binary()), lists],
                    ["doc_id", "version", "n", "set", "sketch", "keys"],
                )

    texts = doc_texts(documents).select("doc_id", "text", F.xxhash64("text").alias("version"))
    return texts.mapInArrow(lean(sets), SET_SCHEMA)


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, int, bool, dict[str, list]]]:
    """Runs of equal ``key`` (and ``part``) in a sorted stream, in pieces: (key, part, whether the piece begins its run, columns)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0)) + 1
        for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(key)])).tolist()):
            here = int(key[a]), int(part[a])
            yield (*here, here != last, {c: batch.column(c).slice(a, b - a) for c in columns})
            last = here


def _with_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, set, leader``: members of a key's part that has several, without its least one."""
    last = lead = prev = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, part, node = (batch.column(c).to_numpy() for c in ("key", "part", "set"))
        begins = np.concatenate(([last != (key[0], part[0])], (np.diff(key) != 0) | (np.diff(part) != 0)))
        if not begins[0]:
            leaders = np.concatenate(([lead], node))
            at = np.maximum.accumulate(np.where(begins, np.arange(1, len(key) + 1), 0))
            repeats = np.concatenate(([node[0] == prev], np.diff(node) == 0)) & ~begins
        else:
            leaders = node
            at = np.maximum.accumulate(np.where(begins, np.arange(len(key)), 0))
            repeats = np.concatenate(([False], np.diff(node) == 0)) & ~begins
        leader = leaders[at]
        kept = (leader != node) & ~repeats
        last, lead, prev = (key[-1], part[-1]), leader[-1], node[-1]
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[kept]), pa.array(leader[kept])], ["key", "set", "leader"])


def close_in_sketch(n_a: np.ndarray, a: np.ndarray, n_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of the pairs whose sizes and sketches allow a link, Hamming distances); rows of ``a`` and ``b`` are sketches."""
    most = (n_a[:, None] + n_b[None, :]) // 9
    fits = (4 * n_a[:, None] <= 5 * n_b[None, :]) & (4 * n_b[None, :] <= 5 * n_a[:, None])
    apart = np.zeros(fits.shape, np.int32)
    for w in range(a.shape[1]):
        apart += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return fits & (apart <= most), apart


def spanning(i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the component pairs ``i, j`` span what all of them connect, nearest first."""
    low, high = np.minimum(i, j), np.maximum(i, j)
    order = np.lexsort((apart, high, low))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
    best = order[new]  # the nearest pair of each two components
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept = []
    for e in best[np.argsort(apart[best], kind="stable")].tolist():
        x, y = find(int(i[e])), find(int(j[e]))
        if x != y:
            root[y] = x
            kept.append(e)
    return np.array(kept, np.int64)


def fold_rows(sketches: np.ndarray) -> np.ndarray:
    """:func:`fold` of sketches of one width, a row each."""
    words = next(sketch_bits(k) // 64 for k in range(30, -1, -1) if sketch_bits(k) < 64 * sketches.shape[1])
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def _level(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one key's members as rows of the shortest one's length."""
    arrays = [np.frombuffer(x, np.uint64) for x in sketches]
    least = min(map(len, arrays))
    for i, x in enumerate(arrays):
        while len(x) > least:
            x = fold(x)
        arrays[i] = x
    return np.stack(arrays)


PIECES = "key long, a long, b long, piece long, sets binary, sizes binary, components binary, sketches binary"


def _cross_pairs(every: bool):
    """Of each key's pieces: close pairs across components inside the piece, and the pieces of keys with several.

    With ``every`` all such pairs; else as many as span the components that they connect.
    """
    names = ["key", "a", "b", "piece", "sets", "sizes", "components", "sketches"]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 4

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        key = part = None
        piece = 0

        def close(ends: bool) -> Iterator[pa.RecordBatch]:
            node, n, comp = (np.array(held[c], np.int64) for c in ("set", "n", "component"))
            sketch = _level(held["sketch"])
            near, apart = close_in_sketch(n, sketch, n, sketch)
            i, j = np.nonzero(np.triu(near & (comp[:, None] != comp[None, :]), 1))
            if len(i) and not every:
                kept = spanning(comp[i], comp[j], apart[i, j])
                i, j = i[kept], j[kept]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), key, np.int64)), pa.array(node[i]), pa.array(node[j])] + [pa.nulls(len(i), k) for k in kinds[3:]], names)
            if piece or not ends or several:  # the key has several pieces, which are yet to meet
                body = [key, None, None, part << 32 | piece, node.tobytes(), n.tobytes(), comp.tobytes(), sketch.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(body, kinds)], names)

        several = False
        for k, q, begins, columns in _groups(batches, ["set", "n", "component", "sketch", "parts"]):
            if begins and held:
                yield from close(True)
                held, piece = {}, 0
            key, part, several = k, q, columns.pop("parts")[0].as_py() > 1
            rows = {c: v.to_pylist() for c, v in columns.items()}
            for at in range(len(rows["set"])):
                if held and len(held["set"]) == MEMBERS:
                    yield from close(False)
                    held, piece = {}, piece + 1
                for c, v in rows.items():
                    held.setdefault(c, []).append(v[at])
        if held:
            yield from close(True)

    return stream


def _piece_pairs(every: bool):
    """Close pairs across components between two pieces of one key."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (a, n_a, c_a), (b, n_b, c_b) = ([np.frombuffer(row[f"{c}{k}"], np.int64) for c in ("sets", "sizes", "components")] for k in "12")
                s_a, s_b = (np.frombuffer(row[f"sketches{k}"], np.uint64).reshape(len(x), -1) for k, x in (("1", a), ("2", b)))
                while s_a.shape[1] != s_b.shape[1]:
                    wide = s_a.shape[1] > s_b.shape[1]
                    s_a, s_b = (fold_rows(s_a), s_b) if wide else (s_a, fold_rows(s_b))
                near, apart = close_in_sketch(n_a, s_a, n_b, s_b)
                i, j = np.nonzero(near & (c_a[:, None] != c_b[None, :]))
                if len(i) and not every:
                    kept = spanning(c_a[i], c_b[j], apart[i, j])
                    i, j = i[kept], j[kept]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), row["key"], np.int64)), pa.array(a[i]), pa.array(b[j])], ["key", "a", "b"])

    return stream


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole texts link."""
    for batch in batches:
        for rows in text_slices(batch, "text_a", 1_000_000):
            a, b = (list(shingle_sets(rows.column(c))) for c in ("text_a", "text_b"))
            common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)]
            ok = pa.array([100 * i >= 80 * (len(x) + len(y) - i) for x, y, i in zip(a, b, common)], pa.bool_())
            yield pa.RecordBatch.from_arrays([rows.column("a"), rows.column("b")], ["a", "b"]).filter(ok)


def _verified(pairs: DataFrame, sets: DataFrame, documents: DataFrame) -> DataFrame:
    """Of candidate pairs of sets, the links: exact, on whole texts, one text standing for each set."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
    stand = sets.join(nodes, "set").groupBy("set").agg(F.min("version").alias("version"))
    # not every copy's text travels: copies are reduced before the exchange
    texts = (
        doc_texts(documents).select(F.xxhash64("text").alias("version"), "text")
        .join(stand.select("version").distinct(), "version").groupBy("version").agg(F.first("text").alias("text"))
        .join(stand, "version").select("set", "text")
    )
    texts = materialise(texts, "verify-texts")
    side = lambda k: texts.select(F.col("set").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(lean(_linked), "a long, b long")


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and sketches allow a link; sketches of one width at once."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
        kept = (4 * n_a <= 5 * n_b) & (4 * n_b <= 5 * n_a)
        wide = np.stack([pc.binary_length(batch.column(c)).to_numpy().astype(np.int64) for c in ("sketch_a", "sketch_b")], 1)
        for shape in np.unique(wide[kept], axis=0):
            at = np.flatnonzero(kept & (wide == shape).all(1))
            a, b = (np.frombuffer(b"".join(batch.column(c).take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), -1) for c in ("sketch_a", "sketch_b"))
            while a.shape[1] != b.shape[1]:
                a, b = (fold_rows(a), b) if a.shape[1] > b.shape[1] else (a, fold_rows(b))
            kept[at] = np.bitwise_count(a ^ b).sum(1, dtype=np.int64) <= (n_a[at] + n_b[at]) // 9
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))


def frequent_keys(sets: DataFrame) -> DataFrame:
    """``hot_key, parts`` of keys that a sample of the sets shows to be frequent: ``MOST_HOT`` rows at most."""
    sampled = sets.where(F.pmod(F.xxhash64("set"), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key"))
    counts = sampled.groupBy("key").agg((F.count("*") * SAMPLE).alias("n")).where(F.col("n") > KEY_ROWS).orderBy(F.desc("n"), "key").limit(MOST_HOT)
    return materialise(counts.select(F.col("key").alias("hot_key"), F.least(F.lit(MOST_PARTS), F.ceil(F.col("n") / KEY_ROWS)).cast("int").alias("parts")), "frequent")


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of keys with ``part`` (by the set's hash) and ``parts`` of the key."""
    known = rows.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left").drop("hot_key").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return known.withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int"))


def key_members(sets: DataFrame, hot: DataFrame) -> DataFrame:
    """``key, set, leader``: members of keys that have several, each with the least one of its part.

    The parts' least members of a frequent key are members too, with the least of all for leader.
    """
    keys = _dealt(sets.select(F.explode("keys").alias("key"), "set"), hot)
    ordered = keys.select("key", "part", "set").repartition("key", "part").sortWithinPartitions("key", "part", "set")
    inside = ordered.mapInArrow(lean(_with_leaders), "key long, set long, leader long")
    tops = keys.where("parts > 1").groupBy("key", "part").agg(F.min("set").alias("set"))
    heads = tops.groupBy("key").agg(F.min("set").alias("leader"), F.count("*").alias("held")).where("held > 1")
    return materialise(inside.unionByName(tops.join(heads, "key").select("key", "set", "leader")), "members")


def set_components(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, version, n, set`` of each document, ``node, component`` of the sets that link with others)."""
    sets = materialise(set_table(documents), "sets")
    sketches = sets.where(F.col("sketch").isNotNull()).groupBy("set").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    hot = frequent_keys(sets)
    members = key_members(sets, hot)
    side = lambda k: sketches.select(F.col("set").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    pairs = members.select(F.col("set").alias("a"), F.col("leader").alias("b")).where("a <> b").distinct()
    close = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(_close_pairs), "a long, b long")
    links = materialise(_verified(materialise(close, "candidates"), sets, documents), "links")
    first = materialise(connected_components(links), "components")

    labelled = _labelled(members, first)
    tried = _crossing(labelled, sketches, hot, every=False)
    links = materialise(_verified(tried.select("a", "b").distinct(), sets, documents), "more-links")
    second = materialise(connected_components(_as_edges(first).unionByName(links)), "components")

    # where a pair of a key's spanning ones fails, all of that key's remaining pairs are verified
    failed = materialise(tried.join(links, ["a", "b"], "left_anti").select("key", "a", "b"), "failed")
    again = _labelled(members.join(failed.select("key").distinct(), "key"), second)
    rest = _crossing(again, sketches, hot, every=True).select("a", "b").distinct().join(failed.select("a", "b").distinct(), ["a", "b"], "left_anti")
    last = materialise(_verified(materialise(rest, "last-candidates"), sets, documents), "last-links")
    return sets.drop("sketch", "keys"), connected_components(_as_edges(second).unionByName(last))


def _as_edges(components: DataFrame) -> DataFrame:
    return components.select(F.col("node").alias("a"), F.col("component").alias("b"))


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    """``key, set, component`` of the members of keys that hold several components."""
    labelled = members.join(components.withColumnRenamed("node", "set"), "set", "left").select("key", "set", F.coalesce("component", "set").alias("component"))
    labelled = materialise(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x != y").select("key")
    return labelled.join(materialise(mixed, "mixed"), "key")  # written, so that the join sees whether they are few


def _crossing(labelled: DataFrame, sketches: DataFrame, hot: DataFrame, every: bool) -> DataFrame:
    """``key, a, b``: close pairs of one key's members across components, blockwise.

    Which pieces of a key meet is a narrow table; their contents are then joined by key and piece, so
    that the pairs of a frequent key are compared in as many tasks as it has pieces.
    """
    rows = _dealt(labelled, hot).join(sketches, "set").select("key", "part", "parts", "set", "n", "component", "sketch")
    ordered = rows.repartition("key", "part").sortWithinPartitions("key", "part", "set")
    pieces = materialise(ordered.mapInArrow(lean(_cross_pairs(every)), PIECES), "pieces")
    blocks = pieces.where(F.col("piece").isNotNull())
    half = lambda k: blocks.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("piece", "sets", "sizes", "components", "sketches")])
    number = lambda k: blocks.select("key", F.col("piece").alias(f"piece{k}"))
    meet = number(1).join(number(2), "key").where("piece1 < piece2")
    between = meet.join(half(1), ["key", "piece1"]).join(half(2), ["key", "piece2"]).mapInArrow(lean(_piece_pairs(every)), "key long, a long, b long")
    pairs = pieces.where(F.col("piece").isNull()).select("key", "a", "b").unionByName(between)
    return materialise(pairs.select("key", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "crossing")


def labelled_documents(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, version, n, component`` (null without shingles; else a set's hash)."""
    sets, components = set_components(documents)
    labelled = sets.join(components.withColumnRenamed("node", "set"), "set", "left").select(
        "doc_id", "version", "n", F.coalesce("component", "set").alias("component")
    )
    return materialise(labelled, "labelled-documents")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id``."""
    labelled = labelled_documents(documents)
    least = labelled.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("least"))
    return spread_join(labelled.withColumn("spread", F.xxhash64("doc_id")), least, "component", "spread").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")
    )


def representatives(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` with one of each group of near copies: that of the least ``doc_id``.

    Rows without words belong to no group and stay.  All columns are kept as they are.
    """
    labelled = labelled_documents(documents)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("first")
    grouped = labelled.where(F.col("component").isNotNull()).groupBy("component").agg(first).select("first.doc_id", "first.version", F.lit(True).alias("one"))
    alone = labelled.where(F.col("component").isNull()).select("doc_id", "version", F.lit(False).alias("one")).distinct()
    kept = grouped.unionByName(alone).toDF("kept_id", "kept_version", "one")
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("own_version")
    )
    joined = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_version") == F.col("kept_version")))
    again = Window.partitionBy("own_id", "own_version").orderBy("one")
    return joined.withColumn("again", F.row_number().over(again)).where("again = 1 or not one").select("row.*")


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
