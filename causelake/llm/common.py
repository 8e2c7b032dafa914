"""Helpers that the operators share: table access, shared scratch tables, batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one Python step holds at once (a longer single text is held alone).
CHARS_AT_ONCE = 1_000_000


#: Bytes of an Arrow batch that travels to a Python worker; Spark's default of 64 MB is held several times over.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of Arrow batches, if it is higher: texts may be long and workers many."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = (spark.conf.get(name, None) or "").rstrip("b")
    if not held.isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def lean(stream):
    """A batch stream whose worker hands its freed memory back when the task ends, for idle workers are kept."""

    def run(batches):
        yield from stream(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # no such call outside glibc
            ctypes.CDLL(None).malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader (any file system Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent *and* the session is local is a temporary folder made
    (then driver and executors are one process on one disk).
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = own.get() if own.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="causelake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_SCRATCH: list[tuple[object, str]] = []


def _remove_scratch() -> None:
    for jvm_path, fs in _SCRATCH:
        try:
            fs.delete(jvm_path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit; then the folder's owner clears it
            return


atexit.register(_remove_scratch)


#: Whether the files of an execution's own exchanges go when it ends (else when the driver's JVM next finds its plan unreachable).
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def exchanges_released(spark: SparkSession):
    """What is executed inside drops its exchanges' files when it ends; the session's setting is put back."""
    held = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, held)


def materialise(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    With ``release`` the exchanges that the write needed go as soon as it ends, for a large step whose
    exchanged rows would else lie beside those of the next.

    Cuts lineage: a lost executor never recomputes what came before, as the files are
    committed in shared storage.  Scratch folders go when the driver ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with exchanges_released(spark) if release else contextlib.nullcontext():
        df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    _SCRATCH.append((jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())))
    return spark.read.schema(df.schema).parquet(path)


def spans_of(lengths: np.ndarray, limit: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose lengths sum to at most ``limit`` (one row at least)."""
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += int(n)
    if begin < len(lengths):
        yield begin, len(lengths)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHARS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batch in zero-copy slices whose text is bounded."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in spans_of(n, limit):
        yield batch.slice(a, b - a)


def flat_take(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Index array that concatenates ``range(s, s + c)`` of each pair."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total, dtype=np.int64)


def arrow_strings(offsets: np.ndarray, data: bytes | np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary array from offsets and one buffer."""
    kind = kind or pa.large_binary()
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def doc_texts(documents: DataFrame) -> DataFrame:
    """``doc_id, text`` with a null text as the empty one; further columns do not matter."""
    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(name: str, taken: list[str]) -> str:
    """The name, with ``_`` behind it until no column of the others has it."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


#: Rows of two numbers that may be broadcast.
FEW_ROWS = 1_000_000


def sized(written: DataFrame, bound: int = FEW_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most ``bound`` of them."""
    return F.broadcast(written) if written.count() <= bound else written


#: Rows of one key beyond which it is dealt out, how many such keys are known, and most pieces of a key.
HOT_ROWS = 500
MOST_HOT = 1000
MOST_PIECES = 1000


def spread_join(rows: DataFrame, side: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join of many rows with a table that has one row a key; rows of a hot key go to several tasks.

    The ``MOST_HOT`` most frequent keys (a bounded table, so broadcast) are cut into pieces by the number
    in ``spread``, and the other side's rows repeated for each piece.  Rows without a key are dealt out
too and match nothing.  ``spread`` is dropped.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), key).limit(MOST_HOT)
    hot = materialise(counts.select(F.col(key).alias("hot_key"), F.least(F.lit(MOST_PIECES), F.ceil(F.col("n") / HOT_ROWS)).cast("int").alias("pieces")), "hot-keys")
    dealt = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").drop("hot_key")
    own = dealt(rows).withColumn("piece", F.expr(f"cast(case when {key} is null then pmod({spread}, {MOST_PIECES}) else coalesce(pmod({spread}, pieces), 0) end as int)")).drop("pieces", spread)
    other = dealt(side).withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return own.join(other, [key, "piece"], "left").drop("piece")
