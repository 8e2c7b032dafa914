"""Running staged work: progress, cancellation, partial results under a time limit, and where plans cross into Python."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from causelake.errors import CausalError


class Cancelled(CausalError):
    """The work was cancelled by its token."""


@dataclass
class Token:
    """Cancels work from any thread: stages not begun are skipped and the running stage's Spark jobs are stopped."""

    group: str = field(default_factory=lambda: f"causelake-{uuid.uuid4().hex}")
    _flag: threading.Event = field(default_factory=threading.Event)

    def cancel(self, spark: SparkSession | None = None) -> None:
        self._flag.set()
        if spark is not None:
            spark.sparkContext.cancelJobsWithTag(self.group)

    @property
    def cancelled(self) -> bool:
        return self._flag.is_set()


@dataclass(frozen=True)
class StageResult:
    """How a stage ended: ``done``, ``failed``, ``cancelled`` or ``skipped`` (no time was left)."""

    name: str
    state: str
    seconds: float
    value: object = None
    error: str = ""


def run_stages(spark: SparkSession, stages: Sequence[tuple[str, Callable[[dict], object]]], token: Token | None = None, progress: Callable[[float, str], None] | None = None, seconds: float | None = None, required: Sequence[str] = ()) -> list[StageResult]:
    """Runs stages in order, each given the values of those before it by name.

    ``progress`` hears the fraction done before each stage and 1.0 at the end.  A stage that fails, or that no time is left
    for, is recorded and the next goes on, so what is done is kept; a required one that is not done raises.  Spark jobs
    of a stage carry the token's tag.
    """
    token, began, held, out = token or Token(), time.monotonic(), {}, []
    for i, (name, work) in enumerate(stages):
        if progress:
            progress(i / len(stages), name)
        start = time.monotonic()
        if token.cancelled:
            out.append(StageResult(name, "cancelled", 0.0))
        elif seconds is not None and start - began > seconds and name not in required:
            out.append(StageResult(name, "skipped", 0.0))
        else:
            spark.sparkContext.addJobTag(token.group)
            try:
                held[name] = work(dict(held))
                out.append(StageResult(name, "done", time.monotonic() - start, held[name]))
            except Exception as e:  # a stage's failure is a result; required ones raise below
                state = "cancelled" if token.cancelled else "failed"
                out.append(StageResult(name, state, time.monotonic() - start, error=str(e)))
                if name in required and state == "failed":
                    raise
            finally:
                spark.sparkContext.removeJobTag(token.group)
        if name in required and out[-1].state != "done":
            raise Cancelled(f"required stage {name} was {out[-1].state}")
    if progress:
        progress(1.0, "")
    return out


def stage_table(spark: SparkSession, results: Sequence[StageResult]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.state, r.seconds, r.error) for r in results], "stage string, state string, seconds double, error string")


#: Physical operators that hand rows to Python workers, and whether they do so in Arrow batches.
CROSSINGS = {
    "BatchEvalPython": False, "ArrowEvalPython": True, "MapInArrow": True, "MapInPandas": True, "PythonMapInArrow": True, "FlatMapGroupsInPandas": True, "FlatMapGroupsInArrow": True,
    "FlatMapCoGroupsInPandas": True, "AggregateInPandas": True, "ArrowAggregatePython": True, "WindowInPandas": True, "ArrowWindowPython": True, "FlatMapGroupsInPandasWithState": True, "MapPartitionsInRWithArrow": True,
}


def crossings(df: DataFrame) -> DataFrame:
    """``operator, batched, count``: where the plan of a DataFrame crosses into Python; empty where it stays in the JVM."""
    text = df._jdf.queryExecution().executedPlan().toString()
    names = [line.replace("+-", " ").replace(":-", " ").replace(":", " ").strip().lstrip("*").split(") ", 1)[-1].split(" ", 1)[0].split("(")[0] for line in text.splitlines()]
    found = [(n, b, names.count(n)) for n, b in CROSSINGS.items() if n in names]
    return df.sparkSession.createDataFrame(found, "operator string, batched boolean, count long")
