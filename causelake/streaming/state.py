"""Incremental state on Structured Streaming: sums that add up, and logs of what they make stale.

A Gram is additive, so each micro-batch contributes its own Gram row to a table and the current fit
is the sum of the rows; a batch that is replayed overwrites its row, which makes the sink idempotent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from causelake.errors import DataError
from causelake.operators.reduce import Fit, Gram, solve


def gram_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of cross products of [1, columns]; sums of such rows are the Gram of all their data."""
    names = ["1", *columns]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    return df.agg(*[F.coalesce(F.sum(value(a) * value(b)), F.lit(0.0)).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j])


def from_rows(rows: DataFrame, columns: Sequence[str]) -> Gram:
    names = ("1", *columns)
    total = rows.agg(*[F.sum(c).alias(c) for c in rows.columns if c.startswith("s")]).first()
    m = np.zeros((len(names), len(names)))
    for i in range(len(names)):
        for j in range(i, len(names)):
            m[i, j] = m[j, i] = total[f"s{i}_{j}"] or 0.0
    return Gram(names, m)


@dataclass
class IncrementalOls:
    """Appends batches to a table of Gram rows partitioned by batch; the fit reads that small table only."""

    path: str
    columns: tuple[str, ...]
    outcome: str

    def append(self, batch: DataFrame, batch_id: int) -> None:
        gram_rows(batch, [*self.columns, self.outcome]).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None):
        writer = stream.writeStream.foreachBatch(lambda b, i: self.append(b, i)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def fit(self, spark: SparkSession) -> Fit:
        rows = spark.read.parquet(self.path)
        return solve(from_rows(rows, [*self.columns, self.outcome]), self.outcome, ["1", *self.columns])


def streaming_moments(stream: DataFrame, key: str, x: str, y: str, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Windowed covariance and slope per key on event time, with a watermark for late rows."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width), key)
    return w.agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("covariance"), F.var_pop(x).alias("variance_x"), F.avg(y).alias("mean_y"))


def streaming_event_grid(stream: DataFrame, time: str, value: str, step: str, origin: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """The regular grid on a stream: tumbling windows from a fixed origin, the last event of a bin wins."""
    w = stream.withWatermark(time, late).groupBy(*by, F.window(time, step, startTime=origin))
    return w.agg(F.max_by(value, time).alias("value"))


def rolling_state(stream: DataFrame, key: str, order: str, x: str, y: str, window: int) -> DataFrame:
    """Slope over the last ``window`` rows of each key, kept as bounded state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for f in frames:
            held += list(f.sort_values(order)[[order, x, y]].itertuples(index=False, name=None))
        held = sorted(held)[-window:]
        state.update(tuple(map(list, zip(*held))))
        a = np.array(held, float)
        v = a[:, 1].var()
        slope = float(((a[:, 1] - a[:, 1].mean()) * (a[:, 2] - a[:, 2].mean())).mean() / v) if v > 0 else None
        yield pd.DataFrame({key: [k[0]], "n": [len(a)], "slope": [slope]})

    kind = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind[key]}, n long, slope double", "o array<double>, x array<double>, y array<double>", "update", GroupStateTimeout.NoTimeout
    )


def particle_filter(df: DataFrame, unit: str, time: str, value: str, a: float, process_sd: float, obs_sd: float, particles: int = 64, seed: int = 0) -> DataFrame:
    """Bootstrap filter per unit, resampling when the effective size halves; numbers depend on (seed, step) only."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time)
        x, w, out = np.zeros(particles), np.full(particles, 1 / particles), []
        for i, y in enumerate(g[value].to_numpy(float)):
            rng = np.random.default_rng([seed, i])
            x = a * x + process_sd * rng.normal(size=particles)
            w = w * np.exp(-0.5 * ((y - x) / obs_sd) ** 2) + 1e-300
            w /= w.sum()
            ess = 1 / (w * w).sum()
            out.append((float(w @ x), float(ess)))
            if ess < particles / 2:
                at = np.searchsorted(np.cumsum(w), (np.arange(particles) + rng.random()) / particles)
                x, w = x[np.minimum(at, particles - 1)], np.full(particles, 1 / particles)
        return pd.DataFrame({unit: g[unit].to_numpy(), time: g[time].to_numpy(), "mean": [m for m, _ in out], "ess": [e for _, e in out]})

    kind = dict(df.dtypes)
    return df.select(unit, time, value).groupBy(unit).applyInPandas(run, f"{unit} {kind[unit]}, {time} {kind[time]}, mean double, ess double")


EVENTS = ("append_data", "replace_data", "evidence", "constraints", "assumptions", "query", "intervention")
#: What an event makes stale.
STALE = {
    "append_data": ("statistics", "models", "results"),
    "replace_data": ("statistics", "models", "results"),
    "evidence": ("models", "results"),
    "constraints": ("graphs", "models", "results"),
    "assumptions": ("identification", "results"),
    "query": (),
    "intervention": ("results",),
}


@dataclass
class CausalState:
    """Versioned artifacts and an append-only log of what became stale; nothing is rerun by itself."""

    budget_bytes: int = 1 << 30
    version: int = 0
    log: list[tuple[int, str, str, str]] = field(default_factory=list)
    artifacts: dict[tuple[str, str], int] = field(default_factory=dict)
    held: dict[str, int] = field(default_factory=dict)

    def register(self, kind: str, name: str) -> None:
        self.artifacts[kind, name] = self.version

    def apply(self, event: str, detail: str = "") -> list[tuple[str, str]]:
        """Raises the version and returns the artifacts that are now stale."""
        if event not in EVENTS:
            raise DataError(f"no event {event!r}")
        self.version += 1
        stale = [k for k, v in self.artifacts.items() if k[0] in STALE[event] and v < self.version]
        self.log += [(self.version, event, kind, name) for kind, name in stale]
        if detail or not stale:
            self.log.append((self.version, event, "", detail))
        return stale

    def is_stale(self, kind: str, name: str) -> bool:
        at = self.artifacts[kind, name]
        return any(v > at and k == kind and n == name for v, _, k, n in self.log)

    def admit(self, name: str, size: int, evict: bool = False) -> bool:
        """Whether a cache entry fits the budget; refused entries are not held.

        With ``evict`` the entries longest unused go first until it fits; one larger than the budget is still refused.
        """
        old = self.held.pop(name, None)
        room = self.budget_bytes - sum(self.held.values())
        if size > self.budget_bytes or (size > room and not evict):
            if old is not None:
                self.held[name] = old
            return False
        while size > self.budget_bytes - sum(self.held.values()):
            gone = next(iter(self.held))
            self.log.append((self.version, "evict", "cache", gone))
            del self.held[gone]
        self.held[name] = size
        return True

    def touch(self, name: str) -> None:
        """Marks a cache entry as used now."""
        self.held[name] = self.held.pop(name)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "version long, event string, kind string, name string")


@dataclass(frozen=True)
class Retention:
    """What raw history a component needs: ``raw`` (all), ``window`` (the latest ``rows`` of each key) or ``statistics`` (sums only)."""

    kind: str = "raw"
    rows: int | None = None

    def __post_init__(self):
        if self.kind not in ("raw", "window", "statistics") or (self.kind == "window") != (self.rows is not None and self.rows > 0):
            raise DataError("retention is raw, statistics, or a window of a positive number of rows")

    def keep(self, history: DataFrame, order: str, by: Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
        """The history that is to stay: all rows, the latest of each key (ties by the other columns), or one row of cross products.

        A window is ranked within its key, so a rank limit is pushed below the shuffle and no task holds more than its keys' latest rows.
        """
        if self.kind == "raw":
            return history
        if self.kind == "statistics":
            return gram_rows(history, columns)
        if not by:
            raise DataError("a window is kept for each key")
        w = Window.partitionBy(*by).orderBy(F.col(order).desc(), F.xxhash64(*history.columns))
        return history.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= self.rows).drop("__r")


def strictest(needs: Sequence[Retention]) -> Retention:
    """The least history that serves all components: everything, else the longest window, else sums."""
    if any(n.kind == "raw" for n in needs):
        return Retention("raw")
    windows = [n.rows for n in needs if n.kind == "window"]
    return Retention("window", max(windows)) if windows else Retention("statistics")


def delta_score(before: float, local_before: float, local_after: float) -> float:
    """A graph's score after one node's parents change."""
    return before - local_before + local_after


def bic(n: float, rss: float, parents: int) -> float:
    return -0.5 * n * (1 + math.log(2 * math.pi) + math.log(max(rss / n, 1e-12))) - 0.5 * (parents + 1) * math.log(n)
