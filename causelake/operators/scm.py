"""Structural causal models: fitted by one Gram, sampled and abducted as column expressions.

Nodes are visited in topological order, one expression a node; noise is hashed from the row's key,
so a world and its counterfactual share it and a lost task makes the same numbers again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causelake.errors import EstimationError, Unsupported
from causelake.functions.transforms import normal, uniform
from causelake.graphs.dag import Dag
from causelake.operators.reduce import cpt, gram, solve


@dataclass
class Linear:
    """value = intercept + sum(coefficients * parents) + sd * noise."""

    intercept: float
    coefficients: dict[str, float]
    sd: float

    def mean(self, values: dict[str, Column]) -> Column:
        return sum((F.lit(b) * values[p] for p, b in self.coefficients.items()), F.lit(self.intercept))

    def value(self, values: dict[str, Column], noise: Column) -> Column:
        return self.mean(values) + F.lit(self.sd) * noise

    def noise(self, values: dict[str, Column], own: Column) -> Column:
        return (own - self.mean(values)) / F.lit(self.sd if self.sd > 0 else 1.0)

    def log_density(self, values: dict[str, Column], own: Column) -> Column:
        z = self.noise(values, own)
        return -0.5 * z * z - math.log(max(self.sd, 1e-300)) - 0.5 * math.log(2 * math.pi)


@dataclass
class Discrete:
    """A table of P(value | parents), small, as cumulative ``when`` branches."""

    levels: list
    table: dict[tuple, list[float]]
    parents: tuple[str, ...]

    def value(self, values: dict[str, Column], noise: Column) -> Column:
        out = F.lit(None)
        for key, p in self.table.items():
            here = F.lit(True)
            for n, v in zip(self.parents, key):
                here = here & (values[n] == F.lit(v))
            total, pick = 0.0, None
            for level, q in zip(self.levels, p):
                total += q
                pick = F.when(noise < total, F.lit(level)) if pick is None else pick.when(noise < total, F.lit(level))
            out = F.when(here, pick.otherwise(F.lit(self.levels[-1]))).otherwise(out)
        return out


@dataclass
class Model:
    graph: Dag
    mechanisms: dict[str, Linear | Discrete] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, graph: Dag, discrete: Sequence[str] = (), most_cells: int = 10_000) -> Model:
        """All linear mechanisms from one Gram; discrete ones from their conditional tables."""
        smooth = [n for n in graph.nodes if n not in discrete]
        model = cls(graph)
        g = gram(df, graph.nodes if not discrete else smooth) if smooth else None
        for n in smooth:
            parents = sorted(graph.parents[n])
            if set(parents) & set(discrete):
                raise Unsupported(f"{n} mixes discrete parents with a linear mechanism")
            fit = solve(g, n, ["1", *parents])
            model.mechanisms[n] = Linear(fit["1"], {p: fit[p] for p in parents}, math.sqrt(fit.rss / fit.n))
        for n in discrete:
            parents = tuple(sorted(graph.parents[n]))
            rows = cpt(df, [n], parents).limit(most_cells + 1).collect()
            if len(rows) > most_cells:
                raise EstimationError(f"{n} has more than {most_cells} cells")
            levels = sorted({r[n] for r in rows})
            table: dict[tuple, list[float]] = {}
            for r in rows:
                table.setdefault(tuple(r[p] for p in parents), [0.0] * len(levels))[levels.index(r[n])] = r["p"]
            model.mechanisms[n] = Discrete(levels, table, parents)
        return model

    def _noise(self, n: str, seed: int, *keys) -> Column:
        return (uniform if isinstance(self.mechanisms[n], Discrete) else normal)(seed, n, *keys)

    def sample(self, spark: SparkSession, count: int, do: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
        """Ancestral sample, observational or under interventions; noise does not depend on these."""
        out = spark.range(count).withColumnRenamed("id", "row")
        for n in self.graph.order():
            values = {p: F.col(p) for p in self.graph.parents[n]}
            v = F.lit(do[n]) if do and n in do else self.mechanisms[n].value(values, self._noise(n, seed, "row"))
            out = out.withColumn(n, v)
        return out

    def abduct(self, df: DataFrame) -> DataFrame:
        """Rows with the noise of each linear node."""
        for n in self.graph.order():
            m = self.mechanisms[n]
            if isinstance(m, Discrete):
                raise Unsupported("noise of a discrete mechanism is not unique")
            df = df.withColumn(f"eps_{n}", m.noise({p: F.col(p) for p in self.graph.parents[n]}, F.col(n)))
        return df

    def counterfactual(self, df: DataFrame, worlds: Sequence[dict[str, float]]) -> DataFrame:
        """Each row in each world: noise abducted, interventions set, nodes predicted; columns ``cf_*`` and ``world``.

        Worlds are few and given by the caller, so they multiply rows in one pass.
        """
        df = self.abduct(df).withColumn("world", F.explode(F.sequence(F.lit(0), F.lit(len(worlds) - 1))))
        for n in self.graph.order():
            values = {p: F.col(f"cf_{p}") for p in self.graph.parents[n]}
            v = self.mechanisms[n].value(values, F.col(f"eps_{n}"))
            for i, w in enumerate(worlds):
                if n in w:
                    v = F.when(F.col("world") == i, F.lit(float(w[n]))).otherwise(v)
            df = df.withColumn(f"cf_{n}", v)
        return df

    def nested(self, df: DataFrame, t: str, y: str, mediators: Sequence[str], active: float, control: float) -> DataFrame:
        """Y with the treatment active but mediators as under control, noise shared (a natural direct effect)."""
        low = self.counterfactual(df, [{t: control}])
        keep = low.select(*df.columns, *[F.col(f"cf_{m}").alias(f"__{m}") for m in mediators], F.col(f"cf_{y}").alias("y_control"), *[f"eps_{n}" for n in self.graph.nodes])
        for n in self.graph.order():
            if n == t:
                v = F.lit(active)
            elif n in mediators:
                v = F.col(f"__{n}")
            else:
                v = self.mechanisms[n].value({p: F.col(f"cf_{p}") for p in self.graph.parents[n]}, F.col(f"eps_{n}"))
            keep = keep.withColumn(f"cf_{n}", v)
        return keep.withColumn("direct_effect", F.col(f"cf_{y}") - F.col("y_control"))

    def log_density(self, df: DataFrame) -> Column:
        parts = [self.mechanisms[n].log_density({p: F.col(p) for p in self.graph.parents[n]}, F.col(n)) for n in self.graph.nodes]
        return sum(parts[1:], parts[0])

    def moments(self, do: dict[str, float] | None = None) -> tuple[dict[str, float], dict[tuple[str, str], float]]:
        """Closed-form means and covariances of a linear model, under interventions too."""
        mean: dict[str, float] = {}
        load: dict[str, dict[str, float]] = {}
        for n in self.graph.order():
            if do and n in do:
                mean[n], load[n] = do[n], {}
                continue
            m = self.mechanisms[n]
            mean[n] = m.intercept + sum(b * mean[p] for p, b in m.coefficients.items())
            load[n] = {n: m.sd}
            for p, b in m.coefficients.items():
                for k, v in load[p].items():
                    load[n][k] = load[n].get(k, 0.0) + b * v
        cov = {(a, b): sum(v * load[b].get(k, 0.0) for k, v in load[a].items()) for a in load for b in load}
        return mean, cov

    def total_effect(self, t: str, y: str) -> float:
        return self.moments({t: 1.0})[0][y] - self.moments({t: 0.0})[0][y]

    def path_shares(self, t: str, y: str) -> dict[tuple[str, ...], float]:
        """The effect along each directed path: products of coefficients."""
        paths, capped = self.graph.directed_paths(t, y)
        if capped:
            raise Unsupported("too many paths")
        return {p: math.prod(self.mechanisms[b].coefficients[a] for a, b in zip(p, p[1:])) for p in paths}


def trajectory(df: DataFrame, unit: str, steps: int, coefficient: float, drift: float, schedule: dict[int, float], start: str) -> DataFrame:
    """x' = drift + coefficient * x per unit, scheduled values set: a recursion folded inside each row."""
    def step(acc: Column, k: Column) -> Column:
        v = F.lit(drift) + F.lit(coefficient) * F.element_at(acc, -1)
        for at, value in schedule.items():
            v = F.when(k == at, F.lit(float(value))).otherwise(v)
        return F.concat(acc, F.array(v))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(F.col(start).cast("double")), step)
    return df.select(unit, F.posexplode(path).alias("step", "value"))
