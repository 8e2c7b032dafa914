"""Typed options: discovery procedures that run and are accepted, and estimators that are passed to ``api.estimate``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields
from typing import ClassVar

from pyspark.sql import DataFrame

from causelake import api
from causelake.errors import EstimationError, ReviewRequired, Unsupported
from causelake.graphs.dag import Dag, Mixed
from causelake.operators import ci
from causelake.operators import discovery as dis
from causelake.operators.reduce import gram
from causelake.schema import complete_cases

# --- discovery


@dataclass
class Found:
    """What a procedure found; a person accepts it, settling what it left open, before it identifies anything."""

    algorithm: str
    graph: Mixed
    links: tuple = ()

    @property
    def pending(self) -> list[tuple[str, str, str]]:
        return [e for e in self.graph.edges() if e[1] not in ("-->", "<--")]

    def accept(self, orient: Sequence[tuple[str, str]] = (), remove: Sequence[tuple[str, str]] = ()) -> Dag:
        """The DAG after the given orientations and removals; edges still open are refused by name."""
        g = self.graph.copy()
        for a, b in (*orient, *remove):
            if not g.adjacent(a, b):
                raise EstimationError(f"there is no edge between {a} and {b}")
        for a, b in remove:
            g.remove(a, b)
        for a, b in orient:
            g.orient(a, b)
        left = Found(self.algorithm, g).pending
        if left:
            raise ReviewRequired(left)
        return Dag(g.nodes, [(a, b) for a in g.nodes for b in g.nodes if g.directed(a, b)])


def _test(df: DataFrame, names: Sequence[str], test: str):
    return ci.named_test(df, test, list(names))


@dataclass(frozen=True)
class PC:
    alpha: float = 0.05
    test: str = "parcorr"
    most_given: int = 3

    def run(self, df: DataFrame, names: Sequence[str], known: dis.Constraints | None = None) -> Found:
        return Found("pc", dis.pc(list(names), _test(df, names, self.test), self.alpha, self.most_given, known))


@dataclass(frozen=True)
class FCI:
    alpha: float = 0.05
    test: str = "parcorr"
    most_given: int = 3
    possible_dsep: bool = True

    def run(self, df: DataFrame, names: Sequence[str]) -> Found:
        return Found("fci" if self.possible_dsep else "rfci", dis.fci(list(names), _test(df, names, self.test), self.alpha, self.most_given, self.possible_dsep))


def RFCI(alpha: float = 0.05, test: str = "parcorr", most_given: int = 3) -> FCI:
    return FCI(alpha, test, most_given, False)


@dataclass(frozen=True)
class GES:
    most_parents: int = 6

    def run(self, df: DataFrame, names: Sequence[str], known: dis.Constraints | None = None) -> Found:
        return Found("ges", dis.ges(dis.GaussianScore(gram(complete_cases(df, names), list(names))), known, self.most_parents))


@dataclass(frozen=True)
class NOTEARS:
    penalty: float = 0.05
    threshold: float = 0.3
    rounds: int = 30

    def run(self, df: DataFrame, names: Sequence[str]) -> Found:
        return _weighted("notears", names, dis.notears(gram(complete_cases(df, names), list(names)), self.penalty, self.threshold, self.rounds))


@dataclass(frozen=True)
class DirectLiNGAM:
    key: str
    threshold: float = 0.05

    def run(self, df: DataFrame, names: Sequence[str]) -> Found:
        return _weighted("direct_lingam", names, dis.direct_lingam(df, list(names), self.key, self.threshold)[1])


def _weighted(algorithm: str, names: Sequence[str], weights: dict[tuple[str, str], float]) -> Found:
    g = Mixed(names)
    for a, b in weights:
        g.orient(a, b)
    return Found(algorithm, g, tuple(sorted(weights.items())))


@dataclass(frozen=True)
class PCMCI:
    max_lag: int
    time: str
    by: tuple[str, ...] = ()
    alpha: float = 0.05
    fdr: bool = False
    contemporaneous: bool = False

    def run(self, df: DataFrame, names: Sequence[str]) -> Found:
        links, now = dis.pcmci(df, list(names), self.max_lag, self.time, list(self.by), self.alpha, self.fdr, self.contemporaneous)
        return Found("pcmci+" if self.contemporaneous else "pcmci", now if now is not None else Mixed(names), tuple(links))


@dataclass(frozen=True)
class ScreenedPosterior:
    """Edge probabilities over the DAGs inside a skeleton that independence tests leave (few nodes: at most ``most`` graphs)."""

    alpha: float = 0.2
    test: str = "parcorr"
    edge_prior: float = 0.5
    most: int = 200_000

    def run(self, df: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], float]:
        names = list(names)
        rows = complete_cases(df, names)
        g = gram(rows, names)
        test = ci.Covariance(g).test if self.test == "parcorr" else _test(df, names, self.test)
        left, _ = dis.skeleton(names, test, self.alpha)
        return dis.screened_posterior(dis.GaussianScore(g), left, self.edge_prior, self.most)


# --- estimators


class _Estimator:
    name: ClassVar[str]

    def options(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None} if fields(self) else {}

    def fit(self, df: DataFrame, query, estimand, key: str | None = None) -> DataFrame:
        """The estimate by this estimator with these options; refused where the support table does not license it."""
        verdict = api.supported(estimand.strategy, self.name, getattr(query, "target", "ate"))
        if verdict != "licensed":
            raise Unsupported(verdict)
        return api.estimate(df, query, estimand, self.name, key, **self.options())


@dataclass(frozen=True)
class LinearAdjustment(_Estimator):
    name: ClassVar[str] = "linear.adjustment.ate"
    se: str = "homoskedastic"
    ridge: float = 0.0
    clusters: tuple[str, ...] = ()


@dataclass(frozen=True)
class GlmAdjustment(_Estimator):
    name: ClassVar[str] = "glm.adjustment"
    family: str = "logit"


@dataclass(frozen=True)
class Weighting(_Estimator):
    name: ClassVar[str] = "propensity.weighting"


@dataclass(frozen=True)
class Aipw(_Estimator):
    name: ClassVar[str] = "aipw"


@dataclass(frozen=True)
class Stratification(_Estimator):
    name: ClassVar[str] = "propensity.stratification"
    strata: int = 5


@dataclass(frozen=True)
class PropensityMatching(_Estimator):
    name: ClassVar[str] = "propensity.matching"


@dataclass(frozen=True)
class DistanceMatching(_Estimator):
    name: ClassVar[str] = "distance.matching"


@dataclass(frozen=True)
class FrontDoor(_Estimator):
    name: ClassVar[str] = "frontdoor.two_stage"


@dataclass(frozen=True)
class TwoStage(_Estimator):
    name: ClassVar[str] = "iv.2sls"


@dataclass(frozen=True)
class Wald(_Estimator):
    name: ClassVar[str] = "iv.wald"


@dataclass(frozen=True)
class SharpDiscontinuity(_Estimator):
    name: ClassVar[str] = "rd.sharp"


@dataclass(frozen=True)
class Functional(_Estimator):
    name: ClassVar[str] = "functional.effect"
