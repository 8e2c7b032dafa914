"""The verbs: analyze in one call, or identify, estimate and validate in stages.

Identification always comes first and decides the adjustment; an estimator never picks confounders.
What the support table does not list is refused before any row is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causelake.errors import ReviewRequired, Unsupported
from causelake.graphs.dag import Admg, Dag, Mixed
from causelake.operators import estimate as est
from causelake.operators import validate as val
from causelake.plans import expr
from causelake.plans import identify as idf
from causelake.plans.identify import Estimand
from causelake.schema import complete_cases


@dataclass(frozen=True)
class AverageEffect:
    treatment: str
    outcome: str
    active: float = 1.0
    control: float = 0.0
    target: str = "ate"


@dataclass(frozen=True)
class ConditionalEffect:
    treatment: str
    outcome: str
    modifier: str
    active: float = 1.0
    control: float = 0.0


@dataclass(frozen=True)
class InterventionalDistribution:
    treatment: str
    outcome: str
    level: object = 1.0
    given: tuple[str, ...] = ()


@dataclass(frozen=True)
class PathSpecificEffect:
    treatment: str
    outcome: str
    through: tuple[tuple[str, ...], ...]
    active: float = 1.0
    control: float = 0.0


@dataclass(frozen=True)
class ResponseCurve:
    treatment: str
    outcome: str
    grid: tuple[float, ...]
    key: str = "id"


@dataclass(frozen=True)
class DiscontinuityEffect:
    running: str
    outcome: str
    cutoff: float
    bandwidth: float


@dataclass(frozen=True)
class PulseEffect:
    """One step's treatment, ``lag`` steps before the outcome."""

    treatment: str
    outcome: str
    lag: int
    time: str
    by: tuple[str, ...] = ()
    adjust: tuple[tuple[str, int], ...] = ()
    active: float = 1.0
    control: float = 0.0


@dataclass(frozen=True)
class SustainedEffect:
    """The treatment held over several steps before the outcome."""

    treatment: str
    outcome: str
    lags: tuple[int, ...]
    time: str
    by: tuple[str, ...] = ()
    active: float = 1.0
    control: float = 0.0


@dataclass(frozen=True)
class MediationEffect:
    treatment: str
    outcome: str
    mediators: tuple[str, ...]
    active: float = 1.0
    control: float = 0.0


@dataclass(frozen=True)
class Counterfactual:
    """Each row's outcome had some nodes been at other values: ``do`` has (node, value)."""

    outcome: str
    do: tuple[tuple[str, float], ...]


@dataclass(frozen=True)
class TemporalMediationEffect:
    treatment: str
    outcome: str
    template: tuple[tuple[str, int, str], ...]
    horizon: int
    time: str
    by: tuple[str, ...] = ()
    active: float = 1.0
    control: float = 0.0


@dataclass(frozen=True)
class AverageDerivative:
    treatment: str
    outcome: str


@dataclass(frozen=True)
class PointDerivative:
    treatment: str
    outcome: str
    dose: float
    degree: int = 2


@dataclass(frozen=True)
class Elasticity(PointDerivative):
    """d ln y / d ln t of the mean response at a dose."""


@dataclass(frozen=True)
class SemiElasticity(PointDerivative):
    """d ln y / dt of the mean response at a dose."""


@dataclass(frozen=True)
class DirectionalDerivative:
    """The slope of the joint response along (treatment, weight, dose) entries."""

    outcome: str
    direction: tuple[tuple[str, float, float], ...]
    degree: int = 2


@dataclass(frozen=True)
class ResponseJacobian:
    """Slopes of each outcome's mean response in each treatment, at the treatments' means or given (treatment, dose)."""

    treatments: tuple[str, ...]
    outcomes: tuple[str, ...]
    doses: tuple[tuple[str, float], ...] = ()
    degree: int = 2


@dataclass(frozen=True)
class InterventionResponse:
    """Mean outcomes under named policies: (name, kind, value) as in ``intervention_response``."""

    treatment: str
    outcome: str
    policies: tuple[tuple[str, str, object], ...]
    key: str = "id"


#: Estimators each identification strategy licenses; the first is the default.
SUPPORT: dict[str, tuple[str, ...]] = {
    "backdoor.adjustment": ("linear.adjustment.ate", "glm.adjustment", "propensity.weighting", "propensity.stratification", "propensity.matching", "distance.matching", "aipw", "functional.effect"),
    "backdoor.efficient": ("linear.adjustment.ate", "aipw", "propensity.weighting"),
    "frontdoor": ("frontdoor.two_stage", "functional.effect"),
    "iv": ("iv.2sls", "iv.wald"),
    "rd.sharp": ("rd.sharp",),
    "id": ("functional.effect",),
    "path_specific": ("functional.effect",),
}
#: Replicates by latency tier.
TIERS = {"interactive": 0, "standard": 50, "report": 200}


def supported(strategy: str, estimator: str, target: str = "ate") -> str:
    """licensed, or refused with the reason."""
    if strategy not in SUPPORT or estimator not in SUPPORT[strategy]:
        return f"refused: {strategy} with {estimator}"
    if estimator == "linear.adjustment.ate" and target != "ate":
        return "refused: linear adjustment has one effect for all rows"
    return "licensed"


@dataclass
class Result:
    """Estimates with how they were identified and what the validators said."""

    estimand: Estimand
    estimator: str
    estimate: DataFrame
    validation: DataFrame | None = None

    def describe(self) -> str:
        text = f"{self.estimand.strategy} with {self.estimator}; adjusted for {list(self.estimand.adjustment)}"
        return text + (f"; {expr.text(self.estimand.functional)}" if self.estimand.functional is not None else "")


def identify(graph: Admg | Mixed, query, strategy: str | None = None, observed: Sequence[str] | None = None) -> Estimand:
    """The estimand of a query; a structure with open edges goes to review first."""
    if isinstance(graph, Mixed):
        graph = idf.require_reviewed(graph)
    if isinstance(query, DiscontinuityEffect):
        return idf.regression_discontinuity(query.running, query.outcome, query.running, query.cutoff, query.bandwidth)
    t, y = query.treatment, query.outcome
    if isinstance(query, PathSpecificEffect):
        if not isinstance(graph, Dag):
            raise Unsupported("path-specific effects need a DAG")
        return idf.path_specific(graph, t, y, query.through)
    if isinstance(query, InterventionalDistribution):
        e = idf.identify_conditional(graph, [y], [t], query.given)
        return Estimand("id", (t,), y, tuple(query.given), functional=e)
    by_name = {"backdoor.adjustment": idf.backdoor, "frontdoor": idf.frontdoor, "iv": idf.instrument}
    if strategy == "backdoor.efficient":
        return idf.efficient_backdoor(graph, t, y)
    if strategy == "id":
        return Estimand("id", (t,), y, functional=idf.identify_do(graph, [y], [t]))
    if strategy:
        if strategy not in by_name:
            raise Unsupported(f"no strategy {strategy!r}")
        return by_name[strategy](graph, t, y, observed)
    return idf.backdoor(graph, t, y, observed)


def estimate(df: DataFrame, query, estimand: Estimand, estimator: str | None = None, key: str | None = None, **options) -> DataFrame:
    """The estimate as one row (or one row a dose)."""
    name = estimator or SUPPORT[estimand.strategy][0]
    target = getattr(query, "target", "ate")
    verdict = supported(estimand.strategy, name, target)
    if verdict != "licensed":
        raise Unsupported(verdict)
    z, y = list(estimand.adjustment), estimand.outcome
    if isinstance(query, DiscontinuityEffect):
        return est.sharp_rd(df, query.running, y, query.cutoff, query.bandwidth)
    t = estimand.treatment[0]
    if isinstance(query, ResponseCurve):
        return est.local_polynomial(est.pseudo_outcome(df, t, y, z, query.key), t, "pseudo", query.grid)
    if isinstance(query, ConditionalEffect):
        return est.conditional_effect(df, t, y, query.modifier, [c for c in z if c != query.modifier], query.active - query.control)
    if isinstance(query, InterventionalDistribution):
        x, _ = expr.compile_frame(estimand.functional, df)
        return x.where(F.col(t) == F.lit(query.level)) if t in x.columns else x
    delta = query.active - query.control
    if name == "linear.adjustment.ate":
        return est.linear_adjustment(df, t, y, z, delta, **options)
    if name == "glm.adjustment":
        return est.glm_adjustment(df, t, y, z, query.active, query.control, **options)
    if isinstance(query, PathSpecificEffect):
        return expr.path_contrast(estimand.functional, df, y, t, estimand.mediators, query.active, query.control)
    if name == "functional.effect":
        return expr.contrast(estimand.functional, df, y, t, query.active, query.control, strict=True)
    if name == "frontdoor.two_stage":
        return est.frontdoor_effect(df, t, list(estimand.mediators), y, delta)
    if name == "iv.2sls":
        return est.two_stage(df, list(estimand.instruments), t, y, z)
    if name == "iv.wald":
        return est.wald_iv(df, estimand.instruments[0], t, y, delta)
    rows = complete_cases(df, [t, y, *z], [key] if key else [])
    if name == "distance.matching":
        return est.match_effect(est.distance_match(rows, t, y, z, key))
    rows = est.propensity(rows, t, z)
    if name == "propensity.weighting":
        return est.ipw_se(rows, t, y, z, target=target)
    if name == "aipw":
        return est.aipw(est.arm_regressions(rows, t, y, z), t, y, target=target)
    if key is None:
        raise Unsupported("strata and matches need a row key for a stable order")
    if name == "propensity.stratification":
        return est.stratified_effect(est.stratify(rows, "e", options.get("strata", 5), [key]), t, y, target=target)
    return est.matched_error(est.nearest_match(rows, t, y, "e", key), rows, t, y, "e", key)


def validate(df: DataFrame, estimand: Estimand, key: str, tier: str = "standard") -> DataFrame:
    if estimand.strategy not in ("backdoor.adjustment", "backdoor.efficient"):
        raise Unsupported(f"no validators for {estimand.strategy}")
    return val.suite(df, estimand.treatment[0], estimand.outcome, list(estimand.adjustment), key, max(2, TIERS[tier]))


def analyze(df: DataFrame, graph, query, strategy: str | None = None, estimator: str | None = None, key: str | None = None, tier: str = "interactive", **options) -> Result:
    """Identify, estimate and (beyond the interactive tier) validate."""
    e = identify(graph, query, strategy)
    name = estimator or SUPPORT[e.strategy][0]
    checks = validate(df, e, key, tier) if TIERS[tier] and key else None
    return Result(e, name, estimate(df, query, e, name, key, **options), checks)


def _joint_adjustment(graph: Admg, treatments: Sequence[str], y: str) -> list[str]:
    """The treatments' other parents, an adjustment set of the joint intervention if none of them follows a treatment and nothing hidden touches one."""
    parents = sorted({p for t in treatments for p in graph.parents[t]} - set(treatments))
    after = graph.descendants(list(treatments)) - set(treatments)
    if y in parents or set(parents) & after or any(graph.siblings[t] for t in treatments):
        raise Unsupported("the treatments' parents are no adjustment set of setting them together")
    return parents


def answer(df: DataFrame, graph: Admg | Mixed | None, query) -> DataFrame:
    """The answer to a query whose estimate needs no choice of estimator; the graph decides the adjustment first.

    Temporal queries carry their own template or lags and need no graph.
    """
    from causelake.operators import response as rs
    from causelake.operators import series as ser
    from causelake.operators.scm import Model

    if isinstance(graph, Mixed):
        graph = idf.require_reviewed(graph)
    delta = getattr(query, "active", 1.0) - getattr(query, "control", 0.0)
    if isinstance(query, PulseEffect):
        return ser.temporal_adjustment(df, query.treatment, query.outcome, query.time, query.lag, list(query.adjust), list(query.by), delta)
    if isinstance(query, SustainedEffect):
        template = [(query.treatment, k, query.outcome) for k in query.lags]
        b = ser.lagged_model(df, template, query.time, list(query.by))
        return df.sparkSession.createDataFrame([(float(delta * sum(b[s] for s in template)), len(template))], "effect double, steps long")
    if isinstance(query, TemporalMediationEffect):
        return ser.temporal_mediation_effect(df, list(query.template), query.treatment, query.outcome, query.horizon, query.time, list(query.by), delta)
    if graph is None:
        raise Unsupported(f"{type(query).__name__} needs a graph")
    if isinstance(query, (MediationEffect, Counterfactual)):
        if not isinstance(graph, Dag):
            raise Unsupported("this needs a graph without hidden causes")
        model = Model.fit(df, graph)
        if isinstance(query, Counterfactual):
            return model.counterfactual(df, [dict(query.do)]).select(*df.columns, F.col(f"cf_{query.outcome}").alias("counterfactual"))
        shares = model.path_shares(query.treatment, query.outcome)
        through = sum(v for path, v in shares.items() if set(path) & set(query.mediators))
        return df.sparkSession.createDataFrame([(delta * sum(shares.values()), delta * (sum(shares.values()) - through), delta * through)], "total double, direct double, mediated double")
    if isinstance(query, ResponseJacobian):
        # each entry is the response to one treatment alone, adjusted by its own back-door set
        entries = [(y, t) for y in query.outcomes for t in query.treatments]
        parts = [rs.derivatives(df, y, [t], list(idf.backdoor(graph, t, y).adjustment), dict(query.doses), query.degree).select(F.lit(y).alias("outcome"), "treatment", "dose", "derivative") for y, t in entries]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    if isinstance(query, DirectionalDerivative):
        names = [t for t, _, _ in query.direction]
        d = rs.derivatives(df, query.outcome, names, _joint_adjustment(graph, names, query.outcome), {t: a for t, _, a in query.direction}, query.degree)
        weight = F.create_map(*[F.lit(v) for t, w, _ in query.direction for v in (t, float(w))])
        return d.agg(F.sum(F.col("derivative") * F.element_at(weight, F.col("treatment"))).alias("derivative"))
    t, y = query.treatment, query.outcome
    z = list(idf.backdoor(graph, t, y).adjustment)
    if isinstance(query, AverageDerivative):
        return est.average_derivative(df, t, y, z)
    if isinstance(query, PointDerivative):
        column = {Elasticity: "elasticity", SemiElasticity: "semi_elasticity"}.get(type(query), "derivative")
        return rs.derivatives(df, y, [t], z, {t: query.dose}, query.degree).select("dose", F.col(column).alias("effect"))
    if isinstance(query, InterventionResponse):
        return rs.intervention_response(df, t, y, z, {name: (kind, value) for name, kind, value in query.policies}, query.key)
    raise Unsupported(f"no direct answer for {type(query).__name__}; use analyze")


@dataclass
class Prepared:
    """Identified once; the used columns are cached and serve many estimates, refreshes and refutations."""

    graph: Admg
    query: object
    data: DataFrame
    key: str | None = None
    estimand: Estimand = field(init=False)

    def __post_init__(self):
        self.estimand = identify(self.graph, self.query)
        self._project(self.data)

    def _project(self, df: DataFrame) -> None:
        e = self.estimand
        used = [*e.treatment, e.outcome, *e.adjustment, *e.mediators, *e.instruments, *([self.key] if self.key else [])]
        self.data = df.select(*dict.fromkeys(used)).persist()

    def estimate(self, estimator: str | None = None, **options) -> DataFrame:
        return estimate(self.data, self.query, self.estimand, estimator, self.key, **options)

    def refresh(self, df: DataFrame) -> DataFrame:
        self.data.unpersist()
        self._project(df)
        return self.estimate()

    def refute(self, tier: str = "standard") -> DataFrame:
        return validate(self.data, self.estimand, self.key, tier)


def many(df: DataFrame, graph: Admg, queries: Sequence[AverageEffect]) -> DataFrame:
    """Average effects of many queries from one Gram over the union of their columns."""
    from causelake.operators.reduce import gram, solve

    found = [(q, identify(graph, q)) for q in queries]
    columns = list(dict.fromkeys(c for q, e in found for c in (q.treatment, q.outcome, *e.adjustment)))
    g = gram(complete_cases(df, columns), columns)
    rows = []
    for q, e in found:
        fit = solve(g, q.outcome, ["1", q.treatment, *e.adjustment])
        d = q.active - q.control
        rows.append((q.treatment, q.outcome, fit[q.treatment] * d, fit.se(q.treatment) * abs(d), ",".join(e.adjustment)))
    return df.sparkSession.createDataFrame(rows, "treatment string, outcome string, effect double, se double, adjustment string")


__all__ = [
    "AverageDerivative", "AverageEffect", "ConditionalEffect", "Counterfactual", "DirectionalDerivative", "DiscontinuityEffect", "Elasticity", "InterventionResponse", "InterventionalDistribution", "MediationEffect",
    "PathSpecificEffect", "PointDerivative", "Prepared", "PulseEffect", "ResponseCurve", "ResponseJacobian", "Result", "ReviewRequired", "SemiElasticity", "SustainedEffect", "TemporalMediationEffect", "analyze",
    "answer", "estimate", "identify", "many", "supported", "validate",
]
