"""Identification: graph and query in, a functional or a design out, before any row is read."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from causelake.errors import NotIdentified, ReviewRequired, Unsupported
from causelake.graphs.dag import Admg, Dag, Mixed, subsets, unfold
from causelake.plans.expr import P, Product, Ratio, SumOut, simplify


@dataclass(frozen=True)
class Estimand:
    """What identification decided."""

    strategy: str
    treatment: tuple[str, ...]
    outcome: str
    adjustment: tuple[str, ...] = ()
    mediators: tuple[str, ...] = ()
    instruments: tuple[str, ...] = ()
    functional: object = None
    notes: tuple[str, ...] = ()


def is_backdoor_set(g: Admg, t: str, y: str, z: Iterable[str]) -> bool:
    z = set(z)
    if z & g.descendants([t]) or y in z:
        return False
    return g.copy(without_out_of=[t]).separated([t], [y], z)


def backdoor_sets(g: Admg, t: str, y: str, observed: Iterable[str] | None = None, most: int = 1000) -> tuple[list[tuple[str, ...]], bool]:
    """(minimal adjustment sets by growing size, whether the budget ran out)."""
    pool = [n for n in (observed or g.nodes) if n not in (t, y) and n not in g.descendants([t])]
    # only ancestors of the pair can matter for a minimal set
    near = g.ancestors([t, y])
    pool = [n for n in pool if n in near]
    found: list[tuple[str, ...]] = []
    for tried, z in enumerate(subsets(pool)):
        if tried >= 200_000 or len(found) >= most:
            return found, True
        if any(set(f) <= set(z) for f in found):
            continue
        if is_backdoor_set(g, t, y, z):
            found.append(z)
    return found, False


def backdoor(g: Admg, t: str, y: str, observed: Iterable[str] | None = None) -> Estimand:
    sets, capped = backdoor_sets(g, t, y, observed, most=1)
    if not sets:
        raise NotIdentified(f"no adjustment set for {t} -> {y}{' within the budget' if capped else ''}")
    z = sets[0]
    return Estimand("backdoor.adjustment", (t,), y, z, functional=adjustment_functional(t, y, z))


def adjustment_functional(t: str, y: str, z: Iterable[str]):
    z = tuple(sorted(z))
    e = P((y,), tuple(sorted({t, *z})))
    return SumOut(z, Product((e, P(z)))) if z else e


def efficient_backdoor(g: Dag, t: str, y: str) -> Estimand:
    """The optimal set: parents of the causal nodes that are not forbidden; a minimal set where that one is invalid."""
    causal = (g.descendants([t]) & g.ancestors([y])) - {t}
    if y not in causal:
        return backdoor(g, t, y)
    forbidden = set().union(*(g.descendants([c]) for c in causal)) | {t}
    z = tuple(sorted(set().union(*(g.parents[c] for c in causal)) - forbidden))
    if not is_backdoor_set(g, t, y, z):
        return backdoor(g, t, y)
    return Estimand("backdoor.efficient", (t,), y, z, functional=adjustment_functional(t, y, z))


def frontdoor(g: Admg, t: str, y: str, observed: Iterable[str] | None = None) -> Estimand:
    """Mediators that cut all directed paths, without back door from the treatment, and with theirs closed by it."""
    pool = [n for n in (observed or g.nodes) if n in (g.descendants([t]) & g.ancestors([y])) - {t, y}]
    for m in subsets(pool):
        if not m:
            continue
        cut = g.copy(keep=set(g.nodes) - set(m))
        if y in cut.descendants([t]):
            continue
        if not g.copy(without_out_of=[t]).separated([t], m):
            continue
        if all(g.copy(without_out_of=m).separated([x], [y], {t} | (set(m) - {x})) for x in m):
            m = tuple(sorted(m))
            e = SumOut(m, Product((P(m, (t,)), SumOut(("__t",), Product((P((y,), (*m, "__t")), P(("__t",))))))))
            return Estimand("frontdoor", (t,), y, mediators=m, functional=e)
    raise NotIdentified(f"no front-door set for {t} -> {y}")


def instrument(g: Admg, t: str, y: str, observed: Iterable[str] | None = None) -> Estimand:
    """Variables that reach the treatment and, once its effect is removed, are separated from the outcome."""
    cut = g.copy(without_out_of=[t])
    out = [
        z
        for z in (observed or g.nodes)
        if z not in (t, y) and z not in g.descendants([t]) and not g.separated([z], [t]) and cut.separated([z], [y])
    ]
    if not out:
        raise NotIdentified(f"no instrument for {t} -> {y}")
    return Estimand("iv", (t,), y, instruments=tuple(out))


def regression_discontinuity(t: str, y: str, running: str, cutoff: float, bandwidth: float) -> Estimand:
    """Records the design's assumptions; it rests on them and not on the graph."""
    notes = (f"T = 1{{{running} >= {cutoff}}}", f"continuity of the outcome's means at {cutoff}", f"bandwidth {bandwidth}, uniform kernel")
    return Estimand("rd.sharp", (t,), y, notes=notes)


def identify_do(g: Admg, y: Iterable[str], x: Iterable[str]):
    """P(y | do(x)) by the complete ID recursion; a hedge raises."""
    order = g.order()
    whole = P(tuple(order))
    return simplify(_id(frozenset(y), frozenset(x), whole, g, order))


def _conditional(p, v: str, before: list[str], variables: set[str]):
    """P(v | before) inside the distribution ``p`` over ``variables``."""
    if isinstance(p, P) and not p.given:
        return P((v,), tuple(b for b in before if b in variables))
    keep = {v, *before} & variables
    over = SumOut(tuple(sorted(variables - keep)), p)
    return Ratio(over, SumOut(tuple(sorted(variables - keep | {v})), p))


def _id(y: frozenset, x: frozenset, p, g: Admg, order: list[str]):
    v = set(g.nodes)
    if not x:
        return SumOut(tuple(sorted(v - y)), p)
    above = g.ancestors(y)
    if v - above:
        return _id(y, x & above, SumOut(tuple(sorted(v - above)), p) if not isinstance(p, P) else P(tuple(n for n in order if n in above)), g.copy(keep=above), order)
    free_of_x = g.copy(without_into=x)
    w = v - x - free_of_x.ancestors(y)
    if w:
        return _id(y, x | w, p, g, order)
    parts = g.copy(keep=v - x).districts()
    if len(parts) > 1:
        factors = tuple(_id(frozenset(s), frozenset(v - s), p, g, order) for s in parts)
        return SumOut(tuple(sorted(v - y - x)), Product(factors))
    s = parts[0]
    districts = g.districts()
    if len(districts) == 1:
        raise NotIdentified(f"hedge: districts {sorted(v)} and {sorted(s)}")
    local = [n for n in order if n in v]
    own = next(d for d in districts if s <= d)
    if own == s:
        factors = tuple(_conditional(p, n, local[: local.index(n)], v) for n in sorted(s, key=local.index))
        return SumOut(tuple(sorted(s - y)), Product(factors))
    factors = tuple(_conditional(p, n, local[: local.index(n)], v) for n in sorted(own, key=local.index))
    return _id(y, x & own, Product(factors), g.copy(keep=own), order)


def identify_conditional(g: Admg, y: Iterable[str], x: Iterable[str], z: Iterable[str]):
    """P(y | do(x), z) by IDC."""
    y, x, z = set(y), set(x), set(z)
    for n in sorted(z):
        cut = g.copy(without_into=x, without_out_of={n})
        if cut.separated(y, {n}, x | (z - {n})):
            return identify_conditional(g, y, x | {n}, z - {n})
    joint = identify_do(g, y | z, x)
    return simplify(Ratio(joint, SumOut(tuple(sorted(y)), joint))) if z else joint


def path_specific(g: Dag, t: str, y: str, through: Iterable[tuple[str, ...]]) -> Estimand:
    """The effect along a set of directed paths (an edge out of the treatment stands for all paths over it).

    Identified when for each child of the treatment all paths over it are chosen or none is; a child
    with both is a recanting witness.  ``mediators`` are the children that see the active level.
    """
    chosen = [tuple(p) for p in through]
    paths, capped = g.directed_paths(t, y)
    if capped:
        raise NotIdentified("too many directed paths")
    starts: dict[str, set[bool]] = {}
    for p in paths:
        starts.setdefault(p[1], set()).add(p in chosen or p[:2] in chosen)
    unknown = [c for c in chosen if c not in paths and not (len(c) == 2 and c[0] == t and c[1] in starts)]
    if unknown:
        raise NotIdentified(f"no directed path {unknown[0]}")
    for child, held in starts.items():
        if len(held) > 1:
            raise NotIdentified(f"recanting witness {child}")
    active = tuple(sorted(c for c, held in starts.items() if True in held))
    above = g.ancestors([y])
    factors = tuple(P((n,), tuple(sorted(g.parents[n]))) for n in g.order() if n in above and n != t)
    rest = tuple(sorted(above - {t, y}))
    return Estimand("path_specific", (t,), y, mediators=active, functional=SumOut(rest, Product(factors)), notes=(f"active through {list(active)}",))


def generalised_adjustment(g: Mixed, t: str, y: str, most: int = 1000) -> list[tuple[float, Estimand | None]]:
    """(share, estimand or none) over the DAGs of a class: unidentified mass is kept and never spread over the rest."""
    dags = list(g.dags(most))
    if not dags:
        raise NotIdentified("the class has no member")
    found: dict[tuple[str, ...] | None, int] = {}
    for d in dags:
        try:
            z: tuple[str, ...] | None = backdoor(d, t, y).adjustment if y in d.descendants([t]) else ("__none",)
        except NotIdentified:
            z = None
        found[z] = found.get(z, 0) + 1
    return [(n / len(dags), None if z is None else Estimand("generalised", (t,), y, () if z == ("__none",) else z, notes=("no effect",) if z == ("__none",) else ())) for z, n in found.items()]


def temporal_backdoor(template: Iterable[tuple[str, int, str]], t: str, y: str, horizon: int, observed: Iterable[str] | None = None) -> Estimand:
    """Adjustment set of t at time -horizon for y at time 0, as (name, lag) of the unfolded graph."""
    template = list(template)
    deepest = max((lag for _, lag, _ in template), default=0)
    steps = horizon + 2 * deepest + 1
    g = unfold(template, steps)
    now, then = f"{y}@{steps - 1}", f"{t}@{steps - 1 - horizon}"
    # parents of the treatment at its time are always an adjustment set of a full DAG
    parents = tuple(sorted(g.parents[then]))
    if observed is not None and any(p.split("@")[0] not in set(observed) for p in parents):
        z = backdoor(g, then, now, [n for n in g.nodes if n.split("@")[0] in set(observed)]).adjustment
    else:
        z = parents
    named = tuple(f"{n.split('@')[0]}__lag{steps - 1 - int(n.split('@')[1])}" for n in z)
    return Estimand("temporal.backdoor", (f"{t}__lag{horizon}",), y, named)


def temporal_mediation(template: Iterable[tuple[str, int, str]], t: str, y: str, horizon: int) -> list[tuple[tuple[str, int], ...]]:
    """Directed template paths from t to y whose lags sum to the horizon, each as its edges' (cause, lag) steps."""
    edges = list(template)
    out, stack = [], [((t,), (), 0)]
    while stack:
        nodes, steps, total = stack.pop()
        if nodes[-1] == y and total == horizon and steps:
            out.append(tuple(steps))
            continue
        for a, lag, b in edges:
            if a == nodes[-1] and total + lag <= horizon and (lag or b not in nodes):
                stack.append(((*nodes, b), (*steps, (a, lag, b)), total + lag))
    return out


def auto(g: Admg, t: str, y: str, observed: Iterable[str] | None = None) -> list[Estimand]:
    """All strategies that apply, in order of preference; choosing is left to the caller."""
    out = []
    for strategy in (backdoor, frontdoor, instrument):
        try:
            out.append(strategy(g, t, y, observed))
        except NotIdentified:
            continue
    try:
        out.append(Estimand("id", (t,), y, functional=identify_do(g, [y], [t])))
    except NotIdentified:
        pass
    if not out:
        raise NotIdentified(f"no strategy applies to {t} -> {y}")
    return out


def normalise_intervention(kind: str, value) -> tuple[str, object]:
    """A soft constant is Set, a run of Sets is a schedule; Shift changes a mechanism and is refused here."""
    if kind == "set":
        return "set", value
    if kind == "soft" and not callable(value):
        return "set", value
    if kind == "sequence" and all(k == "set" for k, _ in value):
        return "schedule", tuple(v for _, v in value)
    raise Unsupported(f"intervention {kind!r} has no do-form")


def transport_certificate(g: Admg, t: str, y: str, differ: Iterable[str]) -> Estimand:
    """How P(y | do(t)) of a trial carries to a population where the mechanisms of ``differ`` may change.

    Direct when these do not matter; else by weights over a set that separates them from the outcome.
    """
    h = Admg([*g.nodes, *(f"S:{d}" for d in differ)], [*g.edges, *((f"S:{d}", d) for d in differ)], g.bidirected)
    s = {f"S:{d}" for d in differ}
    cut = h.copy(without_into=[t])
    if not s or cut.separated(s, [y], [t]):
        return Estimand("transport.direct", (t,), y)
    pool = [n for n in g.nodes if n not in (t, y) and n not in g.descendants([t])]
    for z in subsets(pool):
        if cut.separated(s, [y], {t, *z}):
            return Estimand("transport.s_admissible", (t,), y, tuple(z), functional=SumOut(tuple(z), Product((P((y,), (t, *z)), P(tuple(z))))))
    raise NotIdentified("no certificate of transport")


def require_reviewed(g: Mixed) -> Dag:
    """The DAG of a structure without open edges; else its open edges go to review."""
    open_edges = [(a, e, b) for a, e, b in g.edges() if e not in ("->", "-->", "<-", "<--", "-->") and not (g.directed(a, b) or g.directed(b, a))]
    if open_edges:
        raise ReviewRequired(open_edges)
    return Dag(g.nodes, [(a, b) for a in g.nodes for b in g.nodes if g.directed(a, b)])


@dataclass
class Review:
    """A discovered structure whose pending edges a person accepts or orients."""

    graph: Mixed
    log: list[tuple] = field(default_factory=list)

    @property
    def pending(self) -> list[tuple[str, str, str]]:
        return [(a, e, b) for a, e, b in self.graph.edges() if not (self.graph.directed(a, b) or self.graph.directed(b, a))]

    def orient(self, a: str, b: str) -> None:
        self.graph.orient(a, b)
        self.log.append(("orient", a, b))

    def remove(self, a: str, b: str) -> None:
        self.graph.remove(a, b)
        self.log.append(("remove", a, b))

    def accept(self) -> Dag:
        return require_reviewed(self.graph)


def binary_iv_bounds(cells: dict[tuple[int, int, int], float]) -> tuple[float, float]:
    """Sharp bounds on the mean effect from P(y, d | z) of binary variables; ``cells[z, d, y]``.

    By linear programming over the 16 response types (which variables' data violate the
    instrument's inequality is refused).
    """
    import itertools

    import numpy as np

    types = list(itertools.product(range(4), range(4)))  # d and y as functions of z and d: bit v is the value there
    rows, rhs = [], []
    for z, d, y in itertools.product((0, 1), repeat=3):
        rows.append([float((dt >> z & 1) == d and (yt >> d & 1) == y) for dt, yt in types])
        rhs.append(cells[z, d, y])
    a, b = np.array(rows), np.array(rhs)
    cost = np.array([float((yt >> 1 & 1) - (yt & 1)) for _, yt in types])
    # vertices of the dual are few; the primal's basic solutions are enumerated instead
    rank = np.linalg.matrix_rank(a)
    keep = []
    for i in range(len(a)):
        if np.linalg.matrix_rank(a[keep + [i]]) > len(keep):
            keep.append(i)
    a2, b2 = a[keep], b[keep]
    low, high = np.inf, -np.inf
    for basis in itertools.combinations(range(16), rank):
        m = a2[:, basis]
        if abs(np.linalg.det(m)) < 1e-9:
            continue
        x = np.linalg.solve(m, b2)
        if (x >= -1e-9).all():
            v = float(cost[list(basis)] @ x)
            low, high = min(low, v), max(high, v)
    if low > high:
        raise NotIdentified("the data violate the instrumental inequality")
    return low, high


def identify_schedule(g: Admg, y: str, schedule: Iterable[str]) -> Estimand:
    """The distribution of y when all treatments of a schedule are set: ID for several nodes at once; a hedge raises."""
    t = tuple(schedule)
    if not t or len(set(t)) != len(t) or y in t:
        raise NotIdentified("a schedule names distinct treatments other than the outcome")
    return Estimand("id", t, y, functional=identify_do(g, [y], t))
