"""Structure learning.  Data enter once, as a covariance or counts; the searches run on the driver.

A graph has a node per column.  What is proportional to rows is one reduction that all tests share.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from decimal import Decimal, localcontext
from itertools import combinations, permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causelake.errors import GraphError, Unsupported
from causelake.graphs.dag import Dag, Mixed
from causelake.operators.ci import Covariance
from causelake.operators.reduce import Gram, gram, lag_frame, solve
from causelake.schema import complete_cases

Test = Callable[[str, str, Sequence[str]], tuple[float, float]]


@dataclass
class Constraints:
    """Background knowledge: required and forbidden arrows, and tiers that causes cannot leave."""

    required: set[tuple[str, str]] = field(default_factory=set)
    forbidden: set[tuple[str, str]] = field(default_factory=set)
    tiers: dict[str, int] = field(default_factory=dict)

    def allows(self, a: str, b: str) -> bool:
        return (a, b) not in self.forbidden and (b, a) not in self.required and self.tiers.get(a, 0) <= self.tiers.get(b, self.tiers.get(a, 0))

    def needs(self, a: str, b: str) -> bool:
        return (a, b) in self.required or (b, a) in self.required


def skeleton(names: Sequence[str], test: Test, alpha: float = 0.05, most: int = 3, known: Constraints | None = None) -> tuple[Mixed, dict]:
    """The order-independent PC skeleton: (graph, separating sets); neighbours are frozen within a level."""
    known = known or Constraints()
    g = Mixed(names)
    sep: dict[frozenset[str], tuple[str, ...]] = {}
    for a, b in combinations(names, 2):
        if known.needs(a, b) or known.allows(a, b) or known.allows(b, a):
            g.connect(a, b, "-", "-")
    for level in range(most + 1):
        near = {n: g.neighbours(n) for n in names}
        if all(len(v) - 1 < level for v in near.values()):
            break
        for a, b in combinations(names, 2):
            if not g.adjacent(a, b) or known.needs(a, b):
                continue
            pools = [[n for n in near[a] if n != b], [n for n in near[b] if n != a]]
            for z in dict.fromkeys(c for p in pools for c in combinations(p, level)):
                if test(a, b, z)[1] > alpha:
                    g.remove(a, b)
                    sep[frozenset((a, b))] = z
                    break
    return g, sep


def colliders(g: Mixed, sep: dict, mark: str = "-") -> None:
    """Orients unshielded triples whose middle separates nothing; ``mark`` stays at the far ends."""
    for c in g.nodes:
        for a, b in combinations(g.neighbours(c), 2):
            if not g.adjacent(a, b) and c not in sep.get(frozenset((a, b)), (c,)):
                for x in (a, b):
                    if g.mark[c, x] != ">" or mark == "o":
                        g.connect(x, c, g.mark[c, x], ">")


def pc(names: Sequence[str], test: Test, alpha: float = 0.05, most: int = 3, known: Constraints | None = None) -> Mixed:
    """The PC algorithm: a CPDAG."""
    g, sep = skeleton(names, test, alpha, most, known)
    for a, b in (known.required if known else ()):
        g.orient(a, b)
    colliders(g, sep)
    return g.meek()


def _arrow(g: Mixed, a: str, b: str) -> bool:
    return g.mark.get((a, b)) == ">"


def orient_pag(g: Mixed, sep: dict) -> Mixed:
    """Zhang's rules R1-R4 and R8-R10 to a fixpoint."""
    changed = True
    while changed:
        changed = False

        def put(a: str, b: str, at_b: str) -> None:
            nonlocal changed
            if g.mark.get((a, b)) == "o":
                g.mark[a, b] = at_b
                changed = True

        for b in g.nodes:
            for a in g.neighbours(b):
                for c in g.neighbours(b):
                    if a == c:
                        continue
                    if _arrow(g, a, b) and not g.adjacent(a, c) and g.mark[c, b] == "o":  # R1
                        put(c, b, "-")
                        if g.mark[b, c] == "o":
                            put(b, c, ">")
                    if g.adjacent(a, c) and g.mark[a, c] == "o":  # R2
                        first = g.directed(a, b) and _arrow(g, b, c)
                        second = _arrow(g, a, b) and g.directed(b, c)
                        if first or second:
                            put(a, c, ">")
        for b in g.nodes:  # R3
            into = [a for a in g.neighbours(b) if _arrow(g, a, b)]
            for a, c in combinations(into, 2):
                if g.adjacent(a, c):
                    continue
                for d in g.neighbours(b):
                    if d in (a, c) or g.mark[d, b] != "o":
                        continue
                    if g.adjacent(a, d) and g.adjacent(c, d) and g.mark[a, d] == "o" and g.mark[c, d] == "o":
                        put(d, b, ">")
        for c in g.nodes:  # R4: discriminating paths for b between some a and c
            for b in g.neighbours(c):
                if g.mark[c, b] != "o":
                    continue
                for path in _discriminating(g, b, c):
                    d, a = path[0], path[-1]
                    if b in sep.get(frozenset((d, c)), ()):
                        put(c, b, "-")
                        put(b, c, ">")
                    else:
                        for x, y in ((a, b), (c, b), (b, c)):
                            put(x, y, ">")
                    break
        for a in g.nodes:
            for c in g.neighbours(a):
                if not (_arrow(g, a, c) and g.mark[c, a] == "o"):
                    continue
                if any((g.directed(a, b) or (g.mark.get((a, b)) == "o" and g.mark.get((b, a)) == "-")) and g.directed(b, c) for b in g.nodes if b not in (a, c)):  # R8
                    put(c, a, "-")
                    continue
                paths = list(_uncovered(g, a, c))
                if any(not g.adjacent(p[1], c) for p in paths):  # R9
                    put(c, a, "-")
                    continue
                parents = [b for b in g.neighbours(c) if g.directed(b, c) and b != a]
                for b, d in combinations(parents, 2):  # R10
                    first = {p[1] for p in _uncovered(g, a, b)} | ({b} if g.adjacent(a, b) and not _arrow(g, b, a) and g.mark[a, b] != "-" else set())
                    second = {p[1] for p in _uncovered(g, a, d)} | ({d} if g.adjacent(a, d) and not _arrow(g, d, a) and g.mark[a, d] != "-" else set())
                    if any(x != y and not g.adjacent(x, y) for x in first for y in second):
                        put(c, a, "-")
                        break
    return g


def _discriminating(g: Mixed, b: str, c: str) -> Iterable[tuple[str, ...]]:
    """Paths (d, ..., a) before b: inner nodes are colliders and parents of c, d is not adjacent to c."""
    stack = [(a,) for a in g.neighbours(b) if a != c and g.directed(a, c) and _arrow(g, b, a)]
    while stack:
        p = stack.pop()
        for d in g.neighbours(p[0]):
            if d in p or d in (b, c) or not _arrow(g, d, p[0]):
                continue
            if not g.adjacent(d, c):
                yield (d, *p)
            elif g.directed(d, c) and _arrow(g, p[0], d):
                stack.append((d, *p))


def _uncovered(g: Mixed, a: str, c: str, most: int = 2000) -> Iterable[tuple[str, ...]]:
    """Uncovered potentially directed paths of at least three nodes."""
    stack, seen = [(a,)], 0
    while stack and seen < most:
        p = stack.pop()
        seen += 1
        for n in g.neighbours(p[-1]):
            if n in p or g.mark[n, p[-1]] == ">" or g.mark[p[-1], n] == "-":
                continue
            if len(p) > 1 and g.adjacent(p[-2], n):
                continue
            if n == c:
                if len(p) > 1:
                    yield (*p, n)
            else:
                stack.append((*p, n))


def fci(names: Sequence[str], test: Test, alpha: float = 0.05, most: int = 3, possible_dsep: bool = True) -> Mixed:
    """FCI: a PAG; without ``possible_dsep`` the local variant that keeps the PC skeleton after re-checking colliders' legs."""
    g, sep = skeleton(names, test, alpha, most)
    for key in g.mark:
        g.mark[key] = "o"
    colliders(g, sep, "o")
    if possible_dsep:
        for a in names:
            pds = _possible_dsep(g, a)
            for b in [n for n in g.neighbours(a)]:
                pool = sorted(pds - {a, b})
                for z in (z for k in range(1, most + 1) for z in combinations(pool, k)):
                    if test(a, b, z)[1] > alpha:
                        g.remove(a, b)
                        sep[frozenset((a, b))] = z
                        break
        for key in g.mark:
            g.mark[key] = "o"
        colliders(g, sep, "o")
    else:
        for c in names:
            for a, b in combinations(g.neighbours(c), 2):
                z = sep.get(frozenset((a, b)))
                if g.adjacent(a, b) or z is None or c in z:
                    continue
                for x in (a, b):
                    if g.adjacent(x, c) and test(x, c, z)[1] > alpha:
                        g.remove(x, c)
                        sep[frozenset((x, c))] = z
    return orient_pag(g, sep)


def _possible_dsep(g: Mixed, a: str) -> set[str]:
    out, stack, seen = set(), [(a, b) for b in g.neighbours(a)], set()
    while stack:
        p, q = stack.pop()
        if (p, q) in seen:
            continue
        seen.add((p, q))
        out.add(q)
        for r in g.neighbours(q):
            if r != p and r != a and (_arrow(g, p, q) and _arrow(g, r, q) or g.adjacent(p, r)):
                stack.append((q, r))
    return out


class GaussianScore:
    """Local BIC from one Gram, with a cache."""

    def __init__(self, g: Gram):
        self.gram, self._cache = g, {}
        self.names = [n for n in g.names if n != "1"]

    def local(self, n: str, parents: Iterable[str]) -> float:
        key = (n, frozenset(parents))
        if key not in self._cache:
            fit = solve(self.gram, n, ["1", *sorted(key[1])], ridge=1e-12)
            k, size = len(key[1]) + 1, self.gram.n
            self._cache[key] = -0.5 * size * (1 + math.log(2 * math.pi) + math.log(max(fit.rss / size, 1e-12))) - 0.5 * k * math.log(size)
        return self._cache[key]

    def of(self, dag: Dag) -> float:
        return sum(self.local(n, dag.parents[n]) for n in dag.nodes)


def ges(score: GaussianScore, known: Constraints | None = None, most_parents: int = 6) -> Mixed:
    """Greedy search by insertions, deletions and turns of single arrows of a DAG, reported as its class."""
    known = known or Constraints()
    names = score.names
    parents: dict[str, set[str]] = {n: {a for a, b in known.required if b == n} for n in names}

    def reaches(a: str, b: str) -> bool:
        stack, seen = [b], set()
        while stack:
            n = stack.pop()
            if n == a:
                return True
            if n not in seen:
                seen.add(n)
                stack += parents[n]
        return False

    while True:
        best, move = 1e-9, None
        for a, b in permutations(names, 2):
            now = score.local(b, parents[b])
            if a in parents[b]:
                if (a, b) in known.required:
                    continue
                gain = score.local(b, parents[b] - {a}) - now
                if gain > best:
                    best, move = gain, ("delete", a, b)
                parents[b].discard(a)
                if known.allows(b, a) and not reaches(a, b) and len(parents[a]) < most_parents:
                    gain += score.local(a, parents[a] | {b}) - score.local(a, parents[a])
                    if gain > best:
                        best, move = gain, ("turn", a, b)
                parents[b].add(a)
            elif b not in parents[a] and known.allows(a, b) and len(parents[b]) < most_parents and not reaches(b, a):
                gain = score.local(b, parents[b] | {a}) - now
                if gain > best:
                    best, move = gain, ("insert", a, b)
        if move is None:
            return Mixed.from_dag(Dag(names, [(a, n) for n in names for a in parents[n]]))
        kind, a, b = move
        if kind == "insert":
            parents[b].add(a)
        else:
            parents[b].discard(a)
            if kind == "turn":
                parents[a].add(b)


def notears(g: Gram, penalty: float = 0.05, threshold: float = 0.3, rounds: int = 30) -> dict[tuple[str, str], float]:
    """Continuous search: least squares with an acyclicity constraint; loss and gradient need only the covariance."""
    names = [n for n in g.names if n != "1"]
    c, p = g.covariance(names), len(names)
    # not zero: there both directions of an arrow would stay equal
    w, rho, alpha = np.triu(np.full((p, p), 1e-3), 1), 1.0, 0.0

    def expm(m: np.ndarray) -> np.ndarray:
        out, term = np.eye(p), np.eye(p)
        for k in range(1, 40):
            term = term @ m / k
            out = out + term
        return out

    h_old = np.inf
    for _ in range(rounds):
        rate = 0.5 / (np.linalg.norm(c, 2) + rho)
        for _ in range(800):
            e = expm(w * w)
            h = np.trace(e) - p
            grad = -c @ (np.eye(p) - w) + (rho * h + alpha) * e.T * 2 * w
            new = w - rate * grad
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
            np.fill_diagonal(new, 0)
            done = np.abs(new - w).max() < 1e-8
            w = new
            if done:
                break
        h = np.trace(expm(w * w)) - p
        if h < 1e-8:
            break
        alpha += rho * h
        if h > 0.25 * h_old:
            rho = min(rho * 10, 1e8)
        h_old = h
    return {(names[i], names[j]): float(w[i, j]) for i in range(p) for j in range(p) if abs(w[i, j]) >= threshold}


def _entropies(rows: DataFrame, names: Sequence[str], directions: np.ndarray) -> np.ndarray:
    """Approximate entropy of each standardised direction of the columns, from two means over all rows."""

    def sums(batches):
        total, n = np.zeros((2, len(directions))), 0
        for batch in batches:
            x = batch.to_numpy(float)
            size = max(1, 2_000_000 // len(directions))
            for i in range(0, len(x), size):
                u = x[i : i + size] @ directions.T
                total += (np.logaddexp(u, -u) - math.log(2)).sum(0), (u * np.exp(-u * u / 2)).sum(0)
            n += len(x)
        yield pd.DataFrame({"i": np.arange(len(directions)), "a": total[0], "b": total[1], "n": n})

    got = rows.mapInPandas(sums, "i int, a double, b double, n long").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n")).toPandas().sort_values("i")
    a, b = (got["a"] / got["n"]).to_numpy(), (got["b"] / got["n"]).to_numpy()
    return (1 + math.log(2 * math.pi)) / 2 - 79.047 * (a - 0.37457) ** 2 - 7.4129 * b**2


def direct_lingam(df: DataFrame, names: Sequence[str], key: str, threshold: float = 0.05) -> tuple[list[str], dict[tuple[str, str], float]]:
    """Causal order by residual independence (a kernel-free entropy measure), arrows pruned by OLS.

    Residuals are directions of the columns, known from the Gram; a step of the order is one aggregate over all
    rows for the entropies of all pairs' residuals.  ``key`` is not needed for that.
    """
    rows = complete_cases(df, list(names)).select(*[F.col(n).cast("double").alias(n) for n in names]).persist()
    try:
        means = np.array(rows.agg(*[F.avg(n) for n in names]).first())
        centred = rows.select(*[(F.col(n) - float(m)).alias(n) for n, m in zip(names, means)])
        c = gram(centred, list(names)).covariance(list(names))
        w = np.diag(1 / np.sqrt(np.diag(c)))  # the variables that are left, as directions
        left, order = list(range(len(names))), []
        while len(left) > 1:
            pairs = [(i, j) for i in left for j in left if i != j]
            r = {(i, j): w[i] - (w[i] @ c @ w[j]) * w[j] for i, j in pairs}
            d = np.array([w[i] for i in left] + [r[p] / math.sqrt(r[p] @ c @ r[p]) for p in pairs])
            h = dict(zip([*left, *pairs], _entropies(centred, names, d)))
            root = min(left, key=lambda i: sum(min(0.0, h[j] + h[i, j] - h[i] - h[j, i]) ** 2 for j in left if j != i))
            order.append(root)
            left.remove(root)
            for j in left:
                w[j] = r[j, root] / math.sqrt(r[j, root] @ c @ r[j, root])
        order += left
    finally:
        rows.unpersist()
    ordered = [names[i] for i in order]
    g = gram(df, list(names))
    arrows = {}
    for k, n in enumerate(ordered[1:], 1):
        fit = solve(g, n, ["1", *ordered[:k]])
        sd = {m: math.sqrt(g.covariance([m])[0, 0]) for m in (n, *ordered[:k])}
        arrows |= {(m, n): fit[m] for m in ordered[:k] if abs(fit[m]) * sd[m] / sd[n] > threshold}
    return ordered, arrows


# --- time series


@dataclass(frozen=True)
class Link:
    cause: str
    lag: int
    effect: str
    statistic: float
    p: float


def _column(name: str, lag: int) -> str:
    return f"{name}__lag{lag}"


def lagged_covariance(df: DataFrame, names: Sequence[str], depth: int, time: str, by: Sequence[str] = ()) -> Covariance:
    """One lag frame and one Gram answer every lagged test."""
    f = lag_frame(df, names, list(range(depth + 1)), time, by)
    columns = [_column(n, k) for n in names for k in range(depth + 1)]
    for c in columns:
        f = f.where(F.col(c).isNotNull())
    return Covariance(gram(f, columns))


def pc_parents(h: Covariance, names: Sequence[str], target: str, max_lag: int, alpha: float, most: int = 2) -> list[tuple[str, int]]:
    """Lagged parents of a target: per level one conditioning set for each candidate, strongest first."""
    parents = [(n, k) for n in names for k in range(1, max_lag + 1)]
    low = dict.fromkeys(parents, math.inf)
    for size in range(most + 1):
        if len(parents) - 1 < size:
            break
        gone = []
        for c in parents:
            z = [p for p in parents if p != c][:size]
            s, p = h.test(_column(*c), _column(target, 0), [_column(*x) for x in z])
            low[c] = min(low[c], abs(s))
            if p > alpha:
                gone.append(c)
        parents = sorted((c for c in parents if c not in gone), key=lambda c: (-low[c], names.index(c[0]), c[1]))
    return parents


def pcmci(df: DataFrame, names: Sequence[str], max_lag: int, time: str, by: Sequence[str] = (), alpha: float = 0.05, fdr: bool = False, contemporaneous: bool = False) -> tuple[list[Link], Mixed | None]:
    """PCMCI; with ``contemporaneous`` also lag-0 links, oriented by lagged colliders and Meek's rules."""
    h = lagged_covariance(df, names, 2 * max_lag, time, by)
    parents = {n: pc_parents(h, names, n, max_lag, alpha) for n in names}
    found = []
    for effect in names:
        for cause in names:
            for lag in range(0 if contemporaneous else 1, max_lag + 1):
                if lag == 0 and names.index(cause) >= names.index(effect):
                    continue
                z = [_column(n, k) for n, k in parents[effect] if (n, k) != (cause, lag)]
                z += [_column(n, k + lag) for n, k in parents[cause]]
                z = [c for c in dict.fromkeys(z) if c not in (_column(cause, lag), _column(effect, 0))]
                if len(z) > 30:
                    raise Unsupported("more than 30 conditioning columns")
                found.append(Link(cause, lag, effect, *h.test(_column(cause, lag), _column(effect, 0), z)))
    if fdr:
        order = sorted(range(len(found)), key=lambda i: found[i].p)
        q, low = [0.0] * len(found), 1.0
        for r in range(len(order), 0, -1):
            low = min(low, found[order[r - 1]].p * len(order) / r)
            q[order[r - 1]] = low
        found = [Link(x.cause, x.lag, x.effect, x.statistic, v) for x, v in zip(found, q)]
    links = [x for x in found if x.p <= alpha]
    graph = None
    if contemporaneous:
        graph = Mixed(names)
        for x in links:
            if x.lag == 0:
                graph.connect(x.cause, x.effect, "-", "-")
        for x in links:  # a lagged cause of one end only tells which way the contemporaneous edge points
            for n in graph.neighbours(x.effect) if x.lag else ():
                if graph.undirected(x.effect, n) and not any(y.cause == x.cause and y.lag == x.lag and y.effect == n for y in links):
                    z = [_column(x.effect, 0), *[_column(*p) for p in parents[n] if p != (x.cause, x.lag)]]
                    if h.test(_column(x.cause, x.lag), _column(n, 0), z)[1] > alpha and h.test(_column(x.cause, x.lag), _column(n, 0), z[1:])[1] <= alpha:
                        graph.orient(x.effect, n)
        graph.meek()
    return links, graph


def pcmci_environments(df: DataFrame, names: Sequence[str], max_lag: int, time: str, environment: str, alpha: float = 0.05) -> list[Link]:
    """Pooled environments: lags stay inside one, and each environment's mean is removed first."""
    centred = df.join(F.broadcast(df.groupBy(environment).agg(*[F.avg(n).alias(f"__m_{n}") for n in names])), environment)
    centred = centred.select(environment, time, *[(F.col(n) - F.col(f"__m_{n}")).alias(n) for n in names])
    return pcmci(centred, names, max_lag, time, [environment], alpha)[0]


def pcmci_regimes(df: DataFrame, names: Sequence[str], max_lag: int, time: str, regime: str, by: Sequence[str] = (), alpha: float = 0.05) -> dict[object, list[Link]]:
    """One graph per regime; windows that cross a regime's border drop out."""
    out = {}
    w = [*by, regime]
    for (value,) in sorted(map(tuple, df.select(regime).distinct().collect())):
        out[value] = pcmci(df.where(F.col(regime) == F.lit(value)), names, max_lag, time, w, alpha)[0]
    return out


# --- posteriors over graphs


def exact_posterior(score: GaussianScore, prior_edge: float = 0.5) -> list[tuple[int, float]]:
    """(edge mask, weight) of all DAGs over up to five variables; bit i * p + j is the arrow i -> j."""
    names, p = score.names, len(score.names)
    if p > 5:
        raise Unsupported("exact enumeration is limited to five variables")
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    logs, masks = [], []
    for code in range(3 ** len(pairs)):
        parents: list[list[int]] = [[] for _ in range(p)]
        mask, c, edges = 0, code, 0
        for i, j in pairs:
            c, kind = divmod(c, 3)
            if kind:
                a, b = (i, j) if kind == 1 else (j, i)
                parents[b].append(a)
                mask |= 1 << (a * p + b)
                edges += 1
        left, cyclic = set(range(p)), False
        while left:
            free = [n for n in left if not set(parents[n]) & left]
            if not free:
                cyclic = True
                break
            left -= set(free)
        if cyclic:
            continue
        logs.append(sum(score.local(names[n], [names[a] for a in parents[n]]) for n in range(p)) + edges * math.log(prior_edge / (1 - prior_edge)))
        masks.append(mask)
    top = max(logs)
    weights = np.exp(np.array(logs) - top)
    weights /= weights.sum()
    return list(zip(masks, weights.tolist()))


def _acyclic_parents(p: int, pairs: Sequence[tuple[int, int]], most: int) -> Iterable[list[frozenset[int]]]:
    """Parent sets of every DAG whose arrows lie on the given pairs."""
    if 3 ** len(pairs) > most:
        raise Unsupported(f"{3 ** len(pairs)} orientations are more than {most}; use structure_mcmc")
    for kinds in product((0, 1, 2), repeat=len(pairs)):
        parents: list[set[int]] = [set() for _ in range(p)]
        for (i, j), kind in zip(pairs, kinds):
            if kind:
                a, b = (i, j) if kind == 1 else (j, i)
                parents[b].add(a)
        left = set(range(p))
        while left:
            free = {n for n in left if not parents[n] & left}
            if not free:
                break
            left -= free
        if not left:
            yield [frozenset(x) for x in parents]


def screened_posterior(score: GaussianScore, left: Mixed, prior_edge: float = 0.5, most: int = 200_000) -> dict[tuple[str, str], float]:
    """Probability of each arrow over the DAGs inside a skeleton that tests left; exact there, zero outside it."""
    names = score.names
    at = {n: i for i, n in enumerate(names)}
    pairs = sorted(tuple(sorted(at[n] for n in e)) for e in left.skeleton())
    odds = math.log(prior_edge / (1 - prior_edge))
    graphs = list(_acyclic_parents(len(names), pairs, most))
    logs = np.array([sum(score.local(names[n], [names[a] for a in x]) + odds * len(x) for n, x in enumerate(g)) for g in graphs])
    weights = np.exp(logs - logs.max())
    weights /= weights.sum()
    out = {(names[a], names[b]): 0.0 for i, j in pairs for a, b in ((i, j), (j, i))}
    for g, w in zip(graphs, weights.tolist()):
        for n, x in enumerate(g):
            for a in x:
                out[names[a], names[n]] += w
    return out


def dbn_posterior(df: DataFrame, names: Sequence[str], max_lag: int, time: str, by: Sequence[str] = (), prior_edge: float = 0.5, most_lagged: int = 3, most: int = 200_000) -> dict[tuple[str, int, str], float]:
    """Probability of each lagged and contemporaneous arrow of a stationary template, from one Gram of the lag frame.

    Lagged parents (at most ``most_lagged`` a node) never close a cycle, so they are summed out node by node; what is
    enumerated are the contemporaneous DAGs.
    """
    lags = [(n, k) for n in names for k in range(1, max_lag + 1)]
    frame = lag_frame(df, names, list(range(max_lag + 1)), time, by)
    columns = [_column(n, 0) for n in names] + [_column(*x) for x in lags]
    score = GaussianScore(gram(complete_cases(frame, columns), columns))
    odds, p = math.log(prior_edge / (1 - prior_edge)), len(names)
    subsets = [c for k in range(min(most_lagged, len(lags)) + 1) for c in combinations(lags, k)]
    cache: dict[tuple[int, frozenset[int]], tuple[float, dict[tuple[str, int], float]]] = {}

    def node(n: int, now: frozenset[int]) -> tuple[float, dict[tuple[str, int], float]]:
        """(log of the sum over lagged parents, probability of each of them) of a node with its contemporaneous parents."""
        if (n, now) not in cache:
            base = [_column(names[a], 0) for a in sorted(now)]
            logs = np.array([score.local(_column(names[n], 0), [*base, *[_column(*x) for x in c]]) + odds * (len(c) + len(now)) for c in subsets])
            w = np.exp(logs - logs.max())
            each = {x: float(sum(v for c, v in zip(subsets, w) if x in c) / w.sum()) for x in lags}
            cache[n, now] = float(logs.max() + math.log(w.sum())), each
        return cache[n, now]

    graphs = list(_acyclic_parents(p, list(combinations(range(p), 2)), most))
    logs = np.array([sum(node(n, x)[0] for n, x in enumerate(g)) for g in graphs])
    weights = np.exp(logs - logs.max())
    weights /= weights.sum()
    out = {(a, 0, b): 0.0 for a in names for b in names if a != b} | {(a, k, b): 0.0 for a, k in lags for b in names}
    for g, w in zip(graphs, weights.tolist()):
        for n, x in enumerate(g):
            for a in x:
                out[names[a], 0, names[n]] += w
            for (a, k), v in node(n, x)[1].items():
                out[a, k, names[n]] += w * v
    return out


def edge_posterior(score: GaussianScore, prior_edge: float = 0.5, most: int = 8) -> dict[tuple[str, str], float]:
    """Exact probability of each arrow over all DAGs of up to ``most`` variables, by inclusion and exclusion over sinks.

    The weight of all DAGs on a set of nodes is an alternating sum over the sets of its sinks; an arrow's share is that
    sum again with the arrow's child forced to hold it.  Numbers are decimals of 80 digits, for the terms cancel.
    """
    names, p = score.names, len(score.names)
    if p > most:
        raise Unsupported(f"exact probabilities are limited to {most} variables; use structure_mcmc")
    odds, whole = math.log(prior_edge / (1 - prior_edge)), (1 << p) - 1
    inside = lambda mask: [i for i in range(p) if mask >> i & 1]
    with localcontext() as ctx:
        ctx.prec = 80
        local = [{m: score.local(names[n], [names[i] for i in inside(m)]) + odds * m.bit_count() for m in range(1 << p) if not m >> n & 1} for n in range(p)]
        weight = [{m: (Decimal(v) - Decimal(max(at.values()))).exp() for m, v in at.items()} for at in local]

        def sums(n: int, needed: int = 0) -> dict[int, Decimal]:
            """For each set of allowed parents, the weight of all parent sets in it that hold the needed ones."""
            out = {m: (w if m & needed == needed else Decimal(0)) for m, w in weight[n].items()}
            for i in range(p):
                if i != n:
                    for m in sorted(out):
                        if m >> i & 1:
                            out[m] += out[m ^ 1 << i]
            return out

        def total(tables: list[dict[int, Decimal]]) -> Decimal:
            z = {0: Decimal(1)}
            for s in range(1, 1 << p):
                acc, sinks = Decimal(0), s
                while sinks:
                    rest, term = s ^ sinks, z[s ^ sinks]
                    for n in inside(sinks):
                        term *= tables[n][rest]
                    acc += term if sinks.bit_count() % 2 else -term
                    sinks = (sinks - 1) & s
                z[s] = acc
            return z[whole]

        plain = [sums(n) for n in range(p)]
        all_dags = total(plain)
        out = {}
        for b in range(p):
            for a in range(p):
                if a != b:
                    forced = [sums(b, 1 << a) if n == b else plain[n] for n in range(p)]
                    out[names[a], names[b]] = float(total(forced) / all_dags)
    return out


def structure_mcmc(spark, score: GaussianScore, chains: int = 4, steps: int = 2000, seed: int = 0) -> DataFrame:
    """Metropolis over single arrows, one task a chain; the score table of the Gram is broadcast."""
    import pandas as pd

    held = spark.sparkContext.broadcast((score.gram.names, score.gram.matrix, score.gram.centred))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        own = GaussianScore(Gram(*held.value))
        p, chain = len(own.names), int(g["chain"].iloc[0])
        rng = np.random.default_rng([seed, chain])
        a = np.zeros((p, p), bool)
        local = [own.local(n, []) for n in own.names]
        masks, values = [], []
        for _ in range(steps):
            i, j = rng.choice(p, 2, replace=False)
            b = a.copy()
            b[i, j] = not a[i, j]
            b[j, i] = False
            reach = b.copy()
            for k in range(p):
                reach |= np.outer(reach[:, k], reach[k])
            if not np.trace(reach):
                new = local[:]
                for n in (i, j):
                    new[n] = own.local(own.names[n], [own.names[m] for m in np.flatnonzero(b[:, n])])
                if math.log(rng.random()) < sum(new) - sum(local):
                    a, local = b, new
            masks.append(int(sum(1 << (x * p + y) for x, y in zip(*np.nonzero(a)))))
            values.append(sum(local))
        half = steps // 2
        return pd.DataFrame({"chain": chain, "step": range(half, steps), "mask": masks[half:], "score": values[half:]})

    return spark.range(chains).withColumnRenamed("id", "chain").groupBy("chain").applyInPandas(run, "chain long, step long, mask long, score double")


def stability(df: DataFrame, names: Sequence[str], key: str, replicates: int, search: Callable[[Covariance], Mixed], seed: int = 1) -> dict[tuple[str, str, str], float]:
    """Share of Bayesian-bootstrap replicates in which each edge appears: one Gram per replicate, from one job."""
    from causelake.functions.transforms import exponential
    from causelake.operators.reduce import replicates as expand
    from causelake.schema import WEIGHT

    rows = expand(df.select(*names, key), replicates)
    rows = rows.withColumn(WEIGHT, exponential(seed, "stability", key, "replicate"))
    counts: dict[tuple[str, str, str], int] = {}
    for g in gram(rows, list(names), by=["replicate"]).values():
        for e in search(Covariance(g)).edges():
            counts[e] = counts.get(e, 0) + 1
    return {e: n / replicates for e, n in counts.items()}


def check_acyclic(edges: Iterable[tuple[str, str]]) -> Dag:
    """The DAG of some arrows, or an error that names the cycle."""
    g = Dag()
    for a, b in edges:
        try:
            g.add_edge(a, b)
        except GraphError as e:
            raise GraphError(f"discovered arrows are cyclic: {e}") from e
    return g
