"""Partial ancestral graphs: status of paths, activity, and the ancestral graphs a partial one stands for.

Graphs have a node per column, so searches run on the driver, bounded by ``most``; each says whether it was cut.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations, product

from causelake.errors import GraphError
from causelake.graphs.dag import Mixed


def paths(g: Mixed, x: str, y: str, longest: int | None = None) -> Iterator[tuple[str, ...]]:
    """Simple paths, depth first, of at most ``longest`` edges."""
    stack = [(x,)]
    while stack:
        p = stack.pop()
        if p[-1] == y:
            yield p
            continue
        if longest is None or len(p) <= longest:
            stack += [(*p, n) for n in reversed(g.neighbours(p[-1])) if n not in p]


def status(g: Mixed, a: str, b: str, c: str) -> str:
    """``collider``, ``noncollider`` or ``unknown`` of the middle of a path a, b, c."""
    left, right = g.mark[a, b], g.mark[c, b]
    if left == right == ">":
        return "collider"
    if "-" in (left, right) or (left == right == "o" and not g.adjacent(a, c)):
        return "noncollider"
    return "unknown"


def definite_status_paths(g: Mixed, x: str, y: str, most: int = 1000, longest: int | None = None) -> tuple[list[tuple[str, ...]], bool]:
    """Paths whose inner nodes are all known to be colliders or not; and whether the search was cut at ``most``."""
    found = []
    for p in paths(g, x, y, longest):
        if all(status(g, *p[i : i + 3]) != "unknown" for i in range(len(p) - 2)):
            if len(found) == most:
                return found, True
            found.append(p)
    return found, False


def definite_descendants(g: Mixed, n: str) -> set[str]:
    """The node and what directed edges reach from it."""
    seen, todo = {n}, [n]
    while todo:
        a = todo.pop()
        for b in g.neighbours(a):
            if g.directed(a, b) and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def active(g: Mixed, path: tuple[str, ...], given: Iterable[str]) -> bool:
    """Whether a definite-status path connects given the nodes: non-colliders outside, colliders with a descendant inside."""
    z = set(given)
    for i in range(len(path) - 2):
        s, b = status(g, *path[i : i + 3]), path[i + 1]
        if s == "unknown":
            raise GraphError("the path has a node of unknown status")
        if (s == "noncollider" and b in z) or (s == "collider" and not definite_descendants(g, b) & z):
            return False
    return True


def connected(g: Mixed, x: str, y: str, given: Iterable[str] = (), most: int = 1000) -> tuple[bool, bool]:
    """(whether a definite-status path is active, whether the search was cut)."""
    found, cut = definite_status_paths(g, x, y, most)
    return any(active(g, p, given) for p in found), cut


# --- completions


def is_ancestral(g: Mixed) -> bool:
    """No circles, no directed cycle, and no two-headed edge between a node and its ancestor."""
    if "o" in g.mark.values():
        return False
    down = {n: definite_descendants(g, n) for n in g.nodes}
    for a, b in combinations(g.nodes, 2):
        if b in down[a] and a in down[b]:
            return False
        if g.mark.get((a, b)) == ">" == g.mark.get((b, a)) and (b in down[a] or a in down[b]):
            return False
        if g.undirected(a, b):
            return False  # no selection variables
    return True


def separated(g: Mixed, x: str, y: str, given: Iterable[str]) -> bool:
    """m-separation in an ancestral graph, over walks of (node, arrowhead there)."""
    z = set(given)
    above = {n for n in g.nodes if definite_descendants(g, n) & z}
    todo = [(n, g.mark[x, n] == ">") for n in g.neighbours(x)]
    seen = set(todo)
    while todo:
        b, into = todo.pop()
        if b == y:
            return False
        for c in g.neighbours(b):
            collider = into and g.mark[c, b] == ">"
            if (b in above) if collider else (b not in z):
                step = (c, g.mark[b, c] == ">")
                if c != x and step not in seen:
                    seen.add(step)
                    todo.append(step)
    return True


def _independences(g: Mixed) -> frozenset:
    out = []
    for x, y in combinations(g.nodes, 2):
        rest = [n for n in g.nodes if n not in (x, y)]
        out += [(x, y, z) for k in range(len(rest) + 1) for z in combinations(rest, k) if separated(g, x, y, z)]
    return frozenset(out)


def is_maximal(g: Mixed) -> bool:
    """Each pair without an edge is separated by some set."""
    apart = {(x, y) for x, y, _ in _independences(g)}
    return all(g.adjacent(x, y) or (x, y) in apart for x, y in combinations(g.nodes, 2))


@dataclass(frozen=True)
class Audit:
    """What a stream of completions did: how many candidates it looked at, kept and refused, and whether a cap cut it."""

    examined: int
    kept: int
    not_ancestral: int
    not_maximal: int
    not_equivalent: int
    cut: bool


def completions(g: Mixed, most: int = 100, examine: int = 100_000) -> tuple[list[Mixed], Audit]:
    """The maximal ancestral graphs that agree with the partial one's marks and are equivalent to one another, with the audit.

    The first that fits fixes the independences (sound for a partial graph from FCI, whose completions are one class);
    candidates set the circles in lexicographic order, tails first.  Meant for few nodes: separations are enumerated.
    """
    open_marks = sorted(k for k, v in g.mark.items() if v == "o")
    kept: list[Mixed] = []
    counts = dict.fromkeys(("examined", "not_ancestral", "not_maximal", "not_equivalent"), 0)
    reference, cut = None, False
    triples = [(a, b, c) for b in g.nodes for a, c in combinations(g.neighbours(b), 2) if not g.adjacent(a, c)]
    known = {t: g.mark[t[0], t[1]] == g.mark[t[2], t[1]] == ">" for t in triples}
    for marks in product("->", repeat=len(open_marks)):
        if counts["examined"] == examine or len(kept) == most:
            cut = True
            break
        counts["examined"] += 1
        h = g.copy()
        h.mark.update(zip(open_marks, marks))
        if not is_ancestral(h):
            counts["not_ancestral"] += 1
        elif any((h.mark[a, b] == h.mark[c, b] == ">") != k for (a, b, c), k in known.items()):
            counts["not_equivalent"] += 1
        elif not is_maximal(h):
            counts["not_maximal"] += 1
        else:
            holds = _independences(h)
            reference = holds if reference is None else reference
            if holds == reference:
                kept.append(h)
            else:
                counts["not_equivalent"] += 1
    return kept, Audit(counts["examined"], len(kept), counts["not_ancestral"], counts["not_maximal"], counts["not_equivalent"], cut)
