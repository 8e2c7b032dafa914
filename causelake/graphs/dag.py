"""Directed and mixed graphs over variables, with separation and surgery.

A graph has a node per column, never per row, so it lives on the driver as sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

from causelake.errors import GraphError


class Admg:
    """Acyclic directed mixed graph: directed edges and bidirected (latent) ones."""

    def __init__(self, nodes: Iterable[str] = (), directed: Iterable[tuple[str, str]] = (), bidirected: Iterable[tuple[str, str]] = ()):
        self.nodes: list[str] = []
        self.parents: dict[str, set[str]] = {}
        self.children: dict[str, set[str]] = {}
        self.siblings: dict[str, set[str]] = {}
        for n in nodes:
            self.add_node(n)
        for a, b in directed:
            self.add_edge(a, b)
        for a, b in bidirected:
            self.add_bidirected(a, b)

    def add_node(self, n: str) -> None:
        if n not in self.parents:
            self.nodes.append(n)
            self.parents[n], self.children[n], self.siblings[n] = set(), set(), set()

    def add_edge(self, a: str, b: str) -> None:
        """Inserts a -> b; an edge that would close a cycle is refused."""
        self.add_node(a)
        self.add_node(b)
        if a == b or a in self.descendants([b]):
            raise GraphError(f"{a} -> {b} closes a cycle")
        self.children[a].add(b)
        self.parents[b].add(a)

    def add_bidirected(self, a: str, b: str) -> None:
        self.add_node(a)
        self.add_node(b)
        if a == b:
            raise GraphError("a variable has no latent edge with itself")
        self.siblings[a].add(b)
        self.siblings[b].add(a)

    @property
    def edges(self) -> list[tuple[str, str]]:
        return [(a, b) for a in self.nodes for b in self.nodes if b in self.children[a]]

    @property
    def bidirected(self) -> list[tuple[str, str]]:
        return [(a, b) for i, a in enumerate(self.nodes) for b in self.nodes[i + 1 :] if b in self.siblings[a]]

    def copy(self, without_into: Iterable[str] = (), without_out_of: Iterable[str] = (), keep: Iterable[str] | None = None):
        """The graph after surgery: edges into or out of some nodes removed, or restricted to some nodes."""
        into, out, kept = set(without_into), set(without_out_of), set(self.nodes if keep is None else keep)
        g = type(self)(n for n in self.nodes if n in kept)
        for a, b in self.edges:
            if a in kept and b in kept and b not in into and a not in out:
                g.children[a].add(b)
                g.parents[b].add(a)
        for a, b in self.bidirected:
            if a in kept and b in kept and a not in into and b not in into:
                g.siblings[a].add(b)
                g.siblings[b].add(a)
        return g

    def _closure(self, start: Iterable[str], step: dict[str, set[str]]) -> set[str]:
        seen, todo = set(), list(start)
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += step[n]
        return seen

    def ancestors(self, nodes: Iterable[str]) -> set[str]:
        """The nodes and all their ancestors."""
        return self._closure(nodes, self.parents)

    def descendants(self, nodes: Iterable[str]) -> set[str]:
        """The nodes and all their descendants."""
        return self._closure(nodes, self.children)

    def order(self) -> list[str]:
        """Topological order; ties in order of insertion."""
        left = {n: len(self.parents[n]) for n in self.nodes}
        out: list[str] = []
        while len(out) < len(self.nodes):
            n = next(n for n in self.nodes if left.get(n) == 0)
            del left[n]
            out.append(n)
            for c in self.children[n]:
                left[c] -= 1
        return out

    def markov_blanket(self, n: str) -> set[str]:
        out = self.parents[n] | self.children[n] | {p for c in self.children[n] for p in self.parents[c]}
        return out - {n}

    def districts(self) -> list[set[str]]:
        """Components of the bidirected part."""
        out, seen = [], set()
        for n in self.nodes:
            if n not in seen:
                d = self._closure([n], self.siblings)
                seen |= d
                out.append(d)
        return out

    def directed_paths(self, a: str, b: str, most: int = 10_000) -> tuple[list[tuple[str, ...]], bool]:
        """(simple directed paths, whether the cap was hit)."""
        useful, out, stack = self.ancestors([b]), [], [(a,)]
        while stack:
            p = stack.pop()
            if p[-1] == b:
                if len(out) == most:
                    return out, True
                out.append(p)
                continue
            stack += [(*p, c) for c in sorted(self.children[p[-1]], reverse=True) if c in useful and c not in p]
        return out, False

    def separated(self, x: Iterable[str], y: Iterable[str], z: Iterable[str] = ()) -> bool:
        """m-separation (d-separation without bidirected edges), by reachability over (node, arrived with a head)."""
        x, y, z = set(x), set(y), set(z)
        opened = self.ancestors(z)
        todo, seen = [], set()

        def leave(n: str) -> None:
            todo.extend((c, True) for c in self.children[n])
            todo.extend((s, True) for s in self.siblings[n])
            todo.extend((p, False) for p in self.parents[n])

        for n in x:
            leave(n)
        while todo:
            n, head = todo.pop()
            if (n, head) in seen:
                continue
            seen.add((n, head))
            if n in y and n not in z:
                return False
            if n not in z:  # passes as a non-collider
                todo.extend((c, True) for c in self.children[n])
                if not head:
                    todo.extend((s, True) for s in self.siblings[n])
                    todo.extend((p, False) for p in self.parents[n])
            if head and n in opened:  # passes as a collider
                todo.extend((s, True) for s in self.siblings[n])
                todo.extend((p, False) for p in self.parents[n])
        return True


class Dag(Admg):
    """A graph without latent edges."""

    def add_bidirected(self, a: str, b: str) -> None:
        raise GraphError("a DAG has no bidirected edges")

    def latent_projection(self, observed: Iterable[str]) -> Admg:
        """The mixed graph over the observed variables."""
        seen = [n for n in self.nodes if n in set(observed)]
        hidden = set(self.nodes) - set(seen)
        out = Admg(seen)

        def reached(n: str) -> set[str]:
            found, todo, walked = set(), list(self.children[n]), set()
            while todo:
                c = todo.pop()
                if c in walked:
                    continue
                walked.add(c)
                if c in hidden:
                    todo += self.children[c]
                else:
                    found.add(c)
            return found

        for n in seen:
            for c in reached(n):
                out.add_edge(n, c)
        for h in hidden:
            for a, b in combinations(sorted(reached(h)), 2):
                out.add_bidirected(a, b)
        return out


def subsets(items: Iterable[str], most: int | None = None) -> Iterator[tuple[str, ...]]:
    """Subsets by growing size."""
    items = list(items)
    for k in range(len(items) + 1 if most is None else most + 1):
        yield from combinations(items, k)


class Mixed:
    """Endpoint marks between pairs: CPDAGs (tail, arrow) and PAGs (with circles)."""

    TAIL, ARROW, CIRCLE = "-", ">", "o"

    def __init__(self, nodes: Iterable[str]):
        self.nodes = list(nodes)
        self.mark: dict[tuple[str, str], str] = {}  # (a, b): the mark at b of the edge between a and b

    def connect(self, a: str, b: str, at_a: str, at_b: str) -> None:
        self.mark[a, b], self.mark[b, a] = at_b, at_a

    def remove(self, a: str, b: str) -> None:
        self.mark.pop((a, b), None)
        self.mark.pop((b, a), None)

    def adjacent(self, a: str, b: str) -> bool:
        return (a, b) in self.mark

    def neighbours(self, a: str) -> list[str]:
        return [b for b in self.nodes if (a, b) in self.mark]

    def directed(self, a: str, b: str) -> bool:
        return self.mark.get((a, b)) == ">" and self.mark.get((b, a)) == "-"

    def undirected(self, a: str, b: str) -> bool:
        return self.mark.get((a, b)) == "-" and self.mark.get((b, a)) == "-"

    def orient(self, a: str, b: str) -> None:
        self.connect(a, b, "-", ">")

    def edges(self) -> list[tuple[str, str, str]]:
        """(a, edge as text, b)."""
        text = {"-": "-", ">": "<", "o": "o"}
        out = []
        for i, a in enumerate(self.nodes):
            for b in self.nodes[i + 1 :]:
                if (a, b) in self.mark:
                    out.append((a, f"{text[self.mark[b, a]]}-{self.mark[a, b]}", b))
        return out

    def copy(self) -> Mixed:
        g = Mixed(self.nodes)
        g.mark = dict(self.mark)
        return g

    def skeleton(self) -> set[frozenset[str]]:
        return {frozenset(p) for p in self.mark}

    def meek(self) -> Mixed:
        """Closes the orientation under Meek's four rules."""
        changed = True
        while changed:
            changed = False
            for a in self.nodes:
                for b in self.nodes:
                    if not self.undirected(a, b):
                        continue
                    others = [c for c in self.nodes if c not in (a, b)]
                    one = any(self.directed(c, a) and not self.adjacent(c, b) for c in others)
                    two = any(self.directed(a, c) and self.directed(c, b) for c in others)
                    into = [c for c in others if self.undirected(a, c) and self.directed(c, b)]
                    three = any(not self.adjacent(c, d) for c, d in combinations(into, 2))
                    four = any(self.undirected(a, c) and self.directed(c, d) and self.directed(d, b) and not self.adjacent(c, b) and self.adjacent(a, d) for c in others for d in others if c != d)
                    if one or two or three or four:
                        self.orient(a, b)
                        changed = True
        return self

    def dags(self, most: int = 1000) -> Iterator[Dag]:
        """DAGs of the class a CPDAG stands for: acyclic, with no new unshielded collider."""
        count = 0
        stack = [self.copy()]
        colliders = self._colliders()
        while stack and count < most:
            g = stack.pop()
            open_edge = next(((a, b) for a in g.nodes for b in g.nodes if g.undirected(a, b)), None)
            if open_edge is None:
                try:
                    dag = Dag(g.nodes, [(a, b) for a in g.nodes for b in g.nodes if g.directed(a, b)])
                except GraphError:
                    continue
                if g._colliders() == colliders:
                    count += 1
                    yield dag
                continue
            for a, b in (open_edge, open_edge[::-1]):
                h = g.copy()
                h.orient(a, b)
                stack.append(h.meek())

    def _colliders(self) -> set[tuple[frozenset[str], str]]:
        return {
            (frozenset((a, b)), c)
            for c in self.nodes
            for a, b in combinations(self.nodes, 2)
            if self.directed(a, c) and self.directed(b, c) and not self.adjacent(a, b)
        }

    @classmethod
    def from_dag(cls, dag: Dag) -> Mixed:
        """The CPDAG of a DAG."""
        g = cls(dag.nodes)
        for a, b in dag.edges:
            g.connect(a, b, "-", "-")
        for c in dag.nodes:
            for a, b in combinations(sorted(dag.parents[c]), 2):
                if not g.adjacent(a, b):
                    g.orient(a, c)
                    g.orient(b, c)
        return g.meek()


def unfold(template: Iterable[tuple[str, int, str]], steps: int) -> Dag:
    """A finite DAG ``name@t`` of a stationary template of (cause, lag, effect)."""
    template = list(template)
    names = list(dict.fromkeys(n for a, _, b in template for n in (a, b)))
    g = Dag(f"{n}@{t}" for t in range(steps) for n in names)
    for a, lag, b in template:
        if lag < 0:
            raise GraphError("a cause cannot follow its effect")
        for t in range(lag, steps):
            g.add_edge(f"{a}@{t - lag}", f"{b}@{t}")
    return g
