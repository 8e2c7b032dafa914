"""Graph interchange: DOT, JSON, GML, node-link and adjacency forms, and edge DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from causelake.errors import GraphError
from causelake.graphs.dag import Admg, Dag, Mixed

VERSION = 1


def _build(nodes, directed, bidirected) -> Admg:
    return Admg(nodes, directed, bidirected) if bidirected else Dag(nodes, directed)


def to_dot(g: Admg) -> str:
    quote = lambda n: '"' + n.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"  {quote(n)};" for n in g.nodes]
    lines += [f"  {quote(a)} -> {quote(b)};" for a, b in g.edges]
    lines += [f"  {quote(a)} -> {quote(b)} [dir=both];" for a, b in g.bidirected]
    return "digraph {\n" + "\n".join(lines) + "\n}\n"


_ID = r'(?:"((?:[^"\\]|\\.)*)"|([A-Za-z_0-9.@:]+))'


def from_dot(text: str) -> Admg:
    body = re.search(r"digraph[^{]*\{(.*)\}", text, re.S)
    if not body:
        raise GraphError("not a digraph")
    name = lambda a, b: re.sub(r"\\(.)", r"\1", a) if a is not None else b
    nodes, directed, both = [], [], []
    for line in re.split(r"[;\n]", body.group(1)):
        line = line.strip()
        if not line or line.startswith("//") or re.match(r"(graph|node|edge)\b", line):
            continue
        attributes = line[line.index("[") :] if "[" in line else ""
        parts = [name(*m.groups()) for m in re.finditer(_ID, line.split("[")[0])]
        nodes += parts
        if "->" in line:
            (both if "dir=both" in attributes.replace(" ", "").replace('"', "") else directed).extend(zip(parts, parts[1:]))
        elif "--" in line:
            raise GraphError("an undirected edge needs a mixed graph")
    return _build(dict.fromkeys(nodes), directed, both)


def to_json(g: Admg) -> str:
    return json.dumps({"version": VERSION, "nodes": g.nodes, "directed": g.edges, "bidirected": g.bidirected})


def from_json(text: str) -> Admg:
    d = json.loads(text)
    if d.get("version", VERSION) > VERSION:
        raise GraphError(f"graph document of version {d['version']}")
    return _build(d["nodes"], [tuple(e) for e in d["directed"]], [tuple(e) for e in d.get("bidirected", [])])


def mixed_to_json(g: Mixed) -> str:
    return json.dumps({"version": VERSION, "nodes": g.nodes, "edges": g.edges()})


def mixed_from_json(text: str) -> Mixed:
    d = json.loads(text)
    g = Mixed(d["nodes"])
    for a, e, b in d["edges"]:
        g.connect(a, b, {"<": ">"}.get(e[0], e[0]), e[-1])
    return g


def _gml_text(n: str) -> str:
    return n.replace("&", "&amp;").replace('"', "&quot;")


def _gml_nodes(text: str) -> dict[int, str]:
    return {int(i): n.replace("&quot;", '"').replace("&amp;", "&") for i, n in re.findall(r'node\s*\[\s*id\s+(\d+)\s+label\s+"([^"]*)"\s*\]', text)}


_DOT_MARKS = {"-": "none", ">": "normal", "o": "odot"}


def mixed_to_dot(g: Mixed) -> str:
    """Partial graphs as DOT: the mark at each end is its arrow shape."""
    quote = lambda n: '"' + n.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"  {quote(n)};" for n in g.nodes]
    for a, edge, b in g.edges():
        tail, head = _DOT_MARKS[{"<": ">"}.get(edge[0], edge[0])], _DOT_MARKS[edge[-1]]
        lines.append(f"  {quote(a)} -> {quote(b)} [dir=both, arrowtail={tail}, arrowhead={head}];")
    return "digraph {\n" + "\n".join(lines) + "\n}\n"


def mixed_from_dot(text: str) -> Mixed:
    """Partial graphs from DOT: shapes at both ends where given, ``->`` a directed edge, ``--`` an undirected one."""
    body = re.search(r"graph[^{]*\{(.*)\}", text, re.S)
    if not body:
        raise GraphError("not a graph")
    shapes = {v: k for k, v in _DOT_MARKS.items()}
    name = lambda a, b: re.sub(r"\\(.)", r"\1", a) if a is not None else b
    nodes, edges = [], []
    for line in re.split(r"[;\n]", body.group(1)):
        line = line.strip()
        if not line or line.startswith("//") or re.match(r"(graph|node|edge)\b", line):
            continue
        head, _, attributes = line.partition("[")
        parts = [name(*m.groups()) for m in re.finditer(_ID, head.replace("--", " -- "))]
        nodes += parts
        given = dict(re.findall(r"(dir|arrowtail|arrowhead)\s*=\s*\"?(\w+)", attributes))
        if "->" in head or "--" in head:
            plain = "-" if "--" in head else ">"
            at_a, at_b = shapes.get(given.get("arrowtail"), ">" if given.get("dir") == "both" else "-"), shapes.get(given.get("arrowhead"), plain)
            edges += [(a, b, at_a, at_b) for a, b in zip(parts, parts[1:])]
    g = Mixed(dict.fromkeys(nodes))
    for a, b, at_a, at_b in edges:
        g.connect(a, b, at_a, at_b)
    return g


def mixed_to_gml(g: Mixed) -> str:
    at = {n: i for i, n in enumerate(g.nodes)}
    out = ["graph [", "  directed 1", *[f'  node [ id {i} label "{_gml_text(n)}" ]' for n, i in at.items()]]
    out += [f'  edge [ source {at[a]} target {at[b]} marks "{ {"<": ">"}.get(e[0], e[0]) }{e[-1]}" ]' for a, e, b in g.edges()]
    return "\n".join([*out, "]"]) + "\n"


def mixed_from_gml(text: str) -> Mixed:
    names = _gml_nodes(text)
    g = Mixed(names.values())
    for a, b, marks in re.findall(r'edge\s*\[\s*source\s+(\d+)\s+target\s+(\d+)\s+marks\s+"([->o]{2})"\s*\]', text):
        g.connect(names[int(a)], names[int(b)], *marks)
    return g


def to_gml(g: Admg) -> str:
    at = {n: i for i, n in enumerate(g.nodes)}
    out = ["graph [", "  directed 1"]
    out += [f'  node [ id {i} label "{_gml_text(n)}" ]' for n, i in at.items()]
    out += [f"  edge [ source {at[a]} target {at[b]} ]" for a, b in g.edges]
    out += [f'  edge [ source {at[a]} target {at[b]} kind "bidirected" ]' for a, b in g.bidirected]
    return "\n".join([*out, "]"]) + "\n"


def from_gml(text: str) -> Admg:
    names = _gml_nodes(text)
    directed, both = [], []
    for a, b, rest in re.findall(r"edge\s*\[\s*source\s+(\d+)\s+target\s+(\d+)([^\]]*)\]", text):
        (both if "bidirected" in rest else directed).append((names[int(a)], names[int(b)]))
    return _build(names.values(), directed, both)


def to_node_link(g: Admg) -> dict:
    links = [{"source": a, "target": b} for a, b in g.edges] + [{"source": a, "target": b, "kind": "bidirected"} for a, b in g.bidirected]
    return {"directed": True, "multigraph": False, "graph": {}, "nodes": [{"id": n} for n in g.nodes], "links": links}


def from_node_link(d: Mapping) -> Admg:
    links = d.get("links", d.get("edges", []))
    kind = lambda e: e.get("kind") == "bidirected"
    return _build([n["id"] for n in d["nodes"]], [(e["source"], e["target"]) for e in links if not kind(e)], [(e["source"], e["target"]) for e in links if kind(e)])


def to_adjacency(g: Admg) -> dict[str, list[str]]:
    return {n: sorted(g.children[n]) for n in g.nodes}


def from_adjacency(d: Mapping[str, list[str]]) -> Dag:
    return Dag(d, [(a, b) for a, bs in d.items() for b in bs])


def edge_frame(spark: SparkSession, g: Admg) -> DataFrame:
    rows = [(a, b, "directed") for a, b in g.edges] + [(a, b, "bidirected") for a, b in g.bidirected]
    return spark.createDataFrame(rows, "src string, dst string, kind string")


def from_edge_frame(df: DataFrame) -> Admg:
    rows = df.collect()
    return _build([], [(r["src"], r["dst"]) for r in rows if r["kind"] == "directed"], [(r["src"], r["dst"]) for r in rows if r["kind"] == "bidirected"])
