"""Graphviz texts of proofs and of attack graphs."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from breachline.operators.provenance import Tree

# How facts and rules are drawn.
_GRAPH = '    graph [rankdir=BT, bgcolor="white", splines=ortho, nodesep=0.45, ranksep=0.7];\n    node [fontname="Helvetica", fontsize=11, margin="0.08,0.05"];\n    edge [fontname="Helvetica", fontsize=9, color="#4b5563", arrowsize=0.7];\n'
_TARGET = 'shape=box, style="rounded,filled,bold", fillcolor="#fecaca", color="#dc2626", penwidth=2.5'
_DERIVED = 'shape=box, style="rounded,filled", fillcolor="#dbeafe", color="#2563eb"'
_BASE = 'shape=box, style="rounded,filled", fillcolor="#f3f4f6", color="#9ca3af"'
_RULE = 'shape=diamond, style="filled", fillcolor="#fff7ed", color="#ea580c"'


def _quoted(text: str) -> str:
    return text.translate({ord("\\"): "\\\\", ord('"'): '\\"', ord("\n"): "\\n"})


def proof_dot(tree: Tree) -> str:
    """A proof as a graph from premises up to the fact; nodes are numbered in preorder."""
    nodes, edges = [], []
    count = iter(range(1 << 62))

    def draw(t: Tree, style: str) -> str:
        me = f"fact_{next(count)}"
        nodes.append(f'    {me} [{style}, label="{_quoted(str(t))}"];\n')
        if t.rule is not None:
            rule = f"rule_{next(count)}"
            nodes.append(f'    {rule} [{_RULE}, label="{_quoted(t.rule)}"];\n')
            edges.append(f"    {rule} -> {me} [penwidth=1.7];\n")
            for child in t.children:
                edges.append(f"    {draw(child, _DERIVED if child.rule else _BASE)} -> {rule};\n")
        return me

    root = draw(tree, _TARGET)
    return f"digraph ExplanationTree {{\n{_GRAPH}\n{''.join(nodes)}\n{''.join(edges)}\n    {{ rank=max; {root}; }}\n}}\n"


def write_proof(tree: Tree, path: str) -> None:
    Path(path).write_text(proof_dot(tree), encoding="utf-8")


def state_dot(edges: DataFrame, compromised: DataFrame, start: str, target: str, title: str) -> str:
    """The network (source_host, destination_host, service_name) with compromised hosts (host) marked, in sorted order."""
    routes = sorted(tuple(r) for r in edges.select("source_host", "destination_host", "service_name").distinct().collect())
    taken = {r[0] for r in compromised.select("host").distinct().collect()}
    out = ["digraph AttackGraph {", f'    label="{_quoted(title)}";', '    labelloc="t";', "    fontsize=20;", "    rankdir=LR;", "    node [shape=box, style=filled];", ""]
    for host in sorted({h for r in routes for h in r[:2]} | taken | {start, target}):
        if host == start:
            look = ("lightblue", " [ATTACKER]")
        elif host == target:
            look = ("red", " [TARGET - COMPROMISED!]") if host in taken else ("lightgreen", " [TARGET - SAFE]")
        else:
            look = ("orange", " [COMPROMISED]") if host in taken else ("white", "")
        out.append(f'    "{_quoted(host)}" [fillcolor={look[0]}, label="{_quoted(host)}{look[1]}"];')
    out.append("")
    for s, d, v in routes:
        color, width = ("red", "2.0") if s in taken and d in taken else ("black", "1.0")
        out.append(f'    "{_quoted(s)}" -> "{_quoted(d)}" [label="{_quoted(v)}", color={color}, penwidth={width}];')
    return "\n".join([*out, "}", ""])
