"""Haplotype graph: one copy of a vertex for each walk, recombination and anchor nodes.

The graph of one sample is built and levelled inside one task (samples run in
parallel); it is linear in the walks thanks to one recombination node for each
graph edge instead of one edge for each pair of haplotypes.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import numpy as np


@dataclass
class HapGraph:
    hap: list[int] = field(default_factory=list)  # -1: recombination or super-node
    orig: list[list[int]] = field(default_factory=list)  # vertices of the input graph
    colors: list[list[int]] = field(default_factory=list)
    out: list[list[tuple[int, int]]] = field(default_factory=list)  # (target, weight)
    level: list[int] = field(default_factory=list)
    source: int = 0
    sink: int = 1

    def node(self, hap: int, orig: list[int]) -> int:
        self.hap.append(hap)
        self.orig.append(orig)
        self.colors.append([])
        self.out.append([])
        return len(self.hap) - 1

    def edges(self) -> list[tuple[int, int, int]]:
        return [(u, v, w) for u, row in enumerate(self.out) for v, w in row]

    def take(self, order: list[int]) -> HapGraph:
        """The same graph with ``order[i]`` as node i."""
        new = {old: i for i, old in enumerate(order)}
        g = HapGraph(source=new[self.source], sink=new[self.sink])
        g.hap = [self.hap[u] for u in order]
        g.orig = [self.orig[u] for u in order]
        g.colors = [self.colors[u] for u in order]
        g.out = [[(new[v], w) for v, w in self.out[u]] for u in order]
        g.level = [self.level[u] for u in order] if self.level else []
        return g


@dataclass
class AnchorSpan:
    """An anchor on one haplotype, as an interval of copies."""

    hap: int
    first: int  # input vertices
    last: int
    low: int  # copies
    high: int
    node: int
    colors: list[int]


def expand(paths: list[list[int]], adjacency: dict[int, list[int]], anchors: list[tuple[int, int, list[int]]]) -> tuple[HapGraph, list[AnchorSpan], list[int]]:
    """(graph, anchors in sweep order, key of every colour).

    ``anchors`` are (minimizer id, haplotype, vertices) sorted by minimizer and
    haplotype; each minimizer becomes one colour.
    """
    g = HapGraph()
    g.source = g.node(0, [])
    copy: list[dict[int, int]] = []
    for h, path in enumerate(paths):
        here = {}
        for v in path:
            here[v] = g.node(h, [v])
        copy.append(here)
    g.sink = g.node(0, [])
    first = 1
    for path in paths:
        if path:
            g.out[g.source].append((first, 0))
            for at in range(first, first + len(path) - 1):
                g.out[at].append((at + 1, 0))
            g.out[first + len(path) - 1].append((g.sink, 0))
        first += len(path)

    on: dict[int, list[int]] = {}
    for h, here in enumerate(copy):
        for v, node in here.items():
            on.setdefault(v, []).append(node)
    switch: dict[tuple[int, int], int] = {}
    for h, path in enumerate(paths):
        for u, follow in zip(path, [*path[1:], None], strict=True):
            for slot, v in enumerate(adjacency.get(u, ())):
                if v == follow or v not in on:  # a switch to a vertex on no walk is a dead end
                    continue
                if (u, slot) not in switch:
                    switch[u, slot] = x = g.node(-1, [])
                    g.out[x] = [(node, 0) for node in on[v]]
                g.out[copy[h][u]].append((switch[u, slot], 1))

    spans: list[list[AnchorSpan]] = [[] for _ in paths]
    keys: list[int] = []
    for mid, h, vtxs in anchors:
        if not vtxs:
            continue
        if not keys or keys[-1] != mid:
            keys.append(mid)
        low, high = copy[h][vtxs[0]], copy[h][vtxs[-1]]
        node = low
        if low != high:
            node = g.node(-1, list(vtxs))
            g.out[low].append((node, 0))
            g.out[node].append((high, 0))
        spans[h].append(AnchorSpan(h, vtxs[0], vtxs[-1], low, high, node, [len(keys) - 1]))
    for row in spans:
        _sweep(g, row)
    for x in range(len(g.colors)):
        g.colors[x] = sorted(set(g.colors[x]))
    return g, [a for row in spans for a in row], keys


def _sweep(g: HapGraph, row: list[AnchorSpan]) -> None:
    """Link touching anchors; colours pass to the nearest run of anchors that contain them."""
    row.sort(key=lambda a: (a.low, a.high))
    open_: list[AnchorSpan] = []
    for a in row:
        while open_ and open_[-1].high < a.low:
            open_.pop()
        if open_ and open_[-1].node != a.node:
            g.out[open_[-1].node].append((a.node, 0))
        for outer in reversed(open_):
            if a.high > outer.high:
                break
            outer.colors.extend(c for c in a.colors if c not in outer.colors)
        open_.append(a)
    for a in row:
        g.colors[a.node].extend(a.colors)


def topological(g: HapGraph) -> HapGraph:
    """Nodes in first-in-first-out topological order, the sink last; a cycle is an error."""
    left = [0] * len(g.out)
    for _, v, _ in g.edges():
        left[v] += 1
    queue, order = deque(u for u, n in enumerate(left) if n == 0), []
    while queue:
        u = queue.popleft()
        order.append(u)
        for v, _ in g.out[u]:
            left[v] -= 1
            if not left[v]:
                queue.append(v)
    if len(order) != len(left):
        raise ValueError("the haplotype graph has a cycle")
    order.remove(g.sink)
    return g.take([*order, g.sink])


def levelize(g: HapGraph) -> HapGraph:
    """Level = longest path from the source; edges span one level each.

    An edge over several levels gets a chain of dummies that inherit its tail's
    haplotype and vertices but no colours; its weight stays on the first hop.
    """
    into = [0] * len(g.out)
    for _, v, _ in g.edges():
        into[v] += 1
    if sum(1 for u, n in enumerate(into) if n == 0 and g.out[u]) > 1:
        raise ValueError("the haplotype graph has several sources")
    g = topological(g)
    level = [0] * len(g.out)
    for u, row in enumerate(g.out):
        for v, _ in row:
            level[v] = max(level[v], level[u] + 1)
    wide = HapGraph(list(g.hap), [list(x) for x in g.orig], [list(x) for x in g.colors], [[] for _ in g.out], level, g.source, g.sink)
    for u, v, w in g.edges():
        at = u
        for step in range(level[u] + 1, level[v]):
            x = wide.node(g.hap[u], list(g.orig[u]))
            wide.level.append(step)
            wide.out[at].append((x, w))
            at, w = x, 0
        wide.out[at].append((v, w))
    return wide.take(sorted(range(len(wide.out)), key=lambda x: (wide.level[x], x)))


def widths(g: HapGraph) -> np.ndarray:
    return np.bincount(g.level)


def compact(g: HapGraph) -> HapGraph:
    """Merge chains of weight-0 edges between uncoloured nodes with one way in and out."""
    into = [0] * len(g.out)
    for _, v, _ in g.edges():
        into[v] += 1
    head: dict[int, int] = {}
    for u in range(len(g.out)):
        if len(g.out[u]) == 1:
            v, w = g.out[u][0]
            if w == 0 and into[v] == 1 and v != g.sink and u != g.source and g.hap[u] == g.hap[v] and not g.colors[u] and not g.colors[v]:
                head[v] = u
    find = lambda x: find(head[x]) if x in head else x
    out = HapGraph(list(g.hap), [list(x) for x in g.orig], [list(x) for x in g.colors], [list(x) for x in g.out], [], g.source, g.sink)
    for v in sorted(head):
        out.orig[find(v)].extend(g.orig[v])
    tails = set(head.values())
    for v in head:
        if v not in tails:
            out.out[find(v)] = list(g.out[v])
    return out.take([u for u in range(len(g.out)) if u not in head])


def bridges(g: HapGraph) -> list[tuple[int, int]]:
    """Edges whose removal disconnects the undirected graph, without recursion."""
    near: list[list[tuple[int, int]]] = [[] for _ in g.out]
    for k, (u, v, _) in enumerate(g.edges()):
        near[u].append((v, k))
        near[v].append((u, k))
    found, seen, low, clock = [], {}, {}, 0
    for root in range(len(near)):
        if root in seen:
            continue
        seen[root] = low[root] = clock = clock + 1
        stack = [(root, -1, iter(near[root]))]
        while stack:
            u, by, it = stack[-1]
            for v, k in it:
                if k == by:
                    continue
                if v in seen:
                    low[u] = min(low[u], seen[v])
                else:
                    seen[v] = low[v] = clock = clock + 1
                    stack.append((v, k, iter(near[v])))
                    break
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[u])
                    if low[u] > seen[p]:
                        found.append((min(p, u), max(p, u)))
    return sorted(found)
