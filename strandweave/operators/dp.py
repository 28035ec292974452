"""Dynamic programs over the haplotype graph, path recovery and certificates."""

from __future__ import annotations

import math
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np

from .expanded import AnchorSpan, HapGraph

NEVER = -(1 << 29)
ELBOW_DEGREES = 5.0


@dataclass
class Haploid:
    value: list[int]  # best score for each budget
    distinct: list[int]  # distinct colours on each budget's path
    ratio: list[float]  # average occurrences of a colour on it
    best_r: int
    path: list[int]  # input vertices


def elbow(distinct: list[int], degrees: float = ELBOW_DEGREES) -> int:
    """First budget whose gain falls under the angle; 0 if none does or nothing changes."""
    gain = [b - a for a, b in zip(distinct, distinct[1:], strict=False)]
    top = max((abs(x) for x in gain), default=0)
    if not top:
        return 0
    return next((r for r, x in enumerate(gain) if math.degrees(math.atan(x / top)) < degrees), 0)


def path_colours(colours) -> Counter:
    """How often each colour occurs on a path of coloured nodes."""
    return Counter(c for own in colours for c in own)


def haploid(g: HapGraph, budget: int, full_path: bool = False) -> Haploid:
    """Most colours with at most r switches, r = 0 .. budget; nodes are in topological order.

    Colours count once for each node. A path starts at the predecessor of its
    first coloured node, or at the source with ``full_path``.
    """
    n = len(g.out)
    # One row a node, one column a budget.
    score = np.zeros((n, budget + 1), np.int64)
    if full_path:
        score[:] = NEVER
        score[g.source] = 0
    via = np.full((n, budget + 1), -1)
    spent = np.zeros((n, budget + 1), np.int64)
    for u, row in enumerate(g.out):
        for v, w in row:
            if w > budget:
                continue
            gain = score[u, : budget + 1 - w] + len(g.colors[v])
            better = gain > score[v, w:]
            score[v, w:][better] = gain[better]
            via[v, w:][better] = u
            spent[v, w:][better] = w

    def back(r: int) -> list[int]:
        v, path = n - 1, []
        while v != -1:
            path.append(v)
            v, r = int(via[v, r]), r - int(spent[v, r])
        return path[::-1]

    seen = [path_colours(g.colors[x] for x in back(r)) for r in range(budget + 1)]
    distinct = [len(c) for c in seen]
    best = elbow(distinct)
    path = list(dict.fromkeys(v for x in back(best) for v in g.orig[x]))
    return Haploid(score[n - 1].tolist(), distinct, [sum(c.values()) / len(c) if c else math.nan for c in seen], best, path)


@dataclass
class Diploid:
    value: list[int]  # best score for each budget; NEVER if out of reach
    s_het: int
    paths: tuple[list[int], list[int]]  # nodes, one a level


CELLS = 1 << 22  # pairs of edges that are scored at a time


class _Level:
    """Edges out of one level as arrays, and the scores of pairs of them."""

    def __init__(self, g: HapGraph, here: list[int], there: list[int], hom: list[bool], mode: str):
        at = {v: i for i, v in enumerate(there)}
        edges = [(i, at[v], w) for i, u in enumerate(here) for v, w in g.out[u]]
        self.src, self.dst, self.w = (np.array(c, np.int64) for c in zip(*edges, strict=True))
        self.mode = mode
        code = {c: k for k, c in enumerate(sorted({c for x in (*here, *there) for c in g.colors[x]}))}
        words = max(1, -(-len(code) // 64))

        def bits(nodes: list[int], kind: bool) -> np.ndarray:
            out = np.zeros((len(nodes), words), np.uint64)
            for i, x in enumerate(nodes):
                for c in g.colors[x]:
                    if hom[c] == kind:
                        out[i, code[c] // 64] |= np.uint64(1 << code[c] % 64)
            return out

        self.h1, self.h2, self.t1, self.t2 = bits(here, True), bits(there, True), bits(here, False), bits(there, False)

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One-copy part and whole score of edges ``a`` (rows) with edges ``b`` (columns)."""
        size = lambda x: np.bitwise_count(x).sum(axis=-1, dtype=np.int64)
        over = lambda x, at, op: op(x[at[a]][:, None], x[at[b]][None])
        if self.mode == "cross_path":
            het = size(over(self.t2, self.dst, np.bitwise_xor))
            return het, het + size(over(self.h2, self.dst, np.bitwise_and))
        het = size(over(self.t1, self.src, np.bitwise_or) ^ over(self.t2, self.dst, np.bitwise_or))
        return het, het + size(over(self.h1, self.src, np.bitwise_or) & over(self.h2, self.dst, np.bitwise_or))


def _step(lv: _Level, value: np.ndarray, width: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Next level's values and, for each cell, the edge pair it came by.

    Ties go to the smaller first predecessor, then the smaller second one, then
    the earlier edges. Pairs are scored ``cells`` at a time.
    """
    budget, k, e = value.shape[0] - 1, value.shape[1], len(lv.src)
    none, last = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    best = np.full((budget + 1, width * width), none)
    tie = np.full((budget + 1, width * width, 2), last)  # predecessors, then edges
    every = np.arange(e)
    for low in range(0, e, max(1, cells // e)):
        rows = every[low : low + max(1, cells // e)]
        _, delta = lv.scores(rows, every)
        to = lv.dst[rows][:, None] * width + lv.dst[None]
        cost = lv.w[rows][:, None] + lv.w[None]
        before = lv.src[rows][:, None] * k + lv.src[None]
        pair = rows[:, None] * e + every[None]
        for r in range(budget + 1):
            from_ = value[r][np.ix_(lv.src[rows], lv.src)]
            for c in np.unique(cost):
                use = (cost == c) & (from_ > NEVER)
                if r + c > budget or not use.any():
                    continue
                at, score = to[use], from_[use] + delta[use]
                top, mark = best[r + c], tie[r + c]
                old = top.copy()
                np.maximum.at(top, at, score)
                mark[top > old] = last
                win = score == top[at]
                at, first, second = at[win], before[use][win], pair[use][win]
                order = np.lexsort((second, first, at))
                at, first, second = at[order], first[order], second[order]
                new = np.concatenate(([True], at[1:] != at[:-1]))[: len(at)]
                at, first, second = at[new], first[new], second[new]
                less = (first < mark[at, 0]) | ((first == mark[at, 0]) & (second < mark[at, 1]))
                mark[at[less]] = np.stack([first, second], axis=1)[less]
    gone = best == none
    shape = (budget + 1, width, width)
    return np.where(gone, NEVER, best).reshape(shape), np.where(gone, -1, tie[:, :, 1]).reshape(shape)


def diploid(g: HapGraph, budget: int, hom: list[bool], mode: str = "as_coded", cells: int = CELLS) -> Diploid:
    """Best ordered pair of paths, both together within the budget of switches.

    ``as_coded`` scores a step by comparing the union of both paths' colours at
    consecutive levels: shared two-copy colours plus one-copy colours on one
    side only. ``cross_path`` scores two-copy colours on both paths and one-copy
    colours on exactly one. Values are kept at every sqrt(L)-th level only; the
    blocks between are computed again on the way back.
    """
    top = max(g.level)
    rows: list[list[int]] = [[] for _ in range(top + 1)]
    for x, lv in enumerate(g.level):
        rows[lv].append(x)
    if rows[top] != [g.sink]:
        raise ValueError("the sink is not alone on the last level")
    value = np.zeros((budget + 1, len(rows[0]), len(rows[0])), np.int64)
    block = max(1, math.isqrt(top))
    kept = {0: value}
    for lv in range(top):
        value, _ = _step(_Level(g, rows[lv], rows[lv + 1], hom, mode), value, len(rows[lv + 1]), cells)
        if (lv + 1) % block == 0:
            kept[lv + 1] = value
    ends = [int(x) for x in value[:, 0, 0]]
    if ends[budget] <= NEVER:
        return Diploid(ends, 0, ([], []))

    r, i, j, s_het = budget, 0, 0, 0
    one, two = [g.sink], [g.sink]
    for start in range((top - 1) // block * block, -1, -block):
        levels, state = [], kept[start]
        for lv in range(start, min(start + block, top)):
            lev = _Level(g, rows[lv], rows[lv + 1], hom, mode)
            state, pair = _step(lev, state, len(rows[lv + 1]), cells)
            levels.append((lv, lev, pair))
        for lv, lev, pair in reversed(levels):
            a, b = divmod(int(pair[r, i, j]), len(lev.src))
            s_het += int(lev.scores(np.array([a]), np.array([b]))[0][0, 0])
            r -= int(lev.w[a] + lev.w[b])
            i, j = int(lev.src[a]), int(lev.src[b])
            one.append(rows[lv][i])
            two.append(rows[lv][j])
    return Diploid(ends, s_het, (one[::-1], two[::-1]))


@dataclass
class Segment:
    """A stretch of one haplotype: input vertices first .. last."""

    hap: int
    first: int
    last: int


def recover(g: HapGraph, nodes: list[int], starts: dict[int, int]) -> list[Segment]:
    """Haplotype stretches of a node path. ``starts`` has each haplotype's first vertex.

    A stretch ends at the tail of a switch; the next one starts at the first
    copy of its own haplotype that weight-0 edges reach from the switch.
    """
    hops = [(u, v) for u, v in zip(nodes, nodes[1:], strict=False) if min((w for x, w in g.out[u] if x == v), default=0) > 0]
    hops.append((nodes[-2], nodes[-1]))
    out, begin = [], None
    for k, (u, v) in enumerate(hops):
        if len(g.orig[u]) != 1 or g.hap[u] < 0:
            raise ValueError("a path leaves a haplotype from a node that is no copy")
        h = g.hap[u]
        out.append(Segment(h, starts[h] if begin is None else begin, g.orig[u][0]))
        if k + 1 < len(hops):
            found = _next_copy(g, v, g.hap[hops[k + 1][0]])
            begin = g.orig[found][0] if found is not None else begin
    return out


def _next_copy(g: HapGraph, at: int, hap: int) -> int | None:
    queue, seen = deque([at]), {at}
    while queue:
        u = queue.popleft()
        if g.hap[u] == hap and g.orig[u]:
            return u
        for v, w in g.out[u]:
            if not w and v not in seen:
                seen.add(v)
                queue.append(v)
    return None


def stretch(path: list[int], s: Segment) -> list[int]:
    """Input vertices of a stretch; to the end of the walk if the last one is not met."""
    if s.first not in path:
        return []
    a = path.index(s.first)
    b = path.index(s.last, a) if s.last in path[a:] else len(path) - 1
    return path[a : b + 1]


def colours_inside(spans: list[AnchorSpan], segments: list[Segment]) -> Counter:
    """Colours of anchors strictly inside the stretches, by vertex ids, with counts."""
    return Counter(c for s in segments for a in spans if a.hap == s.hap and a.first > s.first and a.last < s.last for c in a.colors)


def certificate(one: Counter, two: Counter, hom: list[bool], s_het: int) -> dict:
    """Objective and approximation factor of a pair of paths; None where it divides by zero."""
    shared = [c for c in one if hom[c] and c in two]
    single = [c for c in set(one) ^ set(two) if not hom[c]]
    m_hom = sum(max(one[c], two[c]) for c in shared) / len(shared) if shared else None
    sum_het = sum(one[c] + two[c] for c in single)
    m_het = sum_het / len(single) if single else None
    obj = len(shared) + len(single)
    factor = None
    if m_het and obj:
        m = max(x for x in (m_hom, m_het) if x is not None)
        factor = m * (obj + (s_het - sum_het) / m_het) / obj
    return {"objective": obj, "m_hom": m_hom, "m_het": m_het, "factor": factor}
