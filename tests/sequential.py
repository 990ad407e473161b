"""Louvain's method one node after the other, in plain Python: what the distributed form is held against."""

from __future__ import annotations

from collections import defaultdict

LEVELS = 64


def _moved(near: dict[int, dict[int, float]], own: dict[int, float], total: float) -> dict[int, int]:
    """Moves nodes, in order, to the neighbouring community of the largest gain until none moves. own: weighted degrees."""
    at = {n: n for n in near}
    sums = dict(own)
    moving = True
    while moving:
        moving = False
        for n in sorted(near):
            to = defaultdict(float)
            for m, w in near[n].items():
                if m != n:
                    to[at[m]] += w
            here = at[n]
            sums[here] -= own[n]
            gain = lambda c: to[c] - own[n] * sums[c] / total  # noqa: B023, E731
            best, most = here, gain(here)
            for c in sorted(to):
                if gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            sums[best] += own[n]
            if best != here:
                at[n], moving = best, True
    return at


def _split(groups: dict[int, list[int]], near: dict[int, dict[int, float]]) -> dict[int, int]:
    """Communities cut into connected ones, each named by its smallest node."""
    out: dict[int, int] = {}
    for members in groups.values():
        inside = set(members)
        for start in sorted(members):
            if start in out:
                continue
            todo = [start]
            out[start] = start
            while todo:
                for m in near[todo.pop()]:
                    if m in inside and m not in out:
                        out[m] = start
                        todo.append(m)
    return out


def louvain(links: list[tuple[int, int, float]]) -> dict[int, int]:
    """links: undirected, loops left out. The community of each node, named by its smallest node; ties go to the smallest."""
    base: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in links:
        if a != b:
            base[a][b] += w
            base[b][a] += w
    member = {n: n for n in base}
    near = base
    for _ in range(LEVELS):
        own = {n: sum(x.values()) for n, x in near.items()}
        total = sum(own.values())
        at = _moved(near, own, total) if total else {}
        if len(set(at.values())) == len(near):
            break
        member = {n: at[c] for n, c in member.items()}
        merged: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for n, x in near.items():
            for m, w in x.items():
                merged[at[n]][at[m]] += w
        near = merged
    groups = defaultdict(list)
    for n, c in member.items():
        groups[c].append(n)
    return _split(groups, base)
