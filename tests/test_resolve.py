"""Exports through re-exports and targets of calls on random module graphs, against plain Python."""

from __future__ import annotations

import random

import pytest


def plain_exports(own: dict, links: list[tuple]) -> dict:
    """Round by round, as the operator's docstring has it."""
    known = {(m, n): (m, n) for m, names in own.items() for n in names}
    fresh = dict(known)
    while fresh:
        found: dict = {}
        for to, target, wanted, local in links:
            if to == target:
                continue
            for (m, n), origin in fresh.items():
                if m == target and (n == wanted if wanted != "*" else n != "default"):
                    key = (to, n if wanted == "*" else local)
                    if key not in known:
                        found[key] = min(found.get(key, (9,)), (int(wanted == "*"), *origin))
        fresh = {k: v[1:] for k, v in found.items()}
        known |= fresh
    return known


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    from loomwright.operators.resolve import exports, targets

    rng = random.Random(seed)
    modules, names = [f"m{k}" for k in range(14)], ["a", "b", "c", "d", "default", "e"]
    own = {m: set(rng.sample(names, rng.randint(0, 2))) for m in modules}
    links = [(rng.choice(modules), rng.choice(modules), *rng.choice([("*", "*"), ("*", "*"), ("a", "a"), ("b", "z"), ("default", "c")])) for _ in range(24)]
    held = spark.createDataFrame([(m, n) for m, ns in own.items() for n in ns], "module string, name string")
    given = exports(held, spark.createDataFrame(links, "module string, target string, name string, local string"))
    want = plain_exports(own, links)
    assert {(r["module"], r["name"]): (r["origin"], r["origin_name"]) for r in given.collect()} == want

    imports, taken = [], set()
    for _ in range(40):
        m, target, (name, local) = rng.choice(modules), rng.choice(modules), rng.choice([("a", "a"), ("b", "q"), ("default", "d"), ("*", "ns"), ("gone", "gone")])
        if (m, local) not in taken:
            taken.add((m, local))
            imports.append((m, target, name, local))
    calls = [(m, c) for m in modules for c in ("a", "q", "d", "ns.a", "ns.gone", "ns.x.b", "gone", "other.a", "stored", "nowhere")]
    stored = [("s1", "stored"), ("s0", "stored"), ("s0", "a")]
    got = targets(spark.createDataFrame(calls, "module string, callee string"), held, spark.createDataFrame(imports, "module string, target string, name string, local string"), given, spark.createDataFrame(stored, "module string, name string"))
    index: dict = {}
    for rank, m, n in sorted([(0, m, n) for m, ns in own.items() for n in ns] + [(1, m, n) for m, n in stored]):
        index.setdefault(n, m)
    of = {(m, local): (target, name) for m, target, name, local in imports}
    for r in got.collect():
        m, steps = r["module"], r["callee"].split(".")
        root, last = steps[0], steps[-1]
        target, name = of.get((m, root), (None, None))
        wanted = (last if len(steps) > 1 else None) if name == "*" else (name if len(steps) == 1 else None)
        if len(steps) == 1 and root in own[m]:
            expect = (m, root, "local")
        elif wanted and (target, wanted) in want:
            expect = (*want[target, wanted], "namespace" if name == "*" else "import")
        elif wanted and name == "*" and last in index:
            expect = (index[last], last, "global")
        elif wanted:
            expect = (target, wanted, "assumed")
        elif last in index:
            expect = (index[last], last, "global")
        else:
            expect = (None, None, None)
        assert (r["target_module"], r["target"], r["found"]) == expect, r


def test_a_circle_of_stars_ends(spark):
    from loomwright.operators.resolve import exports

    held = spark.createDataFrame([("c", "x"), ("a", "default")], "module string, name string")
    links = spark.createDataFrame([("a", "b", "*", "*"), ("b", "c", "*", "*"), ("c", "a", "*", "*"), ("a", "a", "*", "*")], "module string, target string, name string, local string")
    got = {(r["module"], r["name"], r["origin"]) for r in exports(held, links).collect()}
    assert got == {("c", "x", "c"), ("b", "x", "c"), ("a", "x", "c"), ("a", "default", "a")}
