from __future__ import annotations

from collections import Counter

import numpy as np


def oracle(data: list[tuple], threshold: float = 0.98) -> list[tuple]:
    """data: key, vector, label. By all pairs of rows; rows are told apart by their place."""
    root, links = list(range(len(data))), Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    x = np.array([r[1] for r in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for a, b in np.argwhere(x @ x.T >= threshold):
        if a != b and data[a][2] == data[b][2]:
            links[a] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    low: dict = {}
    for k, r in enumerate(data):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    out = []
    for k, r in enumerate(data):
        c = low.get(find(k))
        out.append((r[0], links[k], c, r[0] == c))
    return sorted(out, key=repr)


def run(spark, data):
    from loomwright.llm.near_vectors import near_vectors

    df = spark.createDataFrame([(k, [float(v) for v in x], y) for k, x, y in data], "vec_id long, embedding array<double>, label int").repartition(5)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()), key=repr)


def test_labels_whose_hashes_are_equal_keep_their_own_cells(spark):
    """hash(-1) equals hash(-2) in Python: both labels are large enough to be cut and lie in one batch."""
    rng = np.random.default_rng(5)
    data = []
    for y in (-1, -2):
        spread = rng.normal(size=(6, 16)) + 3 * (y + 1.5)
        data += [(len(data) + k, spread[k % 6] + rng.normal(size=16) * 0.35, y) for k in range(2200)]
    rng.shuffle(data)
    want = oracle(data)
    assert sum(r[1] for r in want) > 10_000
    assert run(spark, data) == want


def test_repeated_and_null_keys_are_rows_of_their_own(spark):
    x, y = np.eye(4)[0], np.eye(4)[1]
    near = lambda v: v + 0.01 * np.eye(4)[3]
    data = [(5, x, 1), (5, y, 1), (6, near(x), 1), (7, near(y), 1), (None, near(near(x)), 1), (None, np.eye(4)[2], 1), (None, np.eye(4)[2], 1), (5, x, 1)]
    assert run(spark, data) == oracle(data)


def test_very_small_and_large_components(spark):
    rows = [(0, [1e-200, 1e-200], 1), (1, [1.0, 0.1], 1), (2, [2e-200, 2e-200], 1), (3, [1e200, 1e199], 1)]
    got = {r[0]: r[1:3] for r in run(spark, rows)}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 0), 3: (1, 1)}


def test_cells_hold_every_vector_within_reach():
    from loomwright.llm.near_vectors import placed_in

    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    c, x = unit(rng.standard_normal((40, 6))), unit(rng.standard_normal((1500, 6)))
    y = unit(x + 0.05 * rng.standard_normal(x.shape))
    reach = np.linalg.norm(x - y, axis=1)
    pick, cell, home = placed_in(x, c, float(reach.max()))
    held = set(zip(pick.tolist(), cell.tolist(), strict=True))
    assert home.sum() == len(x) and all((k, int(d)) in held for k, d in enumerate((y @ c.T).argmax(axis=1)))
