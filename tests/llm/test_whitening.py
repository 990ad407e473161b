"""Operator 13 against one plain decomposition of the whole fit list."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest


def oracle(rows: list[tuple], components: int = 16) -> dict:
    """rows: key, vector. Per row's place: the values of each component, by a centred covariance in double precision."""
    xs = {}
    for k, (_, v) in enumerate(rows):
        if v is not None and all(c is not None and math.isfinite(c) for c in v) and len(v):
            xs[k] = tuple(math.floor(64 * c) + 1_000_000 for c in v)
    out = {}
    for d in {len(x) for x in xs.values()}:
        fit = np.array(sorted({x for x in xs.values() if len(x) == d}), dtype=object)
        n, sums = len(fit), fit.sum(axis=0)
        centred = ((fit * n - sums) / n).astype(float)
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        order = np.argsort(-values)
        for k, x in xs.items():
            if len(x) == d:
                off = np.array(x, dtype=object) * n - sums
                white = (off / n).astype(float) @ vectors[:, order[:components]]
                out[k] = (n, int((off * off).sum()), white, values[order], values.sum())
    return out


def run(spark, rows: list[tuple], parts: int = 9) -> dict:
    from loomwright.llm.whitening import whiten

    df = spark.createDataFrame([(k, [None if c is None else float(c) for c in v] if v is not None else None, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, x string, dims int").repartition(parts)
    found = defaultdict(list)
    for r in whiten(df).collect():
        found[r["vec_id"]].append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in found.items()}


def compare(got: dict, rows: list[tuple], components: int = 16) -> None:
    want = oracle(rows, components)
    assert set(got) == {rows[k][0] for k in want}
    by_length: dict = {}
    for k, (n, deviation, white, values, trace) in want.items():
        mine = got[rows[k][0]]
        d = len(rows[k][1])
        assert [r["component"] for r in mine] == list(range(1, min(components, d) + 1))
        for j, r in enumerate(mine):
            assert r["n"] == n and r["deviation"] == deviation
            assert r["explained"] == pytest.approx(values[j] / trace, rel=1e-8, abs=1e-12)
            if values[j] > 1e-9 * values[0]:
                ratio = r["whitened"] / (white[j] / math.sqrt(values[j])) if abs(white[j]) > 1e-3 else None
                if ratio is not None:  # either sign, but the same for all rows
                    assert abs(ratio) == pytest.approx(1, rel=1e-6)
                    assert by_length.setdefault((d, j), np.sign(ratio)) == np.sign(ratio)
            else:
                assert r["whitened"] is None
            assert r["identity_error"] < 1e-9


def test_merges_lose_nothing(spark):
    rng = np.random.default_rng(3)
    spread = np.geomspace(40, 0.4, 24)
    rows = [(k, (rng.standard_normal(24) * spread + 3000).tolist()) for k in range(900)]
    rows += [(2000 + k, rows[k][1]) for k in range(300)]  # copies are in the fit list once
    compare(run(spark, rows, 70), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for k in range(60)]
    rows += [(100 + k, (rng.standard_normal(3) * [4, 2, 1]).tolist()) for k in range(40)]  # another length is whitened apart
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan")] * 5), (203, [1.0, 2.0, float("inf")]), (204, []), (205, [1e300] * 5)]
    got = run(spark, rows)
    assert not {200, 201, 202, 203, 204, 205} & set(got)
    compare(got, [r for r in rows if r[0] < 200])


def test_without_variance(spark):
    one = run(spark, [(1, [1.0, 2.0])])
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one[1]] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = run(spark, [(k, [float(k), 5.0, 7.0]) for k in range(8)])
    assert all(v[0]["whitened"] is not None and v[1]["whitened"] is None and v[1]["explained"] == 0 for v in flat.values())
    assert run(spark, [(1, None)]) == {}


def test_large_deviations_are_exact_or_null(spark):
    rows = [(k, [float(k) * 2.0**20, 1.0]) for k in range(6)] + [(9, [2.0**54, 1.0])]
    got = run(spark, rows)
    want = oracle(rows)
    for k, (_, deviation, *_) in want.items():
        assert {r["deviation"] for r in got[rows[k][0]]} == {deviation if deviation < 2**63 else None}


def test_the_given_vectors(spark):
    import os

    from loomwright.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the driver's tables")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = defaultdict(list)
    for r in QUERIES["op13_whitening"](spark, sf).collect():
        found[r["vec_id"]].append(r)
    compare({k: sorted(v, key=lambda r: r["component"]) for k, v in found.items()}, rows)
