"""Shortest paths over the whole memory graph: light edges, and those without a weight, are steps like any other."""

from __future__ import annotations

import duckdb

from loomwright import registry
from tests.test_whole import folder


def test_light_edges_lead_on(spark, tmp_path):
    """No path here has an edge of 0.9; before, such edges alone were read."""
    rows = [(50, 1, 0.01), (2, 1, 0.02), (2, 3, 0.0), (4, 3, 0.05), (50, 5, 0.04), (4, 5, None), (6, 1, None), (6, 7, 0.1), (8, 7, 0.03), (50, 9, 0.02), (2, 9, 0.01), (100, 11, 0.0), (10, 11, 0.0)]
    lines = [(k, p, s, 1, d, "F") for k, (s, p, d) in enumerate(rows)]
    d = folder(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_linestatus string"))
    columns = ["start", "id", "hops", "weight", "path"]
    got = {tuple(r[c] for c in columns) for r in registry.QUERIES["shortest_path"](spark, d).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet/*.parquet'")
    names = [x[0] for x in c.execute(registry.ORACLES["shortest_path"]).description]
    assert got == {tuple(r[names.index(n)] for n in columns) for r in c.fetchall()}
    assert {r[:4] for r in got if r[0] == "s50"} == {("s50", "s50", 0, 0.0), ("s50", "s2", 2, 0.3), ("s50", "s4", 2, None), ("s50", "s6", 2, None), ("s50", "s8", 4, None)}
    assert ("s100", "s10", 2, 0.0, "s100>p11>s10") in got


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Of all plans of a search only the sizes of files, one row each, may be sent to all executors; before, the names were, and frontiers."""
    from loomwright.operators import paths

    plans = []
    cut = paths._cut
    monkeypatch.setattr(paths, "_cut", lambda df: plans.append(df) or cut(df))
    edges = spark.createDataFrame([(f"s{k}", f"p{k % 7}", 0.5) for k in range(30)] + [(f"p{k % 7}", f"s{k}", 0.5) for k in range(30)], "src string, dst string, weight double")
    starts = spark.createDataFrame([("s0",), ("s5",)], "id string")
    for kw in ({"total": False, "trace": False}, {"wanted": lambda id: id.startswith("s")}):
        plans.append(paths.nearest_first(edges, starts, 4, **kw))
    lines = [x for df in plans for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    assert any("SortMergeJoin" in x for x in lines)
    assert [x for x in lines if "BroadcastHashJoin" in x and "file#" not in x] == []
