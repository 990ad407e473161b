"""Iterative, sequential and streaming operators against plain Python on small made-up input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomwright.operators import chunking, graph, ranking
from loomwright.plans.retrieval import near_terms
from loomwright.streaming import events as ev


def reach(edges: set[tuple[int, int]], nodes: set[int]) -> dict[int, set[int]]:
    out = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            for n in nodes:
                if a in out[n] and b not in out[n]:
                    out[n].add(b)
                    changed = True
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_cycles(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(24), rng.randrange(24)) for _ in range(26)} | {(30, 30)}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    nodes = {n for e in edges for n in e}
    r, both = reach(edges, nodes), reach(edges | {(b, a) for a, b in edges}, nodes)
    assert {x["id"]: x["root"] for x in graph.scc(df).collect()} == {n: min(m for m in r[n] if n in r[m]) for n in nodes}
    assert {x["id"]: x["root"] for x in graph.components(df).collect()} == {n: min(both[n]) for n in nodes}


def test_pagerank(spark):
    nodes, edges = range(6), [(0, 1), (1, 2), (2, 0), (2, 0), (3, 0), (3, 3), (4, 5)]
    out = {n: sum(a == n and b != n for a, b in edges) for n in nodes}
    rank = dict.fromkeys(nodes, 1 / 6)
    for _ in range(20):
        rank = {n: 0.15 / 6 + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == n and a != b) for n in nodes}
    top = max(rank.values())
    got = graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx({n: v / top for n, v in rank.items()}, rel=1e-9)


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 1.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    got = {r["id"]: r["community"] for r in graph.label_communities(df).collect()}
    assert len({got[k] for k in range(4)}) == 1 and len({got[k] for k in range(11, 15)}) == 1
    two = spark.createDataFrame([(k, k // 10) for k in (*range(5), *range(10, 15))], "id long, community long")
    assert graph.modularity(df, two).first()[0] == pytest.approx(20 / 21 - 2 * (21 / 42) ** 2)


def test_fusion_takes_the_best_lexical_rank(spark):
    make = lambda ids: spark.createDataFrame([(1, k, 1.0 - n / 10) for n, k in enumerate(ids)], "query_id long, id long, score double")
    got = {r["id"]: r["rrf"] for r in ranking.rrf_fuse(make([1, 2]), [make([2, 3]), make([3, 2])]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 61})


def test_ties_are_anchored_at_the_first(spark):
    rows = [(1, 1, 0.90, 0.0), (1, 2, 0.895, 1.0), (1, 3, 0.889, 5.0), (1, 4, 0.885, 9.0)]
    got = ranking.tie_rerank(spark.createDataFrame(rows, "query_id long, id long, score double, boost double")).orderBy("place").collect()
    assert [r["id"] for r in got] == [2, 1, 4, 3]


def test_packing_skips_what_does_not_fit(spark):
    rows = [(1, 1, 0.9, "a", 50), (1, 2, 0.8, "a", 60), (1, 3, 0.7, "b", 30), (1, 4, 0.6, "c", 20)]
    got = ranking.context_pack(spark.createDataFrame(rows, "query_id long, id long, score double, file string, tokens long"), 100).orderBy("place").collect()
    assert [r["id"] for r in got] == [1, 3, 4]


def test_near_terms():
    assert near_terms("foo bar", ["foo", "bar"]) == pytest.approx(1 / (1 + 4 / 7) + 0.125)
    assert near_terms("foo foo bar", ["foo", "bar"]) == pytest.approx(1 / (1 + 4 / 11) + 0.125)
    assert near_terms("foo", ["foo", "bar"]) == 0


def test_chunkers():
    text = "intro\n# A\nx\n```\n# no\n```\n## B\ny\n# C\n"
    assert [(c[0], c[1], c[2]) for c in chunking.markdown(text)] == [(1, 1, "preamble"), (2, 6, "A"), (7, 8, "A > B"), (9, 10, "C")]
    assert [c[2] for c in chunking.json_keys('{"a": 1, "b": {"c": [2]}}')] == ["{a, b}"]
    assert [c[2] for c in chunking.json_keys('{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6}')] == list("abcdef")
    assert [c[2] for c in chunking.yaml_keys("a: 1\nb:\n  - 2\n")] == ["a", "b"] and len(chunking.yaml_keys("---\na: 1\n---\nb: 2\n")) == 2
    assert [c[3] for c in chunking.code("# remark\ndef a():\n" + "  x = 1\n" * 6 + "# about b\ndef b():\n" + "  y\n" * 6)][1].startswith("# about b")
    long = chunking.code("x" * 20_000)
    assert "".join(c[3] for c in long) == "x" * 20_000 and max(len(c[3]) for c in long) <= chunking.CHARS
    assert chunking.html_to_markdown("<nav>n</nav><h2>T &amp; U</h2><p>a <b>b</b></p><ul><li>x<li><a href='/l'>y</a></ul><script>s</script>") == "## T & U\n\na **b**\n\n- x\n- [y](/l)"
    assert chunking.json_paths('{"a": [{"b": 1}], "c": "d"}') == [("$.a[0].b", "1"), ("$.c", "d")]


def test_dedup_is_anchored_and_the_stream_agrees(spark, tmp_path):
    rows = [(k, "a" if k % 2 else "b", 1_700_000_000 + s) for k, s in enumerate([0, 0, 30, 30, 61, 61, 90, 90, 130, 119])]
    df = spark.createDataFrame(rows, "event_id long, key string, ts_s long")
    batch = sorted(r["event_id"] for r in ev.dedup_anchored(df).collect())
    assert batch == [0, 1, 4, 5, 8]
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = ev.dedup_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")))
    assert sorted(r["event_id"] for r in ev.run_once(stream, "dedup_once").collect()) == batch


def test_windows_of_a_stream_agree_where_they_are_closed(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 3, ["view", "click"][k % 2], float(k)) for k in range(200)], "event_id long, user_id long, event_type string, value double")
    df = df.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") * 97))
    df.coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = ev.read_events(spark, str(tmp_path / "w"), df.schema)
    whole = {tuple(r) for r in ev.windows(df, "1 hour").collect()}
    closed = {tuple(r) for r in ev.run_once(ev.windows(stream, "1 hour", late="10 minutes"), "hours").collect()}
    assert closed <= whole and len(closed) >= len(whole) - 4
    assert {tuple(r) for r in ev.run_once(ev.windows(stream, "1 hour"), "hours_all", "complete").collect()} == whole
