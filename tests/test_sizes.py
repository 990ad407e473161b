"""Queries whose work must not grow faster than their tables: results against plain Python, and plans without what grew."""

from __future__ import annotations

import datetime as dt
import random

from loomwright import registry
from tests.test_whole import folder


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))


def test_next_runs_are_worked_out_without_a_list_of_minutes(spark, tmp_path):
    rng = random.Random(5)
    at = [dt.datetime(2024, 2, 28) + dt.timedelta(seconds=rng.randrange(3 * 86400)) for _ in range(300)] + [dt.datetime(2024, 2, 28, h, m, s) for h in (2, 3, 9, 10) for m in (0, 44, 45, 59) for s in (0, 59)]
    d = folder(spark, tmp_path, events=([*enumerate(at), (999, None)], "event_id long, ts timestamp"))
    df = registry.QUERIES["cron_next"](spark, d)

    def after(t):
        t = t.replace(second=0) + dt.timedelta(minutes=1)
        while t.minute % 15 or t.hour not in (3, 9):
            t += dt.timedelta(minutes=1)
        return int(t.replace(tzinfo=dt.timezone.utc).timestamp())

    rows = {r["event_id"]: r["next_s"] for r in df.collect()}
    stamps = {r["event_id"]: dt.datetime.fromtimestamp(r["s"], dt.timezone.utc).replace(tzinfo=None) for r in spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", "unix_seconds(ts) AS s").where("s IS NOT NULL").collect()}
    assert rows == {k: after(t) for k, t in stamps.items()}
    assert "sequence(" not in plan(df)


def test_recall_meets_only_its_first_memories(spark, tmp_path):
    """No join of all memories with the queries stands below the choice of the first ones."""
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], k % 4) for k in range(300)]
    d = folder(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    df = registry.QUERIES["recall"](spark, d)
    first = {k for _, k in sorted((-(k % 100) / 100, k) for k in range(300) if k % 17)[:60]}
    got = df.collect()
    assert {r["id"] for r in got} <= first and len(got) == 6 * 20
    text = plan(df).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "LeftSemi" not in text and text.index("Join Cross") < text.index("GlobalLimit")


def odd_vectors(spark, tmp_path):
    """Copies, zeros, nulls, lacking components, a null id and more rows than a pack of the test."""
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(64)]) for k in range(230)]
    rows += [(k, rows[k % 7][1]) for k in range(230, 260)] + [(260, [0.0] * 64), (261, None), (262, [None] + [1.0] * 63), (None, rows[50][1])]
    d = folder(spark, tmp_path, embeddings=([(k, v, (k or 0) % 4) for k, v in rows], "vec_id long, embedding array<float>, label int"))
    return rows, d


def brute(spark, d):
    import math

    held = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()}

    def cos(a, b):
        if a is None or b is None or None in a or None in b:
            return 0.0
        n = math.sqrt(math.fsum(x * x for x in a)) * math.sqrt(math.fsum(x * x for x in b))
        return math.fsum(x * y for x, y in zip(a, b)) / n if n else 0.0

    return held, cos


def test_vector_searches_score_packs_and_pass_on_the_best_alone(spark, tmp_path, monkeypatch):
    from loomwright.operators import vectors

    monkeypatch.setattr(vectors, "QUERIES", 3)
    monkeypatch.setattr(vectors, "AT_ONCE", 50)
    monkeypatch.setattr(vectors.packed, "__defaults__", (9,))
    _, d = odd_vectors(spark, tmp_path)
    held, cos = brute(spark, d)
    asked = [k for k in held if k is not None and k % 50 == 0]
    place = lambda k: -1 if k is None else k
    near = {q: sorted((-round(cos(held[q], v), 9), place(k)) for k, v in held.items()) for q in asked}
    df = registry.QUERIES["cosine_topk"](spark, d)
    got = {q: [] for q in asked}
    for r in df.collect():
        got[r["q"]].append((-r["score"], place(r["id"])))
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted((-round(min(max(-s, 0), 1), 6), k) for s, k in x[:10]) for q, x in near.items()}

    sign = lambda v: [(x or 0) > 0 for x in v or [0] * 64]
    got = {(r["q"], place(r["id"])) for r in registry.QUERIES["bq_two_phase"](spark, d).collect()}
    want = set()
    for q in asked:
        pool = sorted((sum(a != b for a, b in zip(sign(held[q]), sign(v))), place(k)) for k, v in held.items())[:100]
        of = {place(k): v for k, v in held.items()}
        want |= {(q, k) for _, k in sorted((-round(cos(held[q], of[k]), 12), k) for _, k in pool)[:5]}
    assert got == want

    rows = registry.QUERIES["semantic_rank"](spark, d).collect()
    assert len(rows) == len(asked) * len(held)
    own = {k: {r["score"] - 0.65 * max(cos(held[r["q"]], held[k]), 0) for r in rows if r["id"] == k} for k in held}
    assert all(max(x) - min(x) < 2e-6 for x in own.values())
    for name in ("cosine_topk", "bq_two_phase", "semantic_rank"):
        made = plan(registry.QUERIES[name](spark, d)).split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]
        assert "zip_with" not in made and "MapInArrow" in made, name


def test_searches_meet_within_slots_of_a_session(spark):
    """In one session over a long time, also over the edges of slots."""
    from pyspark.sql import functions as F

    from loomwright.streaming.links import pairs

    rng = random.Random(2)
    rows = [(k, 1, rng.randrange(5), t) for k, t in enumerate([0, 599, 600, 601, 1199, 1200, 1200, 1800] + [rng.randrange(-2000, 9000) for _ in range(150)])]
    df = pairs(spark.createDataFrame(rows, "event_id long, session long, item long, s long").select("event_id", "session", "item", F.timestamp_seconds("s").alias("ts")))
    want = sorted((min(i, j), max(i, j)) for k, _, i, t in rows for k2, _, j, u in rows if i != j and t - 600 <= u <= t and (u < t or k2 < k))
    assert sorted((r["a"], r["b"]) for r in df.collect()) == want
    join = next(line for line in plan(df).split("== Optimized Logical Plan ==")[1].splitlines() if "Join Inner" in line)
    assert "x_slot" in join and "y_slot" in join


def test_owners_of_spans_that_one_customer_has(spark, tmp_path):
    """Hundreds of spans that hold one another: of a cell's spans one goes on, and nothing that is exploded is broadcast."""
    rng = random.Random(7)
    day = lambda n: dt.datetime(1999, 1, 1) + dt.timedelta(days=n)
    rows = [(k, k % 2, day(rng.randrange(120)), float(rng.randrange(100, 1000))) for k in range(400)]
    d = folder(spark, tmp_path, orders=(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double"))
    df = registry.QUERIES["innermost_owner"](spark, d)
    spans = [(k, c, (t - day(0)).days, (t - day(0)).days + int(p) % 200) for k, c, t, p in rows]
    want = {}
    for k, c, a, _ in spans:
        held = [(x[2], -x[3], x[0]) for x in spans if x[1] == c and x[2] < a <= x[3]]
        if held:
            want[k] = max(held)[2]
    assert {r["id"]: r["owner"] for r in df.collect()} == want
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_nearest_vectors_go_on_only_while_they_can_be_among_the_best(spark):
    """A task's later packs pass on what beats its earlier ones; ties, copies, zero and null vectors as by brute force, whichever precision decides."""
    import numpy as np

    from loomwright.operators import vectors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:140] = x[0]
    x[200] = 0
    rows = [(k, None if k == 201 else [float(y) for y in v]) for k, v in enumerate(x)]
    near = np.where(np.arange(600)[:, None] == 201, 0.0, x.astype(np.float64))
    unit = near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-300)
    queries = list(range(0, 600, 50))
    want = {(q, k, n) for q in queries for n, k in enumerate(sorted(range(600), key=lambda j: (-round(float(unit[q] @ unit[j]), 9), j))[:7])}
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = df.where("id % 50 = 0").selectExpr("id AS q", "embedding AS v")
    got = {}
    for r in vectors.nearest(df, asked, 7).collect():
        got.setdefault(r["q"], []).append((-r["s"], r["id"]))
    assert {(q, k, n) for q, found in got.items() for n, (_, k) in enumerate(sorted(found))} == want

    # two packs in one task: of the second, of zero vectors, only what ties with the zero query's best goes on
    import pyarrow as pa

    passed, met = [], vectors.met
    pack = lambda ids, vs, names: dict(zip(names, (pa.array(ids, pa.int64()), pa.array(vs, pa.list_(pa.float32()))), strict=True))

    def spy(found, searched, begin, schema):
        score, q = begin(), pack(queries, [rows[k][1] for k in queries], ("q", "v"))
        for ids, vs in ((list(range(600)), [v for _, v in rows]), (list(range(600, 900)), [[0.0] * 8] * 300)):
            passed.append(sum(len(b) for b in score(pack(ids, vs, ("id", "embedding")), q)))
        return met(found, searched, begin, schema)

    vectors.met = spy
    try:
        vectors.nearest(df, asked, 7)
    finally:
        vectors.met = met
    assert passed == [7 * len(queries), 7]
