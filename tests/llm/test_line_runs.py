from __future__ import annotations

from collections import defaultdict


def test_batches_of_two_sessions_meet(spark, tmp_path):
    """Runs are opened again by their manifest; a key is in one run only, else documents would count twice."""
    from loomwright.llm.line_dedup import LineRuns

    home = str(tmp_path / "runs")
    batches = [[(k % 7, 0, 100 * n + k) for k in range(n + 10)] for n in range(5)]
    held = defaultdict(list)
    for batch in batches:
        for a, b, doc in batch:
            held[a, b].append(doc)
    sessions = [spark, spark, spark.newSession(), spark.newSession(), spark.newSession()]
    for n, (session, batch) in enumerate(zip(sessions, batches, strict=True)):
        LineRuns(session, home, fanout=2).add(session.createDataFrame(batch, "a long, b long, doc long"), f"batch {n}")
    again = LineRuns(spark, home, fanout=2)
    again.add(spark.createDataFrame(batches[4], "a long, b long, doc long"), "batch 4")  # known: not added twice
    names = sum(again.levels, [])
    assert len(names) == 2 and again.batches == [f"batch {n}" for n in range(5)]
    rows = [r for name in names for r in spark.table(name).collect()]
    assert len({(r["a"], r["b"]) for r in rows}) == len(rows) == len(held)
    for least in (1, 8, 9, 10):
        want = sorted((a, b, max(d)) for (a, b), d in held.items() if len(d) >= least)
        assert sorted(tuple(r) for r in again.frequent(least).collect()) == want
