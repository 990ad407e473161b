from __future__ import annotations

import hashlib
import random

import xxhash


def test_hot_keys_are_spread_over_ranges_and_order_holds(spark, monkeypatch):
    """A key and null keys that hold a third of all rows each; next documents are found across ranges."""
    from loomwright.llm import sampling_prints

    monkeypatch.setattr(sampling_prints, "RANGE_ROWS", 20)
    rng = random.Random(6)
    rows = [(None if k % 3 == 0 else 77 if k % 3 == 1 else k, f"text {k} of {rng.random()}") for k in range(300)]
    got = sampling_prints.edited_prints(spark.createDataFrame(rows, "doc_id long, text string"), samples=8).collect()
    place = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64)
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), place(r[1])))
    want = []
    for k, (doc, t) in enumerate(rows):
        h = len(t) // 2
        want.append((doc, len(t), hashlib.sha256((t[: len(t) - h] + rows[(k + 1) % len(rows)][1][:h]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)


def test_likeness_follows_weights(spark):
    """Weights above 1: the estimates' mean over many samples is the generalised Jaccard similarity."""
    from pyspark.sql import functions as F

    from loomwright.llm.sampling_prints import fingerprints, likeness

    bags = {1: {"a": 1, "b": 4, "c": 9, "d": 30}, 2: {"a": 2, "b": 2, "c": 9, "e": 25, "f": 3}, 3: {"a": 8, "b": 32, "c": 72, "d": 240}}
    df = spark.createDataFrame([(k, " ".join(w for w, n in b.items() for _ in range(n))) for k, b in bags.items()], "k int, t string")
    prints = fingerprints(df, ["k"], "t", 2048)
    both = prints.select("k", "print").crossJoin(prints.select(F.col("k").alias("j"), F.col("print").alias("other")))
    for r in both.select("k", "j", likeness(F.col("print"), F.col("other"), 2048).alias("x")).collect():
        a, b = bags[r["k"]], bags[r["j"]]
        words = a.keys() | b.keys()
        want = sum(min(a.get(w, 0), b.get(w, 0)) for w in words) / sum(max(a.get(w, 0), b.get(w, 0)) for w in words)
        assert abs(r["x"] - want) < 0.05, (r, want)
