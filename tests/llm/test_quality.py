from __future__ import annotations

import math
import random
import zlib

import pytest


def slow_features(text: str) -> dict[int, int]:
    """Counts of hashed words, pairs and pairs of shapes, one by one in plain integers."""
    from loomwright.llm.quality import BITS, shape

    full = (1 << 64) - 1

    def mixed(x: int) -> int:
        x = ((x ^ x >> 31) * 0x9E3779B97F4A7C15) & full
        return x >> (64 - BITS)

    words, out = text.split(), {}
    of = [(zlib.crc32(w.encode()), zlib.crc32(shape(w).encode()) >> 1) for w in words]
    found = [mixed(w) for w, _ in of]
    for (w, f), (v, g) in zip(of, of[1:], strict=False):
        found.append(mixed((w * 0x100000001B3 + v + (1 << 40)) & full))
        found.append(mixed(((f * 0x1000193 + g) * 2 + (w == v) + (1 << 62)) & full))
    for x in found:
        out[x] = out.get(x, 0) + 1
    return out


def test_training_and_scores_equal_plain_follow_the_leader():
    from loomwright.llm.quality import ALPHA, BETA, BITS, L1, L2, ROUNDS, Features, score_texts, train

    rng = random.Random(1)
    texts = [" ".join(rng.choice(["good", "text", "Bad!!", "x1", "spam", "Ähre", "y" * 90]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    labels = [int("spam" not in t) for t in texts]
    bias = 1 << BITS
    z, n = {}, {}

    def weight(k: int) -> float:
        if abs(z.get(k, 0.0)) <= L1:
            return 0.0
        return -(z[k] - math.copysign(L1, z[k])) / ((BETA + math.sqrt(n[k])) / ALPHA + L2)

    rows = []
    for t in texts:
        f = slow_features(t)
        scale = max(1.0, math.sqrt(sum(f.values())))
        rows.append({**{k: c / scale for k, c in f.items()}, bias: 1.0})
    for _ in range(ROUNDS):
        for row, y in zip(rows, labels, strict=True):
            w = {k: weight(k) for k in row}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in row.items())))
            for k, v in row.items():
                g = (p - y) * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / ALPHA * w[k]
                n[k] = n.get(k, 0.0) + g * g
    w = train(texts, labels)
    for k in {k for row in rows for k in row}:
        assert w[k] == pytest.approx(weight(k), abs=1e-6)
    want = [1 / (1 + math.exp(-sum(weight(k) * v for k, v in row.items()))) for row in rows]
    assert score_texts(Features(), w, texts).tolist() == pytest.approx(want, abs=1e-5)


def test_one_text_teaches_for_a_repeated_key(spark):
    from loomwright.llm import quality

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, f"good words {k}") for k in range(2, 40)], "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS t", "3 AS p")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    a, b = quality.learn(docs, labels), quality.learn(docs.repartition(5), labels)
    assert (a == b).all() and (a != 0).sum() < 500
