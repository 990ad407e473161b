from __future__ import annotations

import random

import pytest

from tests.llm.test_operators import shingle_oracle, tuples


def copies(n: int, seed: int) -> list[str]:
    """Near copies of one text, of copies of it, and of texts that share their edits; and unrelated texts."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(900)}" for _ in range(120)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice([f"e{rng.randrange(4)}", f"own{k}"])
        out.append(" ".join(w))
    return out + [" ".join(f"u{rng.randrange(5000)}" for _ in range(60)) for _ in range(n // 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_large_groups_of_near_copies(spark, seed, monkeypatch):
    from loomwright.llm import shingle_join

    monkeypatch.setattr(shingle_join, "BLOCK", 40)
    data = list(enumerate(copies(150, seed)))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert tuples(shingle_join.near_documents(df), "doc_id", "n_shingles", "component_id") == shingle_oracle(data, 3, 90)


def test_null_and_repeated_keys_do_not_multiply_postings(spark, monkeypatch):
    from loomwright.llm import shingle_join

    seen: dict[str, int] = {}
    kept = shingle_join.saved

    def saved(df, label, path=None):
        out = kept(df, label, path)
        seen.setdefault(label, out.count())
        return out

    monkeypatch.setattr(shingle_join, "saved", saved)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(40)) for _ in range(1000)]
    texts[::50] = [texts[0] + f" tail{k}" for k in range(20)]
    counts = []
    for keys in (range(1000), [None] * 1000, [7] * 500 + [None] * 500):
        data = list(zip(keys, texts, strict=True))
        df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
        got = tuples(shingle_join.near_documents(df), "doc_id", "n_shingles", "component_id")
        assert got == shingle_oracle(data, 3, 90)
        counts.append(seen["postings"])
        seen.clear()
    assert counts[0] > 0 and counts[1] == counts[2] == counts[0]
