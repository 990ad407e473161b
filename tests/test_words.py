"""Indexes of words against all pairs."""

from __future__ import annotations

import random


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def vocabulary(rng, n):
    return sorted({"".join(rng.choice("abcü") for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 13, 16]))) for _ in range(n)})


def test_holding(spark):
    from loomwright.operators.words import holding

    rng = random.Random(1)
    words, terms = vocabulary(rng, 300), [x for x in vocabulary(rng, 80) if len(x) >= 3] + ["zzz", "abz"]
    got = holding(spark.createDataFrame([(x,) for x in terms * 2], "term string"), spark.createDataFrame([(x,) for x in words * 2], "word string")).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == {(t, w) for t in terms for w in words if t in w}


def test_within_edits(spark):
    from loomwright.operators.words import within_edits
    from loomwright.functions.text import edit_limit

    rng = random.Random(2)
    words = vocabulary(rng, 260)
    terms = vocabulary(rng, 60)
    for w in rng.sample(words, 60):  # and some that are near
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "a" + w[k:], w[:k] + "c" + w[k + 1 :]])
        terms.append(w or "a")
    got = within_edits(spark.createDataFrame([(x,) for x in terms], "term string"), spark.createDataFrame([(x,) for x in words], "word string"), edit_limit).collect()
    limit = lambda t: 1 if len(t) <= 4 else 2 if len(t) <= 12 else 3
    want = {(t, w, distance(t, w)) for t in set(terms) for w in words if distance(t, w) <= limit(t)}
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len({d for *_, d in want}) == 4
