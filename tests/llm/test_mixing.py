from __future__ import annotations

import random
from collections import Counter

import pytest


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    out = [(k, " ".join("w" * rng.randint(1, 9) for _ in range(rng.choice([0, 0, 3, 30, 300]))), f"s{k % 5}") for k in range(900)]
    out += [(2000, f"one of many texts {k % 7} {'x ' * (k % 3)}", "s1") for k in range(60)]  # a repeated key; texts of one size
    out += [(None, None, None), (3000, "", "s4"), (3001, " ".join(["long"] * 20_000), "s2"), (3002, "alone", "s9")]
    return out


def test_no_row_is_taken_more_than_twice_and_reruns_agree(spark, rows):
    from loomwright.llm.mixing import mix

    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = Counter((r["doc_id"], r["text"], r["source"]) for r in mix(docs.repartition(7)).collect())
    held = Counter(rows)
    assert all(n <= 2 * held[r] for r, n in first.items())
    assert first == Counter((r["doc_id"], r["text"], r["source"]) for r in mix(docs.coalesce(1)).collect())
    assert any(n == 2 * held[r] for r, n in first.items() if r[1] == "")


def test_each_source_comes_near_its_target(spark, rows):
    from loomwright.llm.mixing import mix_report

    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for r in mix_report(docs).collect():
        taken[r["target"], r["source_size"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    off = {k: n - k[0] for k, n in taken.items() if k[1] > 100}
    assert len(off) == 5 and all(abs(x) <= 3 for x in off.values()), off
