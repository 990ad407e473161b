"""Operator 12 against plain counting of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def oracle(rows: list[tuple], least: int, longest: int = 5, first: int = 2000) -> list[tuple]:
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CAPITALS)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                count[lang].update(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in count.items():
        often = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in often.items():
            ws = p.split(" ")
            longer = [o for o in often if f" {p} " in f" {o} " and o != p and 100 * often[o] >= 100 * a]
            if len(ws) < 2 or longer:
                continue
            cuts = []
            for k in range(1, len(ws)):
                left, right = f[" ".join(ws[:k])], f[" ".join(ws[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, p.encode(), lang, p, a, left, right, n[lang], score))
        out += [(x[3], rank, *x[4:]) for rank, x in enumerate(sorted(found)[:first], 1)]
    return sorted(out)


def run(spark, rows, **how):
    from loomwright.llm.collocations import collocations

    df = spark.createDataFrame([(t, g, "p", 1) for t, g in rows], "text string, lang string, phrase string, f int").repartition(5)
    return sorted(tuple(r) for r in collocations(df, **how).collect())


def corpus() -> list[tuple]:
    rng = random.Random(2)
    words = ["New", "york", "CITY", "of", "the", "state", "in", "ünder", "a", "b\x1cc", "x y", "ÉTÉ"]
    rows = []
    for k in range(120):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " ", " "]) for _ in range(rng.randint(0, 90)))
        rows.append((text + rng.choice(["new york city ", "in the state of the city "]) * 3, ["en", "de", None][k % 3]))
    return [*rows, (None, "en"), ("", "en"), ("...", None), ("new york " * 20_000, "en"), *[("the same words again", "de")] * 40]


@pytest.mark.parametrize("most_bits", [27, 6])
def test_against_counting(spark, most_bits):
    """A bitmap that is far too small lets too much through, and changes nothing."""
    rows = corpus()
    want = oracle(rows, 20)
    assert len(want) > 50 and {len(r[2].split()) for r in want} == {2, 3, 4, 5}
    assert run(spark, rows, least=20, most_bits=most_bits) == want


def test_few_rows_a_language(spark):
    rows = corpus()
    assert run(spark, rows, least=20, first=7) == oracle(rows, 20, first=7)


def test_nothing_frequent(spark):
    assert run(spark, [("a b c", "en"), (None, None)]) == []
    assert run(spark, []) == []


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    from loomwright.llm import collocations

    real = collocations.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(collocations, "_FACTOR", 0)  # the first hash is that of the last word alone
    phrases, times, total = collocations.count_block([b"a b . c b . a b"], "en", 2, None)
    assert Counter(dict()) + sum((Counter({p: t}) for p, t in zip(phrases, times, strict=True) if t), Counter()) == Counter({"a b": 2, "c b": 1}) and total == 6
    assert real(b"a") != real(b"c")


def test_scores_of_more_than_64_bits(spark):
    from loomwright.llm.collocations import scored

    big = 10**15
    totals = spark.createDataFrame([("en", big)], "lang string, n long")
    first = spark.createDataFrame([("en", "a", 10**12 + 1), ("en", "b", 10**12 + 7)], "lang string, phrase string, f long")
    second = spark.createDataFrame([("en", "a b", 10**12)], "lang string, phrase string, f long")
    (row,) = scored(totals, [first, second]).collect()
    assert row["score"] == 1000 * 10**12 * big // ((10**12 + 1) * (10**12 + 7))


def test_bitmap_holds_what_it_was_made_of():
    from loomwright.llm.collocations import Frequent, _slots, phrase_hash

    h = np.array([phrase_hash([b"w%d" % k], "en") for k in range(50)], np.uint64)
    words = np.zeros(1 << 6, np.uint64)
    for at in _slots(h, 12):
        words[int(at) >> 6] |= np.uint64(1) << (at & np.uint64(63))
    assert Frequent(12, words).holds(h).all()
