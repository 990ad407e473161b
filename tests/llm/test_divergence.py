"""Operator 11 against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

W = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = {
    "en": "the of and to in is that was for with from have this are not but they which".split(),
    "de": "der die und das ist nicht ein mit auf für sich den auch als noch über schön".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice("abcdefgh") + rng.choice("ijklmn"), ","]) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(7)
    out = [(k, prose(rng, ["en", "de"][k % 2], rng.randint(60, 400)), ["en", "de"][k % 2]) for k in range(80)]
    out += [(100, prose(rng, "en", 200).upper(), "en"), (101, " ".join(w + "%%" for w in prose(rng, "en", 150).split()), "en")]
    out += [(102, " ".join("".join(rng.choice("qxzjk") for _ in range(6)) for _ in range(150)), "en"), (103, prose(rng, "de", 200), "en")]
    out += [(104, "all the same words " * 40, "en"), (105, None, "en"), (106, "", None), (107, "one two three", "en"), (108, " \n\t ", "en")]
    out += [(109, "a line with words\nanother\n a line with words\na line with words\n\n\n" + prose(rng, "en", 70), "en")]
    out += [(None, prose(rng, "en", 90), None), (111, prose(rng, "en", 20_000), "en"), *[(112, prose(random.Random(1), "de", 120), "de")] * 3]
    return out


CLASSES = [r"[a-z]", r"[\x20\x09-\x0D]", r"[A-Z]", r"[!\x22'()+,\-./:;=?@\[\\\]^_`{}~]", r"[#*$%&|<>]", r"[0-9]"]


def oracle(data: list[tuple]) -> list[tuple]:
    def classes(t):
        own = [len(re.findall(c, t)) for c in CLASSES]
        return [*own, len(t) - sum(own)]

    def far(p, q):
        total = 0
        for a, b in zip(p, q, strict=True):
            total += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
        return math.sqrt(max(total / 2, 0))

    words, chars = defaultdict(Counter), defaultdict(lambda: [0] * 7)
    for _, t, lang in data:
        words[lang].update(W.findall(t or ""))
        chars[lang] = [a + b for a, b in zip(chars[lang], classes(t or ""), strict=True)]
    out = []
    for k, t, lang in data:
        t = t or ""
        ws = W.findall(t)
        n = len(ws)
        grams = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        lines = [x for x in t.split("\n") if W.search(x)]
        again = {i + j for i, g in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if grams[g] > 1 for j in range(3)}
        failed = n < 50 or 100 * len(again) > 50 * n
        kept = not failed
        if kept and len(t) >= 200:
            kept &= far([c / len(t) for c in classes(t)], [c / sum(chars[lang]) for c in chars[lang]]) <= 0.16 + 1.2 / math.sqrt(n)
        if kept:
            total = sum(words[lang].values())
            common = sorted(w for w, c in words[lang].items() if c >= 0.005 * total)
            own = Counter(ws)
            p, q = [own[w] / n for w in common], [words[lang][w] / total for w in common]
            kept &= far([*p, 1 - sum(p)], [*q, 1 - sum(q)]) <= 0.16 + 0.32 * math.sqrt((len(common) + 1) / n)
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        out.append((k, n, sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(again), failed, kept))
    return sorted(out, key=repr)


def frame(spark, data):
    return spark.createDataFrame([(*r, "w", 3) for r in data], "doc_id long, text string, lang string, words string, n int").repartition(4)


def test_against_plain_python(spark):
    from loomwright.llm.divergence import quality_report

    data = rows()
    got = sorted((tuple(r) for r in quality_report(frame(spark, data)).collect()), key=repr)
    assert got == oracle(data)
    kept = {r[0] for r in got if r[7]}
    assert not {100, 101, 102, 103, 104, 105, 106, 107, 108} & kept and set(range(80)) <= kept and {111, 112} <= kept


def test_keeps_columns_and_rows(spark):
    from loomwright.llm.divergence import good_documents, judged

    df = frame(spark, rows())
    good = good_documents(df)
    assert good.columns == df.columns
    assert good.count() == judged(df).where("kept").count()


def test_empty(spark):
    from loomwright.llm.divergence import quality_report

    assert quality_report(frame(spark, [])).collect() == []
    assert [tuple(r) for r in quality_report(frame(spark, [(1, None, None)])).collect()] == [(1, 0, 0, 0, 0, 0, True, False)]


def test_repeats_of_every_kind(spark):
    from pyspark.sql import functions as F

    from loomwright.llm.divergence import repeated_words, windows_of, words_of

    texts = ["", "a", "a b", "a b c", "a b c a b c", "a b c x a b c", "a a a", "a a a a", "a b a b a", "a b c d e a b c q c d e", " ".join(f"w{k % 30}" for k in range(50))]
    want = []
    for t in texts:
        ws = t.split()
        g = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        want.append(len({i + j for i, x in enumerate(zip(ws, ws[1:], ws[2:], strict=False)) if g[x] > 1 for j in range(3)}))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[1] for r in df.select("k", repeated_words(windows_of(words_of(F.col("t"))))).orderBy("k").collect()] == want
