"""Each operator on a small table with nulls, empty and very long texts, ties, repeated rows and clashing extra columns, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("lines", T.StringType()),
    T.StructField("row", T.IntegerType()), T.StructField("key", T.StringType()), T.StructField("hashes", T.StringType()),
])
WORDS = {
    "en": "the of and to in is that was for with from have this are not but they which".split(),
    "de": "der die und das ist nicht ein mit auf für sich den auch als noch über schön".split(),
}
BLANKS = " \t\n\x0b\x0c\r"


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", "x", "en", ","]) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(5)
    out = []
    shared = "A line that many of these documents hold, word for word."
    for k in range(60):
        lang = "de" if k % 3 == 0 else "en"
        text = "\n".join(prose(rng, lang, rng.randint(5, 40)) for _ in range(rng.randint(1, 5)))
        if k % 4 == 0:
            text += "\n \t" + shared.upper() + "  " if k % 8 else "\n" + shared
        out.append((k, text, lang, f"s{k % 4}" if k % 7 else None))
    long = prose(rng, "en", 3000)
    out += [(100, None, "en", "s0"), (101, "", None, "s1"), (102, " \t\n\n ", "en", "s1"), (103, "12 34 !!", "de", None), (104, long, "en", "s2")]
    out += [(105, out[3][1], "en", "s2"), (106, out[3][1] + " tail", "en", "s3"), (107, long + " end", "en", "s2"), (108, "x" * 5000, "en", "s0"), (109, "two words", "en", "s0"), (110, "TWO words", "en", "s0")]
    out += [(5, out[5][1], "en", "s1"), (None, "a row without a key", "en", "s1"), (111, "it's <|endoftext|> a\u00a0b  c\r\nd é́ 漢字 ½", "en", "s0")]
    return [(*r, 7, "clash", 1, "clash", "clash") for r in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def test_bpe_matches_the_library(docs, none):
    from tokenizers import Tokenizer

    from loomwright.llm.bpe import encode_documents
    from loomwright.llm.queries import vocabulary

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = []
    for r in rows():
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert tuples(encode_documents(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert encode_documents(none, path).count() == 0
    some = encode_documents(docs.where("doc_id = 7"), path, with_ids=True).first()
    assert some["decoded"] == next(r[1] for r in rows() if r[0] == 7)


def test_bpe_on_random_strings():
    from tokenizers import Tokenizer

    from loomwright.llm.bpe import Codec
    from loomwright.llm.queries import vocabulary

    spec = open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read()
    t, codec, rng = Tokenizer.from_str(spec), Codec(spec), random.Random(1)
    texts = ["".join(rng.choice(" \n\t'abthesS12!.<|>\x1c\u00a0éΣ🙂") for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["ab" * 90, "z" * 400]
    for text, packed in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(packed, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(packed) == text


def test_quality_learns_and_holds_out(spark, none):
    from loomwright.llm.quality import score_documents

    rng = random.Random(2)
    data = [(k, prose(rng, "en", 60) if k % 3 else " ".join(w.upper() + "!!" for w in prose(rng, "en", 60).split()), 1 if k % 3 else 0) for k in range(300)]
    data += [(400, None, 1), (401, "", 0), (402, "y" * 9000, None)]
    all_docs = spark.createDataFrame([(k, t) for k, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in data] + [(None, 1), (9999, 0), (3, 0)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in score_documents(all_docs, labels.where("doc_id % 5 <> 0")).collect()}
    assert len(got) == len(data) and all(0 <= s <= 1 for s in got.values())
    held = [(k, y) for k, _, y in data[:300] if k % 5 == 0]
    assert sum((got[k] >= 0.3) == y for k, y in held) >= 0.95 * len(held)
    assert {round(r["score"], 6) for r in score_documents(all_docs, labels.limit(0)).collect()} == {0.5}
    assert score_documents(none, labels).count() == 0


def line_oracle(data: list[tuple], least: int = 40, docs: int = 5) -> list[tuple]:
    key = lambda x: x.strip(BLANKS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for r in data:
        if r[0] is not None:
            for x in (r[1] or "").split("\n"):
                if len(key(x)) >= least:
                    held[key(x)].add(r[0])
    out = []
    for r in data:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if r[0] is None or len(held.get(key(x), ())) < docs or max(held[key(x)]) == r[0]]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(docs, none):
    from loomwright.llm.line_dedup import drop_lines, line_report

    want = line_oracle(rows())
    assert sum(r[2] for r in want) > 5
    assert tuples(line_report(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    left = drop_lines(docs)
    assert left.columns == docs.columns and left.count() == docs.count() and {r["lines"] for r in left.collect()} == {"clash"}
    assert line_report(none).count() == 0 and drop_lines(none).columns == none.columns


def test_near_vectors(spark):
    from loomwright.llm.near_vectors import near_vectors

    rng = np.random.default_rng(3)
    base = rng.normal(size=(1300, 8))
    base[900:] = base[:400] + rng.normal(size=(400, 8)) * 0.12
    data = [(k, [float(v) for v in x], 1 if k < 1250 else 2) for k, x in enumerate(base)]
    data += [(2000 + k, data[0][1], 1) for k in range(30)] + [(3000, None, 1), (3001, [0.0] * 8, 1), (3002, [float("nan")] * 8, 1), (3003, data[0][1], None), (3004, [1.0, None] * 4, 1), (3005, [], 1), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit("clash"))
    fine = [r for r in data if r[2] is not None and r[1] and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1])]
    links, root = Counter(), {r[0]: r[0] for r in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for of in {(r[2], len(r[1])) for r in fine}:
        own = [r for r in fine if (r[2], len(r[1])) == of]
        x = np.array([r[1] for r in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= 0.98):
            if a != b:
                links[own[a][0]] += 1
                p, q = sorted((find(own[a][0]), find(own[b][0])))
                root[q] = p
    want = sorted(((r[0], links[r[0]], find(r[0]), find(r[0]) == r[0]) for r in data), key=repr)
    assert tuples(near_vectors(df), "vec_id", "n_links", "component_id", "kept") == want
    assert near_vectors(df.limit(0)).count() == 0


def test_components(spark):
    from loomwright.llm.components import components

    links = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 199)] + [(300, k) for k in range(301, 340)]
    got = dict(tuples(components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 199: 199, 200: 199, **dict.fromkeys(range(300, 340), 300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_oracle(data: list[tuple], width: int, percent: int) -> list[tuple]:
    import re

    sets = []
    for r in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    low: dict = {}
    for k, r in enumerate(data):
        if r[0] is not None:
            low[find(k)] = min(low.get(find(k), r[0]), r[0])
    return sorted(((r[0], len(sets[k]), low.get(find(k), r[0])) for k, r in enumerate(data)), key=repr)


def near_rows() -> list[tuple]:
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(160)]
    out = []
    for k in range(60):  # a group of near copies, so that stars and cross pairs are needed
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"n{k}-{rng.randrange(9)}"
        out.append((1000 - k, " ".join(w)))
    for k in range(40):  # others that share a passage with it
        out.append((2000 + k, " ".join([f"o{rng.randrange(300)}" for _ in range(80)] + base[:60])))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_shingle_join(spark, docs, none, width, percent):
    from loomwright.llm.shingle_join import near_documents

    data = [r[:2] for r in rows()]
    assert tuples(near_documents(docs, width=width, percent=percent), "doc_id", "n_shingles", "component_id") == shingle_oracle(data, width, percent)
    data = near_rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert tuples(near_documents(df, width=width, percent=percent), "doc_id", "n_shingles", "component_id") == shingle_oracle(data, width, percent)
    assert near_documents(none).count() == 0


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    from loomwright.llm.queries import vocabulary
    from loomwright.llm.token_files import read_token_files, token_files

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want, at = [], 0
    for r in sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    out = str(tmp_path / "tokens")
    assert tuples(token_files(docs, path, 2, out), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    plan = read_token_files(spark, out).where("key = 7").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,7)]" in plan and "tokens:array" not in plan.split("ReadSchema")[1]
    assert token_files(none, path, 2, str(tmp_path / "none")).count() == 0


def test_language_id(docs, none):
    from loomwright.llm.common import fold
    from loomwright.llm.ppm import identify

    got = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(docs, fold(docs["doc_id"], 3) != 1).collect()}
    data = [r for r in rows() if r[0] is not None and r[0] < 60]
    assert sum(got[r[0]][0] == r[2] for r in data) >= 0.95 * len(data)
    assert [got[k] for k in (100, 101, 102, 103)] == [("und", 0.0)] * 4
    assert identify(none, F.lit(True)).count() == 0 and {r["lang_pred"] for r in identify(docs, F.lit(False)).collect()} == {"und"}


def test_language_code_lengths_are_exact():
    from loomwright.llm.ppm import ORDER, Trees

    rng = random.Random(4)
    texts = {k: [prose(rng, k, 50).encode() for _ in range(6)] for k in WORDS}
    trees = Trees(texts)
    fold_ = lambda t: b" " * ORDER + t.lower().replace(b"\n", b" ")
    for j, lang in enumerate(trees.languages):
        counts: dict = defaultdict(Counter)
        for t in map(fold_, texts[lang]):
            for k in range(ORDER, len(t)):
                for o in range(ORDER + 1):
                    counts[t[k - o : k]][t[k]] += 1
        for t in [prose(rng, "en", 20).encode(), "Ünd\nζ!".encode(), b"a"]:
            y, bits = fold_(t), 0.0
            for k in range(ORDER, len(y)):
                p = 1.0
                for o in range(ORDER, -1, -1):
                    c = counts.get(y[k - o : k])
                    if c and y[k] in c:
                        p *= c[y[k]] / (sum(c.values()) + len(c))
                        break
                    p *= len(c) / (sum(c.values()) + len(c)) if c else 1
                else:
                    p /= trees.symbols
                bits -= math.log2(p)
            assert trees.lengths([b"zz", t, b""])[0][1][j] == pytest.approx(bits, rel=1e-4)


def test_url_filter(spark):
    from loomwright.llm.url_filter import judge_urls

    bad = [(k, f"http://bad.example.org/x/{k}") for k in range(40)]
    good = [(100 + k, f"https://ok{k % 5}.site.io/y?z={k}") for k in range(100)]
    odd = [(300, None), (301, "no scheme"), (302, "http://A.com/en/1"), (303, "http://a.EXAMPLE.com/en/77#x"), (304, "http://xcom/en/"), (305, "s://b.example.net/de/8/9"), (306, "http://b.net?/de/"), (307, "http://"), (302, "http://A.com/en/1")]
    pages = spark.createDataFrame(bad + good + odd, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([(k, 0, 0) for k in range(30)] + [(100 + k, 1, 0) for k in range(80)] + [(None, 0, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, labels).collect()}
    assert {got[k][3] for k in range(40)} == {"block"} and {got[100 + k][3] for k in range(100)} == {"allow"}
    assert got[300] == got[301] == ("", "", None, "allow") and got[302] == ("a.com", "/en/1", "com/en/", "block")
    assert got[303] == ("a.example.com", "/en/77", "example.com/en/7", "allow") and got[304] == ("xcom", "/en/", None, "allow")
    assert got[305] == ("b.example.net", "/de/8/9", "example.net/de/8", "block") and got[306][:3] == ("b.net", "", None)
    assert judge_urls(pages, labels).count() == 149
    assert judge_urls(pages.limit(0), labels).count() == 0 and {r["verdict"] for r in judge_urls(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}


def test_sampling_prints(docs, none):
    import re

    from loomwright.llm.sampling_prints import edited_prints

    place = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + (1 << 63)) % (1 << 64)  # noqa: E731  of Spark's xxhash64, signed
    data = sorted(((r[0], r[1] or "") for r in rows()), key=lambda r: (r[0] is None, -(r[0] or 0), place(r[1])))
    got = edited_prints(docs).collect()
    bag = lambda t: Counter(re.findall(r"[^\x20\x09-\x0D]+", t) or [""])
    like = lambda a, b: sum((bag(a) & bag(b)).values()) / sum((bag(a) | bag(b)).values())
    want, exact = [], defaultdict(list)
    for k, (doc, text) in enumerate(data):
        n = data[(k + 1) % len(data)][1]
        h = len(text) // 2
        e = text[: len(text) - h] + n[:h]
        want.append((doc, len(text), hashlib.sha256(e.encode()).hexdigest()))
        exact[want[-1]].append((like(text, e), like(text, n)))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    off = [max(min(abs(r["near_edited"] - e) for e, _ in exact[r["doc_id"], r["n_chars"], r["edited_sha256"]]), min(abs(r["near_next"] - x) for _, x in exact[r["doc_id"], r["n_chars"], r["edited_sha256"]])) for r in got]
    assert sum(off) / len(off) < 0.08 and max(off) < 0.3
    by = {r["doc_id"]: r["fingerprint"] for r in got}
    assert by[100] == by[101] == by[102] and by[105] == by[3] and by[0] != by[1]
    assert edited_prints(none).count() == 0


def test_mixing(docs, none):
    from loomwright.llm.mixing import mix, mix_report

    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums: Counter = Counter()
    for r in rows():
        sums[r[3]] += size(r[1])
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(order)}
    goal, free, left = {}, set(order), 1.5 * sum(sums.values())
    while True:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > 2 * sums[s]}
        if not full:
            goal |= {s: left * weight[s] / total for s in free}
            break
        goal |= {s: 2.0 * sums[s] for s in full}
        left -= sum(goal[s] for s in full)
        free -= full
    got = mix_report(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((r[0], size(r[1])) for r in rows() if r[0] is not None)
    source = {r[0]: r[3] for r in rows() if r[0] != 5}
    taken: Counter = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] != 5:
            assert r["target"] == pytest.approx(goal[source[r["doc_id"]]]) and r["source_size"] == sums[source[r["doc_id"]]]
    for r in got:
        taken[round(r["target"], 6)] += r["taken"]
    for s in order:  # whole documents only: half of the largest can be missing, and here two hold most of one source
        assert abs(taken[round(goal[s], 6)] - goal[s]) <= max(size(r[1]) for r in rows() if r[3] == s) / 2
    assert tuples(mix_report(docs), "doc_id", "taken") == tuples(mix_report(docs), "doc_id", "taken")
    mixed = mix(docs)
    assert mixed.columns == docs.columns and sum(size(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mix_report(none).count() == 0


def test_pipeline(spark, docs, none):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, "")
        if name != "token_ids":
            assert now.columns == docs.columns, name
        if name == "language_id":
            gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in now.collect()}
            assert gone == {100, 101, 102, 103}
        if name == "near_duplicates":
            want = {r[0] for r in shingle_oracle([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80) if r[0] == r[2]}
            assert {r["doc_id"] for r in now.collect()} == want
    assert now.count() > 0 and now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    left = none
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, "")
    assert left.count() == 0
