"""Queries over whole tables on small made-up ones, against plain Python."""

from __future__ import annotations

import random
from collections import Counter

from loomwright import registry
from loomwright.plans import graph
from loomwright.sources.tables import Tables
from tests.test_operators import reach

STEPS = [(101, 203), (203, 305), (305, 101), (305, 417), (417, 519), (519, 417), (623, 725), (827, 827), (929, 623)]


def folder(spark, tmp_path, **tables) -> str:
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def imports(spark, tmp_path) -> str:
    """Tables whose imports are STEPS."""
    rows = [(k, p, 1, n) for k, step in enumerate(STEPS) for n, p in enumerate(step)]
    return folder(spark, tmp_path, lineitem=(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"))


def test_graph_queries_see_every_edge(spark, tmp_path):
    d = imports(spark, tmp_path)
    nodes, edges = {n for e in STEPS for n in e}, set(STEPS)
    r, both = reach(edges, nodes), reach(edges | {(b, a) for a, b in edges}, nodes)
    of = lambda name, c: {x["id"]: x[c] for x in registry.QUERIES[name](spark, d).collect()}
    assert of("connected_components", "root") == {n: min(both[n]) for n in nodes}
    assert of("scc_cycles", "root") == {n: min(m for m in r[n] if n in r[m]) for n in nodes}
    found = of("communities", "community")
    assert set(found) == {n for a, b in STEPS if a != b for n in (a, b)} and all(found[n] in both[n] for n in found)


def test_chains_are_the_first_in_order_and_end_rightly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph, "CHAINS", 7)
    rng = random.Random(4)
    edges = {(50 * rng.randrange(1, 4), rng.randrange(1, 30)) for _ in range(9)} | {(rng.randrange(1, 30), rng.choice([rng.randrange(1, 30), 50, 100])) for _ in range(60)}
    rows = [(k, p, 1, n) for k, step in enumerate(sorted(edges)) for n, p in enumerate(step)]
    d = folder(spark, tmp_path, lineitem=(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"))

    def chains(path):
        after = sorted(b for a, b in edges if a == path[-1])
        if len(path) > graph.STEPS or not after:
            return [(path, False)]
        out = [(path, True)] if any(b in path for b in after) else []
        return out + [c for b in after if b not in path for c in chains((*path, b))]

    want = set()
    for start in {a for a, _ in edges if a % 50 == 0}:
        first = sorted(chains((start,)))[:7]
        want |= {(start, ">".join(map(str, p)) + ("↺" if circle else ""), len(p) - 1) for p, circle in first}
    assert {tuple(r) for r in registry.QUERIES["trace_chains"](spark, d).collect()} == want


def test_searches_take_every_fiftieth_row_in_blocks(spark, tmp_path, monkeypatch):
    """More queries than a block holds, beyond the first ids: each has its own rows."""
    from loomwright.operators import ranking

    monkeypatch.setattr(ranking.in_blocks, "__defaults__", (3,))
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(64)], k % 4) for k in range(400, 1000)]
    d = folder(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    for name, each in {"cosine_topk": 10, "bq_two_phase": 5, "semantic_rank": 600, "recall": 20}.items():
        got = Counter(r["q"] for r in registry.QUERIES[name](spark, d).collect())
        assert got == dict.fromkeys(range(400, 1000, 50), each), name


def test_query_terms_come_from_the_whole_text(spark, tmp_path):
    """The only word that meets a text stands past the first characters."""
    text = "alpha " * 20 + "zebra"
    docs = [(7, "a zebra here", "en", "s", 12), (8, "nothing here", "en", "s", 12)]
    d = folder(spark, tmp_path, benchmark=([(1, text)], "item_id long, text string"), documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"))
    of = lambda name: registry.QUERIES[name](spark, d).collect()
    for name in ("query_terms", "fts_terms"):
        assert {r["term"] for r in of(name)} == {"alpha", "zebra"}, name
    assert [r["id"] for r in of("keyword_search")] == [7]


def test_languages_of_the_whole_cascade(spark, tmp_path):
    texts = {
        "kotlin": ["fun f(x)", "package a.b\nval x: Int = 1", "import a.b\nsealed class C"],
        "dart": ["void main() {}", "part of 'x.dart';", "import 'dart:io';", "library a;\nclass B", "mixin M on N"],
        "typescript": ["import { a } from 'b'; let x: int", "import a from 'b'; interface C"],
        "javascript": ["import a from 'b'"],
        "python": ["def f():"],
        "rust": ["fn f() -> i32"],
        "go": ["package main\nfunc f"],
        "unknown": ["", "words alone", "<script>"],
    }
    rows = [(k, "u", x, name) for k, (name, x) in enumerate((n, x) for n, xs in texts.items() for x in xs)]
    d = folder(spark, tmp_path, pages=([r[:3] for r in rows], "page_id long, url string, html string"))
    assert {r["page_id"]: r["language"] for r in registry.QUERIES["detect_code_language"](spark, d).collect()} == {r[0]: r[3] for r in rows}


def test_fixed_chunks_hold_every_line(spark, tmp_path):
    text = "\n".join(f"line {k}" for k in range(120))
    d = folder(spark, tmp_path, documents=([(5, text, "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long"))
    got = registry.QUERIES["chunk_fixed"](spark, d).toPandas()
    assert len(got) == 3 and "\n".join(got.sort_values(got.columns[1])[got.columns[-1]]) == text


def test_memory_bfs_goes_to_its_depth(spark, tmp_path):
    """With edges that lead on, and weak ones."""
    t = Tables(spark, "")
    t._known["memory_edges"] = spark.createDataFrame([("s3", "a", 0.1), ("a", "b", 0.9), ("b", "c", 0.9), ("c", "d", 0.9)], "from_id string, to_id string, weight double")
    assert {r["id"]: r["depth"] for r in graph.memory_bfs(t).collect()} == {"s3": 0, "a": 1, "b": 2, "c": 3}
