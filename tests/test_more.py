"""Communities, the cell index, observations and import specifiers against plain Python."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_recall_of_the_cell_index(spark):
    from loomwright import registry

    exact = {(r["q"], r["id"]) for r in registry.QUERIES["cosine_topk"](spark, SF).collect()}
    found = {(r["q"], r["id"]) for r in registry.QUERIES["lsh_topk"](spark, SF).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_observations_take_the_first_rule_that_fits(spark):
    from loomwright.plans.more import observation_kind

    want = [
        ("post-tool-use", '{"tool_name":"Read","file_path":"/a/AGENTS.md"}', "rules"), ("post-tool-use", '{"tool_name":"Read","tool_response":{"error":"no such file"}}', "errors"),
        ("post-tool-use", '{"tool_name":"Bash","tool_input":{"command":"git status"}}', "git-changes"), ("pre-tool-use", '{"tool_name":"Bash","command":"ls"}', "tool-calls"),
        ("post-tool-use", '{"tool_name":"Skill"}', "skills-invoked"), ("user-prompt", '{"prompt":"Act as a judge"}', "role"), ("user-prompt", '{"message":"Decision: we go"}', "decisions"),
        ("session-start", '{"env":{"A":"1"}}', "env-changes"), ("session-start", "{}", "session-settings"), ("session-end", "{}", "lifecycle-raw"), ("user-prompt", None, "lifecycle-raw"),
    ]
    df = spark.createDataFrame([(k, *r[:2]) for k, r in enumerate(want)], "k int, source string, payload string")
    got = df.select("k", observation_kind(F.col("source"), F.col("payload")).alias("c")).orderBy("k").collect()
    assert [r["c"] for r in got] == [r[2] for r in want]


def test_import_specifiers(spark):
    from loomwright.plans.more import resolve_specifiers

    files = spark.createDataFrame([(p,) for p in ["src/a.ts", "src/lib/b.ts", "src/lib/index.ts", "src/c.js", "src/c.ts", "pkg/x/index.js"]], "path string")
    want = {("src/a.ts", "./lib/b"): "src/lib/b.ts", ("src/lib/b.ts", "../c"): "src/c.ts", ("src/a.ts", "./lib"): "src/lib/index.ts", ("src/lib/b.ts", "../../pkg/x"): "pkg/x/index.js", ("src/a.ts", "@x"): "pkg/x/index.js", ("src/a.ts", "@x/y"): None, ("src/a.ts", "react"): None, ("src/a.ts", "./c.js"): "src/c.js"}
    got = resolve_specifiers(spark.createDataFrame(list(want), "file string, spec string"), files, {"@x": "pkg/x"})
    assert {(r["file"], r["spec"]): r["target"] for r in got.collect()} == want


def clustered(spark, n: int = 60):
    """Tables whose memories lie around a few directions, so that thresholds have something to find."""
    import numpy as np

    from loomwright.sources.tables import Tables

    rng = np.random.default_rng(3)
    base = rng.normal(size=(6, 8))
    x = base[np.arange(n) % 6] + rng.normal(size=(n, 8)) * np.where(np.arange(n) % 5 == 0, 0.8, 0.15)[:, None]
    rows = [(k, [float(v) for v in x[k]], f"t{k % 2}", (k % 10) / 10, k % 7, k % 30, k % 3, False, False) for k in range(n)]
    t = Tables(spark, "")
    t._known["memories"] = spark.createDataFrame(rows, "id long, embedding array<double>, type string, importance double, access_count long, age_days long, project_id long, pinned boolean, deleted boolean")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return t, rows, x @ x.T


def test_near_pairs_in_blocks_equal_all_pairs(spark, monkeypatch):
    from loomwright.operators import blocks
    from loomwright.plans import memory

    monkeypatch.setattr(blocks, "BLOCK", 7)
    t, rows, sims = clustered(spark)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if rows[a][2] == rows[b][2] and sims[a, b] >= 0.95}
    got = memory.near_dup_pairs(t).collect()
    assert len(got) == len(want) > 20 and {(r["a"], r["b"]) for r in got} == want and all(abs(r["sim"] - sims[r["a"], r["b"]]) < 1e-5 for r in got)
    assert blocks.near_pairs(t.memories.select("id", F.col("type").alias("part"), "embedding").limit(0), 0.9).count() == 0


def test_duplicates_and_cliques_on_clustered_memories(spark):
    from loomwright.plans import memory

    t, rows, sims = clustered(spark)
    gone: dict[int, int] = {}
    for kind in ("t0", "t1"):
        own = [r[0] for r in rows if r[2] == kind]
        for a in own:
            for b in own:
                if a < b and sims[a, b] >= 0.95 and a not in gone and b not in gone:
                    keep, drop = (a, b) if rows[a][3:5] >= rows[b][3:5] else (b, a)
                    gone[drop] = keep
    assert len(gone) > 10 and {r["id"]: r["kept"] for r in memory.near_dup_removed(t).collect()} == gone
    want = set()
    for project in range(3):
        own, best = sorted((r for r in rows if r[6] == project), key=lambda r: (r[5], -r[0])), []
        for seed in range(len(own)):
            clique = [seed]
            for k in range(len(own)):
                if k != seed and len(clique) < 8 and all(sims[own[k][0], own[c][0]] >= 0.65 for c in clique):
                    clique.append(k)
            best = max(best, clique, key=len)
        want |= {(project, own[k][0]) for k in best} if len(best) > 1 else set()
    assert len(want) > 6 and {(r["project_id"], r["id"]) for r in memory.consolidation_window(t).collect()} == want


def test_embeddings_move_towards_what_was_used(spark):
    import numpy as np

    from loomwright.plans import memory

    t, rows, _ = clustered(spark)
    got = {r["type"]: (r["cosine"], r["first_value"]) for r in memory.embedding_evolve(t).collect()}
    want = {}
    for kind in ("t0", "t1"):
        used = [r for r in rows if r[2] == kind and r[4] >= 3]
        m, x = np.mean([r[1] for r in used], axis=0), np.array(min(used)[1])
        c = x @ m / np.sqrt((x @ x) * (m @ m))
        if c >= 0.5:
            want[kind] = (round(c, 6), round(0.7 * x[0] + 0.3 * m[0], 6))
    assert want and {k: pytest.approx(v, abs=2e-6) for k, v in want.items()} == got


def test_files_of_a_folder(spark, tmp_path):
    import hashlib

    from loomwright.sources.files import read_files

    for path, text in {"a.py": "x", "b.ts": "y", "build/c.py": "z", "lib/d.py": "é", "lib/gen/e.py": "w", "lib/gen/keep.py": "k", "f.md": "m", "big.py": "b" * 200}.items():
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, encoding="utf-8")
    got = {r["path"]: (r["content"], r["hash"]) for r in read_files(spark, str(tmp_path), [".py", ".ts"], ["# made", "build/", "lib/gen/*", "!lib/gen/keep.py"], 100).collect()}
    assert set(got) == {"a.py", "b.ts", "lib/d.py", "lib/gen/keep.py"}
    assert got["lib/d.py"] == ("é", hashlib.sha256("é".encode()).hexdigest())
