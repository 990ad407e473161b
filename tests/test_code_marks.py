"""Languages by their marks, kinds of calls, names of tools, JSON patches and array literals, on samples of our own."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

SAMPLES = {
    "python": "import os\n\nclass Store(Base):\n    def get(self, key: str) -> str:\n        # function of interface\n        if key:\n            return self.held[key]\n        elif other:\n            pass\n",
    "rust": 'pub struct Point { x: i32 }\nimpl Point {\n    pub fn norm(&self) -> i32 {\n        let mut total = 0;\n        println!("def f(): {}", total);\n        total\n    }\n}\n',
    "go": 'package main\n\nimport "fmt"\n\nfunc (s *Store) Get(key string) string {\n\tdefer s.lock()\n\tv := s.held[key]\n\treturn v\n}\n',
    "kotlin": "package app.store\n\ndata class Item(val name: String)\n\nclass Store {\n    companion object { val first = 1 }\n    fun get(key: String): Item? = held[key] ?: null\n}\n",
    "dart": "import 'dart:io';\n\nmixin Walks {}\n\nvoid main() async {\n  final String name = read();\n  Future<int> later = wait(name);\n}\n",
    "typescript": "import { a } from './a';\nexport interface Item { name: string; size: number }\nconst get = (key: string): Item => held[key];\n",
    "javascript": "const a = require('./a');\nfunction get(key) {\n  if (key === 'x') { return null; }\n  var n = 1;\n  return held.map(x => x + n);\n}\n",
    "unknown": "Plain prose, which says nothing of code.\nAnother line.",
}


def test_languages(spark):
    from loomwright.plans.texts import code_language

    df = spark.createDataFrame(list(SAMPLES.items()), "want string, text string")
    assert {r["want"]: r["got"] for r in df.select("want", code_language(F.col("text")).alias("got")).collect()} == {k: k for k in SAMPLES}
    empty = spark.createDataFrame([("",), ("// def f():\n# let mut\n'fn x'",)], "t string").select(code_language(F.col("t")).alias("l"))
    assert [r["l"] for r in empty.collect()] == ["unknown", "unknown"]


def test_calls(spark):
    from loomwright.plans.more import edge_of_call

    want = [
        ("bus.emit", None, "emit"), ("emit", None, "emit"), ("bus.on", None, "listen"), ("on", None, "listen"), ("trpc.on", None, "call"), ("trpc.item.query", None, "http_call"), ("trpc.subscribe", None, "http_call"),
        ("store.subscribe", None, "listen"), ("axios.get", None, "http_call"), ("cache.get", None, "call"), ("get", None, "call"), ("window.fetch", None, "http_call"), ("gql", None, "http_call"),
        ("load", "https://x.org/a", "http_call"), ("load", "/api", "http_call"), ("load", "/apiary", "call"), ("a.b.load", "x", "call"), ("http.patch", None, "http_call"),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(want)], "k int, target string, first string, want string")
    got = df.select("k", edge_of_call(F.col("target"), F.col("first")).alias("got")).orderBy("k").collect()
    assert [r["got"] for r in got] == [r[2] for r in want]


def test_other_names_of_tools(spark):
    from loomwright.plans.more import observation_kind

    want = {"read_file": "files-read", "write_file": "files-written", "edit_file": "files-written", "glob": "file-search", "shell": "tool-calls", "run_shell_command": "tool-calls", "Read": "files-read", "grep": "file-search", "unheard_of": "lifecycle-raw"}
    df = spark.createDataFrame([(k, json.dumps({"tool_name": k})) for k in want], "k string, p string")
    assert {r["k"]: r["c"] for r in df.select("k", observation_kind(F.lit("pre-tool-use"), F.col("p")).alias("c")).collect()} == want
    rule = spark.createDataFrame([(json.dumps({"toolName": "read_file", "path": "x/CLAUDE.md"}),), (json.dumps({"tool_name": "shell", "command": "git push"}),)], "p string")
    assert [r["c"] for r in rule.select(observation_kind(F.lit("pre-tool-use"), F.col("p")).alias("c")).collect()] == ["rules", "git-changes"]


def test_patched_objects_stay_json(spark):
    from loomwright.plans.more import patched

    texts = ['{"k":"a b","n":3,"o":{"x":[1,"y"]},"q\\"t":true,"seen":false}', "{}", "no json", "[1]", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    got = [json.loads(r["p"]) for r in df.select("k", patched(F.col("t"), "seen", '{"by":"me"}').alias("p")).orderBy("k").collect()]
    assert got[0] == {"k": "a b", "n": 3, "o": {"x": [1, "y"]}, 'q"t': True, "seen": {"by": "me"}} and got[1:] == [{"seen": {"by": "me"}}] * 4


def test_array_literals(spark):
    from loomwright.plans.more import array_elements, array_text

    arrays = [["a", 'x",y', "", None, "NULL", "b c", "{}", "back\\slash", "line\nbreak", "ü"], ["one"], [" lead"]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(arrays)], "k int, a array<string>")
    assert [r["b"] for r in df.select("k", array_elements(array_text(F.col("a"))).alias("b")).orderBy("k").collect()] == arrays
    odd = spark.createDataFrame([("{a, \"b,c\" ,null}",), ("{}",), ("none",)], "t string")
    assert [r["b"] for r in odd.select(array_elements(F.col("t")).alias("b")).collect()] == [["a", "b,c", None], [], None]
