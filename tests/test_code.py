"""Symbols with their ends and owners, calls and imports of hand-made files in several languages."""

from __future__ import annotations

import pytest

TS = """// class Ghost { }
import fs, { readFile as read, type Mode } from 'fs';
import * as path from "path";
export { Store as Shelf } from './store';
export * from './all';

export interface Item {
  name: string;
  load(key: string): Item;
}

export class Store extends Base {
  private held = new Map();
  constructor(a: string) { super(a); }
  get(key: string): Item | undefined {
    const text = "function ghost() {";
    if (key) { return this.held.get(key); }
    return lookup(`x${key}`, /[{]\\/x/);
  }
  put(key, item) {
    emit('stored', key);
    const wrap = (x) => {
      inner(x);
    };
    wrap(item);
  }
}

function lookup(a) { return fetch("/api/x"); }
const short = (x) => x + 1;
export const later = async (x) => {
  await read(x);
};
type Pair = { a: string };
"""

PY = '''import os, sys as system
from .store import (Store, Base as Root)

class Ghost:  # class Nothing:
    """def inner(): pass"""

    def first(self, a=(1,
                       2)):
        def nested():
            return helper(a)
        return nested()

    async def second(self):
        os.path.join("a")


def helper(x):
    if x:
        return first(x)

    return None
'''

KT = """package app

/* fun ghost() {} */
data class Item(val name: String)

class Store(private val c: Char = '{') {
    companion object Maker { fun make(): Store = Store('}') }
    fun get(key: String): Item? {
        return held[key] ?: find(key)
    }
}

fun String.find(key: String): Item? { return null }
"""

GO = """package main

type Store struct {
	held map[string]string
}

func (s *Store) Get(key string) string {
	if v := s.held[key]; v != "" {
		return strings.Trim(v, "{")
	}
	return other(key)
}

func other(key string) string { return key }
"""

RS = """pub struct Point<'a> { x: &'a str }

impl<'a> Point<'a> {
    pub fn norm(&self) -> i32 {
        let c = '{';
        helper(self.x)
    }
}

fn helper(x: &str) -> i32 { 1 }
"""


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.ts", "typescript", TS), ("b.py", "python", PY), ("c.kt", "kotlin", KT), ("d.go", "go", GO), ("e.rs", "rust", RS), ("empty.ts", "typescript", ""), ("none.txt", "prose", "class X {"), ("null.ts", "typescript", None)]
    return spark.createDataFrame(rows, "file string, language string, content string").repartition(3)


def found(files):
    from loomwright.operators.code import parsed, symbols

    out: dict = {}
    for r in symbols(parsed(files)).orderBy("file", "m").collect():
        out.setdefault(r["file"], []).append((r["kind"], r["name"], r["line"], r["end_line"], r["parent"]))
    return out


def test_symbols(files):
    got = found(files)
    assert got["a.ts"] == [
        ("interface", "Item", 7, 10, None), ("class", "Store", 12, 27, None), ("method", "get", 15, 19, "Store"), ("method", "put", 20, 26, "Store"), ("function", "wrap", 22, 24, "put"),
        ("function", "lookup", 29, 29, None), ("function", "short", 30, 30, None), ("function", "later", 31, 33, None), ("type", "Pair", 34, 34, None),
    ]
    assert got["b.py"] == [
        ("class", "Ghost", 4, 14, None), ("method", "first", 7, 11, "Ghost"), ("function", "nested", 9, 10, "first"), ("method", "second", 13, 14, "Ghost"), ("function", "helper", 17, 21, None),
    ]
    assert got["c.kt"] == [
        ("class", "Item", 4, 4, None), ("class", "Store", 6, 11, None), ("object", "Maker", 7, 7, "Store"), ("method", "make", 7, 7, "Maker"), ("method", "get", 8, 10, "Store"), ("function", "find", 13, 13, None),
    ]
    assert got["d.go"] == [("type", "Store", 3, 5, None), ("function", "Get", 7, 12, None), ("function", "other", 14, 14, None)]
    assert got["e.rs"] == [("struct", "Point", 1, 1, None), ("function", "norm", 4, 7, None), ("function", "helper", 10, 10, None)]
    assert set(got) == {"a.ts", "b.py", "c.kt", "d.go", "e.rs"}


def test_calls(files):
    from loomwright.operators.code import calls, parsed, symbols

    got: dict = {}
    wide = parsed(files)
    for r in calls(wide, symbols(wide)).collect():
        got.setdefault(r["file"], set()).add((r["line"], r["caller"], r["callee"], r["first"]))
    assert got["a.ts"] >= {
        (17, "get", "this.held.get", None), (18, "get", "lookup", "x${key}"), (21, "put", "emit", "stored"), (23, "wrap", "inner", None), (25, "put", "wrap", None), (29, "lookup", "fetch", "/api/x"), (32, "later", "read", None),
    }
    assert not {c[2] for c in got["a.ts"]} & {"ghost", "put", "if"}
    assert got["b.py"] == {(10, "nested", "helper", None), (11, "first", "nested", None), (14, "second", "os.path.join", "a"), (19, "helper", "first", None)}
    assert {c[1:3] for c in got["d.go"]} == {("Get", "strings.Trim"), ("Get", "other")}
    assert ("get", "find") in {c[1:3] for c in got["c.kt"]} and ("norm", "helper") in {c[1:3] for c in got["e.rs"]}


def test_imports(files):
    from loomwright.operators.code import imports

    got = sorted(tuple(r) for r in imports(files).collect())
    assert got == sorted([
        ("a.ts", "fs", "default", "fs", False), ("a.ts", "fs", "readFile", "read", False), ("a.ts", "fs", "Mode", "Mode", False), ("a.ts", "path", "*", "path", False),
        ("a.ts", "./store", "Store", "Shelf", True), ("a.ts", "./all", "*", "*", True),
        ("b.py", "os", "*", "os", False), ("b.py", "sys", "*", "system", False), ("b.py", ".store", "Store", "Store", True), ("b.py", ".store", "Base", "Root", True),
    ])


def test_long_and_broken_texts(spark):
    from loomwright.operators.code import parsed, symbols

    texts = ['const a = "' + "x\\\\" * 40_000 + '";\nfunction late() { return 1; }', "function open( {\n" * 50, "/* never closed", "`never closed", "}" * 200 + "\nfunction f() {}", "class A {\n" + "  m() { return 1; }\n" * 3000 + "}"]
    df = spark.createDataFrame([(str(k), "typescript", t) for k, t in enumerate(texts)], "file string, language string, content string")
    got = symbols(parsed(df)).collect()
    assert ("0", "late") in {(r["file"], r["name"]) for r in got} and ("4", "f") in {(r["file"], r["name"]) for r in got}
    assert sum(r["file"] == "5" and r["kind"] == "method" and r["parent"] == "A" for r in got) == 3000


def test_chunks_begin_at_outermost_declarations(files):
    from loomwright.plans.code import chunked

    got = {}
    for r in chunked(files.where("content IS NOT NULL")).orderBy("file", "nth").collect():
        got.setdefault(r["file"], []).append((r["line_start"], r["line_end"]))
    assert got["a.ts"] == [(1, 6), (7, 11), (12, 28), (29, 33), (34, 35)] and got["b.py"] == [(1, 16), (17, 22)]
