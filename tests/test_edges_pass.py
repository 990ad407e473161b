"""Calls are resolved from one pass over the texts: imports of one local name, re-exports, names that a file or nobody declares."""

from __future__ import annotations

FILES = {
    "a.ts": "import { f as g } from './d/b';\nimport { h } from './b';\nimport { h } from './d/../c';\nimport * as ns from './d';\nimport x from 'fs';\nexport class A {\n  run() { g(); h(); ns.f(); ns.gone(); own(); lone(); x(); none(); }\n}\nfunction own() { return g(); }\n",
    "b.ts": "export function h() { return 1; }\n",
    "c.ts": "export function h() { return 2; }\nexport function lone() { return 3; }\n",
    "d/b.ts": "export { f } from '.';\n",
    "d/index.ts": "export * from './deep';\n",
    "d/deep.ts": "export function f() { return 4; }\n",
}
WANT = {
    ("run", "g", "import", "d/deep.ts", "f"), ("run", "h", "import", "b.ts", "h"), ("run", "ns.f", "namespace", "d/deep.ts", "f"), ("run", "ns.gone", "assumed", "d/index.ts", "gone"), ("run", "own", "local", "a.ts", "own"),
    ("run", "lone", "global", "c.ts", "lone"), ("run", "x", None, None, None), ("run", "none", None, None, None), ("own", "g", "import", "d/deep.ts", "f"),
}


def test_edges_of_a_few_modules(spark):
    from loomwright.plans.code import edges

    files = spark.createDataFrame([(f, "typescript", t) for f, t in FILES.items()], "file string, language string, content string")
    got = [(r["module"], r["caller"], r["callee"], r["found"], r["target_module"], r["target"]) for r in edges(files).collect()]
    assert {r[1:] for r in got} == WANT and {r[0] for r in got} == {"a.ts"} and len(got) == len(WANT)


def test_texts_are_read_once(spark):
    """Before, the texts were made four times over: for tokens, and each time that imports were used."""
    from pyspark.sql import functions as F

    from loomwright.plans.code import edges

    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: (made.add(1), t)[1], "string").asNondeterministic()
    files = spark.createDataFrame([(f, "typescript", t) for f, t in FILES.items()], "file string, language string, content string").withColumn("content", seen("content"))
    assert len(edges(files).collect()) == len(WANT) and made.value == len(FILES)
