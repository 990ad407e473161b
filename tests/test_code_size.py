"""Of languages with braces, only tokens that symbols and calls need are written."""

from loomwright.operators.code import calls, parsed, symbols


def test_tokens_that_nothing_needs_are_not_written(spark):
    files = spark.createDataFrame([("a.ts", "typescript", "import { f as g } from './b';\nclass C {\n  run(x) { return g(x + 1 * 2); }\n}\n")], "file string, language string, content string")
    wide = parsed(files)
    assert {r["text"] for r in wide.collect()} == {"import", "{", "}", ";", "class", "run", "return", "g"}
    declared = symbols(wide)
    assert [(r["kind"], r["name"], r["line"], r["end_line"], r["parent"]) for r in declared.orderBy("m").collect()] == [("class", "C", 2, 4, None), ("method", "run", 3, 3, "C")]
    assert [(r["caller"], r["callee"]) for r in calls(wide, declared).collect()] == [("run", "g")]
