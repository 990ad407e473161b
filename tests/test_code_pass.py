"""Symbols and chunks come from one pass over each text: no shuffle or window by file, and no text is read twice."""

from __future__ import annotations

from loomwright.operators.outline import outline
from tests.test_code import PY, TS
from tests.test_sizes import plan


def test_nothing_is_shuffled_by_file(spark):
    from loomwright.operators.code import calls, parsed, symbols
    from loomwright.plans.code import chunked

    files = spark.createDataFrame([("a.ts", "typescript", TS), ("b.py", "python", PY)], "file string, language string, content string")
    wide = parsed(files)
    for df in (symbols(wide), calls(wide), chunked(files)):
        text = plan(df).split("== Physical Plan ==")[1]
        assert "Exchange" not in text and "Window" not in text and "Join" not in text and text.count("Scan ExistingRDD") == 1


def test_marks_and_calls_are_left_out_where_nobody_asks(spark):
    from loomwright.operators.code import parsed

    files = spark.createDataFrame([("a.ts", "typescript", TS), ("b.py", "python", PY), ("n", None, "class A {}"), ("c.ts", "typescript", None)], "file string, language string, content string")
    rows = parsed(files, calls=False, marks=False).collect()
    assert len(rows) == 14 and all(r["kind"] and r["callee"] is None for r in rows)


def test_blanks_at_the_end_of_a_line_are_no_indent():
    """A line that ends in blanks before one without indent ends the block; before, its blanks counted as the next line's indent."""
    found, _, _ = outline("def f():\n    pass   \nx = 1\ny = 2\n", "python")
    assert [(s.name, s.line, s.end_line) for s in found] == [("f", 1, 2)]
    assert outline("", "python")[0] == [] and outline("class X", "prose")[2] is None


def test_many_declarations_in_one_text():
    """Work grows with the text, not with the square of its declarations."""
    deep = 300
    text = "\n".join(f"{' ' * k}def f{k}():" for k in range(deep)) + "\n" + "\n".join(f"def g{k}(): h()" for k in range(20_000))
    found, called, _ = outline(text, "python")
    assert len(found) == deep + 20_000 and {s.end_line for s in found[:deep]} == {deep} and found[-1].parent is None
    assert [c.caller for c in called] == [f"g{k}" for k in range(20_000)]
