"""Symbols, calls and imports of source texts. `outline` reads each text once, in Arrow batches; nothing is shuffled by file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.outline import LANGUAGES, base, outline
from loomwright.operators.outline import imports as imported

_FIELDS = {"file": "string", "language": "string", "m": "int", "line": "bigint", "text": "string", "kind": "string", "name": "string", "end_line": "bigint", "end_m": "int", "parent": "string", "caller": "string", "callee": "string", "first": "string"}
_IMPORTS = {"file": "string", "spec": "string", "name": "string", "local": "string", "reexport": "boolean"}
_MODULES = {"what": "string", "file": "string", "name": "string", "base": "string", "local": "string", "reexport": "boolean", "caller": "string", "callee": "string", "own_root": "boolean", "several": "boolean"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
#: Rows of one Arrow batch of results, about.
ROWS = 20_000


def parsed(files: DataFrame, calls: bool = True, marks: bool = True) -> DataFrame:
    """files: file, language, content. What `symbols` and `calls` take: a row for each declaration (with kind), for each call (with callee), and with `marks` for each other token that
    begins or ends a statement or a block, may declare, or is a word before a bracket. Read as often as it is used: who uses it twice writes it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for file, language, text in zip(*(b.column(c).to_pylist() for c in ("file", "language", "content")), strict=True):
                found, called, x = outline(text, language, calls)
                if marks and x:
                    known = {s.m for s in found} | {c.m for c in called}
                    rows += [(file, language, m, x.line[m], x.text[m], *[None] * 8) for m in x.marks if m not in known]
                rows += [(file, language, s.m, s.line, x.text[s.m], s.kind, s.name, s.end_line, s.end_m, s.parent, None, None, None) for s in found]
                rows += [(file, language, c.m, c.line, x.text[c.m], *[None] * 5, c.caller, c.callee, c.first) for c in called]
                if len(rows) >= ROWS:
                    yield packed(rows, _FIELDS)
                    rows = []
        if rows:
            yield packed(rows, _FIELDS)

    known = files.where(F.col("language").isin(LANGUAGES) & F.col("content").isNotNull()).select("file", "language", "content")
    return known.mapInArrow(work, _schema(_FIELDS))


def packed(rows: list[tuple], fields: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))


def _schema(fields: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields.items())


def symbols(wide: DataFrame) -> DataFrame:
    """wide: of `parsed`. Per declaration: file, language, kind, name, line, end_line, parent (of the innermost one around it), m, end_m."""
    return wide.where("kind IS NOT NULL").select("file", "language", "kind", "name", "line", "end_line", "parent", "m", "end_m")


def calls(wide: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """wide: of `parsed`, which knows its own symbols, so `declared` is not read. Per call: file, line, caller (the innermost symbol around it, null at the top), callee (a dotted name), first (its first argument if that is a text)."""
    return wide.where("callee IS NOT NULL").select("file", "line", "caller", "callee", "first")


def imports(files: DataFrame) -> DataFrame:
    """Per imported name: file, spec, name (`default`, or `*` for all), local (what it is called here), reexport. Of ES modules and Python."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(file, *x) for file, language, text in zip(*(b.column(c).to_pylist() for c in ("file", "language", "content")), strict=True) for x in imported(text, language)]
            for k in range(0, len(rows), ROWS):
                yield packed(rows[k : k + ROWS], _IMPORTS)

    return files.select("file", "language", "content").mapInArrow(work, _schema(_IMPORTS))


def modules(files: DataFrame) -> DataFrame:
    """What resolving the calls of ES modules takes, of one pass over their texts. `what` tells rows apart:

    file: each file. own: `name` that it declares at the top. import: an imported name, with `base`, the path that its specifier names, if that is relative. call: with caller and
    callee; own_root says whether the file itself declares the callee's root, base and name are those of the one import that has it as local name; `several` marks calls of which there are
    more. Imports that are no re-exports have rows only for such calls' sake.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for file, language, text in zip(*(b.column(c).to_pylist() for c in ("file", "language", "content")), strict=True):
                found, called, _ = outline(text, language)
                own = {s.name for s in found if s.parent is None}
                given: dict[str, set] = {}
                rows.append(("file", file, *[None] * 8))
                rows += [("own", file, name, *[None] * 7) for name in own]
                for x in imported(text, language):
                    at = base(file, x.spec)
                    if x.reexport:
                        rows.append(("import", file, x.name, at, x.local, True, *[None] * 4))
                    elif at is not None:
                        given.setdefault(x.local, set()).add((x.name, at))
                for local, of in given.items():
                    if len(of) > 1:
                        rows += [("import", file, name, at, local, False, *[None] * 4) for name, at in of]
                for c in called:
                    root = c.callee.split(".", 1)[0]
                    of = given.get(root, ())
                    name, at = next(iter(of)) if len(of) == 1 else (None, None)
                    rows.append(("call", file, name, at, None, None, c.caller, c.callee, root in own, len(of) > 1))
                if len(rows) >= ROWS:
                    yield packed(rows, _MODULES)
                    rows = []
        if rows:
            yield packed(rows, _MODULES)

    return files.select("file", "language", "content").mapInArrow(work, _schema(_MODULES))
