"""Declarations and calls of one source text, in one pass over its tokens; `code` runs it over tables.

One pattern per family of languages cuts a text into comments, strings, words, signs and blanks, which together make up the text. What is in comments and strings is no
code. Brackets get a running depth; a bracket's partner is the next one of its depth. A declaration's block is the next block of its depth that opens before another
statement there does; in Python it ends before the next line that is indented no deeper. Owners, of symbols and of calls, are the innermost spans that hold them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Languages by family: with quotes of either sort for strings, with single quotes for one character, and by indentation.
QUOTED, CHARACTERS, INDENTED = ["typescript", "javascript", "dart"], ["kotlin", "rust", "go", "java", "c"], ["python"]
_TEXT = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
_TICK = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`?"
_FIRST = r"[A-Za-z_$][\w$]*+|\s++|\d[\w.]*+"  # no other token begins as these do
_REST = r"=>|->|:=|."
_BEFORE = r"[(,=:\[!&|?{};]"
_REGEX = rf"(?:(?<={_BEFORE})|(?<={_BEFORE}\s)|(?<={_BEFORE}\s\s)|(?<={_BEFORE}\s\s\s))/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*+\]|[^/\\\n\[])++/[a-z]*"
PATTERNS = {
    "quoted": rf"{_FIRST}|/\*.*?(?:\*/|\Z)|//[^\n]*+|{_TEXT}|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|{_TICK}|{_REGEX}|{_REST}",
    "characters": rf"""{_FIRST}|/\*.*?(?:\*/|\Z)|//[^\n]*+|\"\"\".*?(?:\"\"\"|\Z)|{_TEXT}|'(?:\\.[^'\n]{{0,8}}|[^'\\\n])'|{_TICK}|{_REST}""",
    "indented": rf"""{_FIRST}|\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|{_TEXT}|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|#[^\n]*+|{_REST}""",
}
#: What declares a symbol, by language: word and kind. The name is the next word.
DECLARES = {
    "typescript": {"class": "class", "interface": "interface", "enum": "enum", "namespace": "module", "function": "function", "type": "type"},
    "javascript": {"class": "class", "function": "function"},
    "dart": {"class": "class", "mixin": "class", "enum": "enum", "extension": "class"},
    "kotlin": {"class": "class", "interface": "interface", "object": "object", "fun": "function"},
    "rust": {"struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "fn": "function"},
    "go": {"type": "type", "func": "function"},
    "java": {"class": "class", "interface": "interface", "enum": "enum"},
    "c": {"struct": "struct", "enum": "enum"},
    "python": {"class": "class", "def": "function"},
}
#: Words before a bracket that call nothing and declare nothing.
CONTROL = {"if", "for", "while", "switch", "catch", "return", "function", "fun", "fn", "func", "def", "class", "elif", "and", "or", "not", "in", "is", "with", "when", "match", "else", "do", "try", "await", "typeof", "assert", "import", "constructor", "except", "lambda", "yield", "raise"}
#: Words that begin another statement of a block.
STARTS = {"const", "let", "var", "val", "return", "export", "import", "public", "private", "protected", "static"}
NESTS = {"class", "interface", "object", "struct", "trait", "enum"}
#: Words and signs after which a word before a bracket declares no method, or is no call.
_NO_METHOD = {".", "new", "function", "fun", "func", "fn", "def", ")", "=", "(", ","}
_NO_CALL = {"function", "fun", "func", "fn", "def", "class"}

_FAMILY = {x: name for name, of in (("quoted", QUOTED), ("characters", CHARACTERS), ("indented", INDENTED)) for x in of}
LANGUAGES = list(_FAMILY)
_CUT = {name: re.compile(p, re.DOTALL | re.ASCII).findall for name, p in PATTERNS.items()}
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
_BLANKS, _QUOTES = frozenset(" \t\n\v\f\r"), frozenset("\"'`")
_STATES = {x: STARTS | {";"} | set(of) for x, of in DECLARES.items()}
_NO_END = 2**24 - 1
_ENDS = re.compile("^.|.$")


class Symbol(NamedTuple):
    kind: str
    name: str
    line: int
    end_line: int
    parent: str | None
    m: int
    end_m: int


class Call(NamedTuple):
    m: int
    line: int
    caller: str | None
    callee: str
    first: str | None


class _Found(NamedTuple):
    """A declaration before its owner is known."""

    kind: str
    name: str
    typed: bool
    depth: int
    m: int
    line: int
    block: bool
    end_m: int
    end_line: int


class _Tokens(NamedTuple):
    """Of the tokens of code: text, line, depth; the partner of brackets that are closed; those that may matter; in Python those that begin a line, with its indent."""

    text: list[str]
    line: list[int]
    depth: dict[int, int]
    close: dict[int, int]
    marks: list[int]
    firsts: dict[int, int]


def tokens(text: str, language: str) -> _Tokens:
    family = _FAMILY[language]
    indented, states = family == "indented", _STATES[language]
    code, lines, depth, close, marks, firsts, stack = [], [], {}, {}, [], {}, []
    line, level, lead = 1, 0, 0  # lead: blanks before the first token of a line, -1 for other tokens
    for n, t in enumerate(_CUT[family](text)):
        c = t[0]
        if c in _LETTERS:
            if t in states:
                depth[len(code)] = level
                marks.append(len(code))
        elif c in _BLANKS:
            k = t.count("\n")
            line += k
            if k or not n:
                lead = len(t) - t.rfind("\n") - 1
            continue
        elif c == "(" or c == "[" or c == "{":
            m = len(code)
            if c == "(" and m and code[m - 1][0] in _LETTERS and (not marks or marks[-1] != m - 1):
                depth[m - 1] = level
                marks.append(m - 1)
            elif c == "{":
                marks.append(m)
            depth[m] = level
            level += 1
            stack.append(m)
        elif c == ")" or c == "]" or c == "}":
            m = len(code)
            level -= 1
            depth[m] = level
            if stack:
                close[stack.pop()] = m
            if c == "}":
                marks.append(m)
        elif c == ";":
            depth[len(code)] = level
            marks.append(len(code))
        elif c in _QUOTES or c == "/" or c == "#":
            if (c == "/" and t[1:2] in ("/", "*")) or (c == "#" and indented):
                line += t.count("\n")
                lead = -1
                continue
            if indented and lead >= 0:
                firsts[len(code)] = lead
                depth[len(code)] = level
            lead = -1
            code.append(t)
            lines.append(line)
            line += t.count("\n")
            continue
        if indented and lead >= 0:
            firsts[len(code)] = lead
            depth.setdefault(len(code), level)
        lead = -1
        code.append(t)
        lines.append(line)
    return _Tokens(code, lines, depth, close, marks, firsts)


def _braced(x: _Tokens, language: str) -> list[_Found]:
    """Declarations of languages with braces, with the places that they reach to: to what comes first at their depth, a block, the end of the statement, or another one."""
    text, line, close = x.text, x.line, x.close
    of, size, scripts = DECLARES[language], len(text), language in ("typescript", "javascript")
    at = lambda k: text[k] if 0 <= k < size else ""
    word = lambda t: t[:1] in _LETTERS and t != ""
    after = lambda k: at(close[k] + 1) if k in close else ""  # noqa: E731  what follows a bracket's partner
    methods = language not in ("go", "rust", "kotlin")
    found: list[_Found] = []
    waits: dict[int, tuple] = {}
    for m in x.marks:
        t, depth = text[m], x.depth[m]
        kind = name = None
        typed = False
        if t in of:
            t1 = at(m + 1)
            if language == "go" and t == "func" and t1 == "(":
                name = after(m + 1)
            elif t == "function" and t1 == "*":
                name = at(m + 2)
            elif t == "fun" and at(m + 2) == ".":
                name = at(m + 3)
            else:
                name = t1
            if word(name) and name not in of and at(m - 1) not in (".", "new") and (t != "type" or language == "go" or at(m + 2) in ("=", "<")):
                kind = of[t]
        elif t in ("const", "let", "var"):
            if scripts and at(m + 2) == "=" and word(at(m + 1)):
                t3, t4 = at(m + 3), at(m + 4)
                if t3 == "function" or (t3 == "(" and after(m + 3) == "=>") or (word(t3) and t4 == "=>") or (t3 == "async" and (t4 == "function" or (t4 == "(" and after(m + 4) == "=>") or word(t4))):
                    kind, name = "function", at(m + 1)
        if kind is None and methods and at(m + 1) == "(" and t not in CONTROL and t not in of and word(t) and at(m - 1) not in _NO_METHOD:
            follows = after(m + 1)
            if follows in ("{", ":") or (follows == "async" and language == "dart"):
                kind, name, typed = "method", t, follows == ":"
        if kind is None and t not in ("{", "}", ";") and t not in STARTS:
            continue
        if depth in waits:
            found.append(_reach(*waits.pop(depth), m, x))
        if kind is not None:
            waits[depth] = (kind, name, typed, depth, m)
    found += [_Found(*w, line[w[4]], False, w[4] + 1, line[w[4]]) for w in waits.values()]
    found.sort(key=lambda f: f.m)
    return found


def _reach(kind: str, name: str, typed: bool, depth: int, m: int, next_m: int, x: _Tokens) -> _Found:
    t, line = x.text[next_m], x.line[m]
    if t == "{":
        end = x.close.get(next_m)
        return _Found(kind, name, typed, depth, m, line, True, _NO_END if end is None else end, line if end is None else x.line[end])
    return _Found(kind, name, typed, depth, m, line, False, next_m if t == ";" else m + 1, x.line[next_m] if t == ";" else line)


def _indented(x: _Tokens) -> list[_Found]:
    """Declarations of languages that indent: a block ends before the next line that is indented no deeper."""
    of, text, line = DECLARES["python"], x.text, x.line
    outer = [(m, indent) for m, indent in x.firsts.items() if x.depth[m] == 0]
    heads = [m for m in x.marks if text[m] in of and m + 1 < len(text) and text[m + 1][0] in _LETTERS and (m in x.firsts or (m and text[m - 1] == "async"))]
    begins = list(x.firsts.items())
    # from the last head to the first, with the lines after it that may end a block: each indented less than the one before it
    found, k, b = [], len(outer) - 1, len(begins) - 1
    after: list[tuple[int, int]] = []
    for m in reversed(heads):
        while k >= 0 and outer[k][0] > m:
            while after and after[-1][1] >= outer[k][1]:
                after.pop()
            after.append(outer[k])
            k -= 1
        while begins[b][0] > m:
            b -= 1
        own = begins[b][1]
        low, high = 0, len(after)  # indents grow towards the end of `after`, as places fall
        while low < high:
            middle = (low + high) // 2
            if after[middle][1] <= own:
                low = middle + 1
            else:
                high = middle
        end = after[low - 1][0] - 1 if low else len(text) - 1
        found.append(_Found(of[text[m]], text[m + 1], False, x.depth[m], m, line[m], True, end, line[end]))
    return found[::-1]


def _calls(x: _Tokens, language: str, kept: list[Symbol]) -> list[Call]:
    text, size = x.text, len(x.text)
    at = lambda k: text[k] if k >= 0 else ""
    word = lambda t: t != "" and t[0] in _LETTERS
    heads = {s.m: s.name for s in kept}
    out, open_ = [], []
    k = 0
    for m in x.marks:
        t = text[m]
        while k < len(kept) and kept[k].m <= m:
            open_.append(kept[k])
            k += 1
        if m + 1 >= size or text[m + 1] != "(" or t in CONTROL or not word(t):
            continue
        p1 = at(m - 1)
        if p1 in _NO_CALL or (p1 == ")" and language == "go"):
            continue
        callee = t
        if p1 == "." and word(at(m - 2)):
            callee = f"{at(m - 2)}.{t}"
            if at(m - 3) == "." and word(at(m - 4)):
                callee = f"{at(m - 4)}.{callee}"
        if heads.get(m) == callee:  # a method's own head
            continue
        while open_ and open_[-1].end_m < m:  # later calls lie behind its end too
            open_.pop()
        t2 = text[m + 2] if m + 2 < size else ""
        out.append(Call(m, x.line[m], open_[-1].name if open_ else None, callee, _ENDS.sub("", t2) if t2 and t2[0] in _QUOTES else None))
    return out


def outline(text: str | None, language: str | None, calls: bool = True) -> tuple[list[Symbol], list[Call], _Tokens | None]:
    """Symbols and calls of a text in the order of their places m, from 0; none of texts in other languages."""
    if text is None or language not in _FAMILY:
        return [], [], None
    x = tokens(text, language)
    found = _indented(x) if language in INDENTED else _braced(x, language)
    kept: list[Symbol] = []
    around: list[_Found] = []
    for f in found:
        while around and around[-1].end_m < f.m:
            around.pop()
        span = around[-1] if around else None
        nested = span is not None and span.kind in NESTS
        # a name with brackets and a type is a method only right within a class; a function there is one too
        if not f.typed or (nested and f.block and f.depth == span.depth + 1):
            kind = "method" if f.kind == "function" and nested else "function" if f.kind == "method" and span is None else f.kind
            kept.append(Symbol(kind, f.name, f.line, f.end_line, span and span.name, f.m, f.end_m))
        if f.block:
            around.append(f)
    return kept, _calls(x, language, kept) if calls else [], x


class Import(NamedTuple):
    spec: str
    name: str
    local: str
    reexport: bool


_REMARKS = re.compile(r"/(?:\*.*?\*/|(?<![:'\"]/)/[^\n]*)", re.DOTALL)
_FROM = re.compile(r"""(?u:\b)(import|export)\s+(?:type\s+)?([\w$*{}\s,]+?)\s*from\s*['"]([^'"\n]+)['"]""", re.DOTALL | re.ASCII)
_NAMES = re.compile(r"([\w$*]+)(?:\s+as\s+([\w$]+))?", re.ASCII)
_BRACES, _SPACES = re.compile(r"\{([^}]*)\}"), re.compile(r"\s+", re.ASCII)
_ENDS_LINE = r"\n\r\u0085\u2028\u2029"
_HASH = re.compile(rf"#[^{_ENDS_LINE}]*")
_PY_FROM = re.compile(rf"(?:\A|(?<=[{_ENDS_LINE}]))\s*from\s+([\w.]+)\s+import\s+(\([^)]*\)|[^\n]+)", re.ASCII)
_PY_IMPORT = re.compile(rf"(?:\A|(?<=[{_ENDS_LINE}]))\s*import\s+([^\n]+)", re.ASCII)
_MODULE = re.compile(r"([\w.]+)(?:\s+as\s+(\w+))?", re.ASCII)


def _named(x: str, pattern: re.Pattern = _NAMES) -> tuple[str, str]:
    m = pattern.search(x)
    return (m[1], m[2] or m[1]) if m else ("", "")


def _clean(xs: str) -> list[str]:
    return [y for x in xs.split(",") if (y := _SPACES.sub(" ", x).strip(" ").removeprefix("type "))]


def imports(text: str | None, language: str | None) -> list[Import]:
    """Per imported name: spec, name (`default`, or `*` for all), local (what it is called here), reexport. Of ES modules and Python."""
    out: list[Import] = []
    if text is None:
        return out
    if language in ("typescript", "javascript"):
        for word, clause, spec in _FROM.findall(_REMARKS.sub(" ", text)):
            braced = _BRACES.search(clause)
            pairs = [_named(x) for x in _clean(braced[1])] if braced else []
            for x in _clean(_BRACES.sub("", clause) if braced else clause):
                name, local = _named(x)
                pairs.append((name if x[0] == "*" else "default", local))
            out += [Import(spec, name, local, word == "export") for name, local in pairs]
    elif language == "python":
        text = _HASH.sub("", text)
        for spec, names in _PY_FROM.findall(text):
            out += [Import(spec, *_named(x), True) for x in names.replace("(", "").replace(")", "").split(",") if x.strip(" ")]
        for names in _PY_IMPORT.findall(text):
            for x in names.split(","):
                spec, local = _named(x, _MODULE)
                out.append(Import(spec, "*", local, False))
    return out


def base(file: str, spec: str) -> str | None:
    """The path, without . and .. steps, that a relative specifier names; none for others."""
    if not spec.startswith("."):
        return None
    steps: list[str] = []
    for x in (file[: file.rfind("/") + 1] + spec).split("/"):
        if x == "..":
            steps = steps[:-1]
        elif x not in ("", "."):
            steps.append(x)
    return "/".join(steps)
