"""Texts to chunks: Markdown by headings, JSON and YAML by top-level keys, code by boundaries, HTML to Markdown.

Plain functions over one text, and `exploded`, which applies one to a DataFrame in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a fixed chunk, of a code chunk at least and at most, characters of any chunk, lines that code chunks share.
FIXED, LEAST, MOST, CHARS, OVERLAP = 50, 5, 200, 7500, 6
Chunk = tuple[int, int, str, str]  # first line, last line (from 1), label, content


def fixed(text: str) -> list[Chunk]:
    lines = text.split("\n")
    return [(k + 1, min(k + FIXED, len(lines)), "", "\n".join(lines[k : k + FIXED])) for k in range(0, len(lines), FIXED) if "".join(lines[k : k + FIXED]).strip()]


def markdown(text: str) -> list[Chunk]:
    """A chunk per heading outside fences, labelled by the path of headings above it."""
    lines, trail, fence, cuts = text.split("\n"), [""] * 6, False, [(0, "preamble")]
    for k, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fence = not fence
        elif not fence and (m := re.match(r"(#{1,6})\s+(.+)", line)):
            depth = len(m[1])
            trail[depth - 1 :] = [m[2].strip(), *[""] * (6 - depth)]
            cuts.append((k, " > ".join(x for x in trail if x)))
    ends = [k for k, _ in cuts[1:]] + [len(lines)]
    return [(a + 1, b, label, "\n".join(lines[a:b])) for (a, label), b in zip(cuts, ends, strict=True) if "".join(lines[a:b]).strip()]


def json_keys(text: str) -> list[Chunk]:
    """A chunk per top-level key of an object with five keys or more; smaller ones whole, what isn't an object in fixed pieces."""
    try:
        value = json.loads(text)
    except ValueError:
        return fixed(text)
    if not isinstance(value, dict):
        return fixed(text)
    lines = text.split("\n")
    if len(value) < 5:
        return [(1, len(lines), "{" + ", ".join(value) + "}", text)]
    out = []
    for key in value:
        body = json.dumps({key: value[key]}, indent=2, ensure_ascii=False)
        opens = re.compile(rf'\s*"{re.escape(key)}"\s*:')
        at = next((k + 1 for k, x in enumerate(lines) if opens.match(x)), 1)
        out.append((at, at + body.count("\n"), key, body))
    return out


def yaml_keys(text: str) -> list[Chunk]:
    """A chunk per document, and per top-level key in a single document."""
    lines = text.split("\n")
    marks = [k for k, x in enumerate(lines) if x.startswith("---")]
    if len(marks) > (1 if lines and lines[0].startswith("---") else 0):
        starts, label = sorted({0, *marks}), lambda k: f"document {k + 1}"
    else:
        starts, label = [k for k, x in enumerate(lines) if re.match(r"[A-Za-z_][\w.-]*\s*:", x)], None
    if not starts:
        return fixed(text)
    starts[0] = 0
    out = []
    for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)], strict=True)):
        body = "\n".join(lines[a:b])
        if body.strip(" \n-"):
            found = re.search(r"^([A-Za-z_][\w.-]*)\s*:", body, re.M)
            out.append((a + 1, b, label(n) if label else found[1] if found else "", body))
    return out


_OPENS = re.compile(r"\s{0,4}(export\s+)?(default\s+)?(async\s+)?(abstract\s+)?(function|class|interface|enum|def|fn|func|struct|trait|impl|type|public|private|protected)\b")
_REMARK = re.compile(r"\s*(//|#|\*|/\*|\"\"\"|@)")


def code(text: str, declared: list[int] | None = None) -> list[Chunk]:
    """Chunks begin at declarations (the lines given, from 0, else those that look like it) with the remarks above them; small ones join the one before, large ones are split with some lines shared."""
    lines = text.split("\n")
    starts = []
    opens = {k for k, line in enumerate(lines) if _OPENS.match(line)} if declared is None else set(declared)
    for k in range(len(lines)):
        if k in opens:
            while k > 0 and _REMARK.match(lines[k - 1]) and (not starts or k - 1 > starts[-1]):
                k -= 1
            starts.append(k)
    cuts: list[int] = [0]
    for k in sorted(set(starts)):
        if k - cuts[-1] >= LEAST:
            cuts.append(k)
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(lines)], strict=True):
        while a < b:
            end = min(b, a + MOST)
            body = "\n".join(lines[a:end])
            if body.strip():
                m = next((lines[k] for k in range(a, end) if k in opens), "")
                out.append((a + 1, end, m.strip()[:80], body))
            a = end if end == b else end - OVERLAP
    return [piece for c in out for piece in shortened(c)]


def shortened(c: Chunk) -> Iterator[Chunk]:
    """A chunk over CHARS characters in several, cut where a sentence, clause or word ends in the last fifth."""
    first, last, label, body = c
    while len(body) > CHARS:
        tail = body[CHARS * 4 // 5 : CHARS]
        at = next((CHARS * 4 // 5 + tail.rfind(x) + 1 for x in ("\n", ";", ",", "}", " ") if x in tail), CHARS)
        yield first, last, label, body[:at]
        body = body[at:]
    yield first, last, label, body


def merged(chunks: list[Chunk], least: int = LEAST) -> list[Chunk]:
    """Chunks of fewer lines join the one before; what is too long is split."""
    out: list[Chunk] = []
    for c in chunks:
        if out and c[1] - c[0] + 1 < least and len(out[-1][3]) + len(c[3]) < CHARS:
            a = out.pop()
            c = (a[0], c[1], a[2], a[3] + "\n" + c[3])
        out.append(c)
    return [piece for c in out for piece in shortened(c)]


_IMPORT = re.compile(r"\s*(import\s|from\s+\S+\s+import\s|#include\b|use\s+[\w:]+|(const|let|var)\s+.*=\s*require\()")


def imports_of(text: str) -> list[str]:
    return [x.strip() for x in text.split("\n") if _IMPORT.match(x)]


def structure(text: str, most_imports: int = 5) -> str:
    """A code text's imports (some), and the first lines of its declarations."""
    lines = text.split("\n")
    return "\n".join([*imports_of(text)[:most_imports], *(x.rstrip() for x in lines if _OPENS.match(x))])


class _Markdown(HTMLParser):
    SKIPPED = {"script", "style", "nav", "header", "footer", "noscript", "iframe", "head"}
    BREAKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip, self.links, self.lists = 0, [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in self.BREAKS:
            self.out.append("\n\n" if tag != "tr" else "\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(len(self.lists) - 1, 0) + ("- " if kind[0] == "ul" else f"{kind[1]}. "))
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append("| ")
        else:
            self.out.append({"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "pre": "```\n"}.get(tag, ""))

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "pre":
            self.out.append("\n```")
        else:
            self.out.append({"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "td": " ", "th": " "}.get(tag, ""))
        if tag in self.BREAKS and tag != "tr":
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"[ \t\r\n]+", " ", data))


def html_to_markdown(text: str) -> str:
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    lines = [x.strip() if not x.lstrip().startswith(("-", "1")) else x.rstrip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def page_slices(text: str) -> list[Chunk]:
    """Paragraphs packed into pieces of about CHARS characters."""
    out, held, line = [], [], 1
    for part in text.split("\n\n"):
        if held and sum(map(len, held)) + 2 * len(held) + len(part) > CHARS:
            body = "\n\n".join(held)
            out.append((line, line + body.count("\n"), "", body))
            line += body.count("\n") + 2
            held = []
        held.append(part)
    body = "\n\n".join(held)
    return [*out, (line, line + body.count("\n"), "", body)] if body.strip() else out


def json_paths(text: str) -> list[tuple[str, str]]:
    """Leaves of a JSON text by path, as $.a[0].b."""

    def walk(value, path: str) -> Iterator[tuple[str, str]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{path}.{k}")
        elif isinstance(value, list):
            for k, v in enumerate(value):
                yield from walk(v, f"{path}[{k}]")
        else:
            yield path, value if isinstance(value, str) else json.dumps(value)

    try:
        return list(walk(json.loads(text), "$"))
    except ValueError:
        return []


def exploded(df: DataFrame, key: str, text: str, chunker: Callable[[str], list[Chunk]]) -> DataFrame:
    """One row per chunk: key, nth, line_start, line_end, label, content."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, *c) for k, t in zip(b["key"], b["text"], strict=True) for n, c in enumerate(chunker(t or ""))]
            yield pd.DataFrame(rows, columns=["key", "nth", "line_start", "line_end", "label", "content"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(work, f"key {kind}, nth int, line_start int, line_end int, label string, content string")
    return out.withColumnRenamed("key", key)
