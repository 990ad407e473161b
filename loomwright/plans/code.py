"""Source texts to symbols, calls and resolved edges. The texts are modules written from the import graph: one per definition, as its rows have it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators import code, resolve
from loomwright.operators.chunking import code as code_chunks
from loomwright.operators.graph import _cut
from loomwright.operators.outline import outline
from loomwright.operators.spans import longest, nearest, owners
from loomwright.plans.more import edge_of_call, resolve_specifiers
from loomwright.registry import query
from loomwright.sources.tables import Tables

_LINKS = "links AS (SELECT DISTINCT from_id, to_id FROM imports WHERE from_id <> to_id)"
_COUNTS = f"{_LINKS}, counts AS (SELECT d.id, count(l.to_id) AS n, CASE WHEN d.exported AND count(l.to_id) > 0 THEN 1 ELSE 0 END AS r FROM definitions d LEFT JOIN links l ON l.from_id = d.id GROUP BY d.id, d.exported)"


def sources(t: Tables) -> DataFrame:
    """file, language, content: a module per definition, which imports and calls what the graph says; exported ones hand on all of the first that they import."""
    links = t.imports.where("from_id <> to_id").distinct().groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_list("to_id")).alias("to"))
    met = t.definitions.select("id", "exported").join(links, "id", "left").withColumn("to", F.coalesce("to", F.array().cast("array<bigint>")))
    text = lambda c: c.cast("string")
    lines = F.transform("to", lambda x: F.concat(F.lit("import { f"), text(x), F.lit(" as g"), text(x), F.lit(" } from './m"), text(x), F.lit("'; // f"), text(x), F.lit("()")))
    again = F.when(F.col("exported") & (F.size("to") > 0), F.array(F.concat(F.lit("export * from './m"), text(F.get("to", F.lit(0))), F.lit("';")))).otherwise(F.array().cast("array<string>"))
    body = F.transform("to", lambda x: F.concat(F.lit("    g"), text(x), F.lit("('{', x);")))
    head = F.array(F.concat(F.lit("export class C"), text(F.col("id")), F.lit(" {")), F.lit("  run(x) {"))
    tail = F.array(F.lit("  }"), F.lit("}"), F.concat(F.lit("export function f"), text(F.col("id")), F.lit("(x) { return x; }")))
    return met.select(F.concat(F.lit("m"), text(F.col("id")), F.lit(".ts")).alias("file"), F.lit("typescript").alias("language"), F.array_join(F.concat(lines, again, head, body, tail), "\n").alias("content"))


@query(f"""WITH {_COUNTS} SELECT concat('m', id, '.ts') AS file, 'class' AS kind, concat('C', id) AS name, n + r + 1 AS line, 2 * n + r + 4 AS end_line, NULL AS parent FROM counts
  UNION ALL SELECT concat('m', id, '.ts'), 'method', 'run', n + r + 2, 2 * n + r + 3, concat('C', id) FROM counts UNION ALL SELECT concat('m', id, '.ts'), 'function', concat('f', id), 2 * n + r + 5, 2 * n + r + 5, NULL FROM counts""")
def extract_symbols(t: Tables) -> DataFrame:
    return code.symbols(code.parsed(sources(t), calls=False, marks=False)).select("file", "kind", "name", "line", "end_line", "parent")


@query(f"WITH {_LINKS} SELECT concat('m', from_id, '.ts') AS file, concat('./m', to_id) AS spec, concat('f', to_id) AS name, concat('g', to_id) AS local FROM links")
def extract_imports(t: Tables) -> DataFrame:
    return code.imports(sources(t)).where("NOT reexport").select("file", "spec", "name", "local")


@query(f"WITH {_LINKS} SELECT concat('m', from_id, '.ts') AS file, concat('./m', to_id) AS spec, concat('m', to_id, '.ts') AS target FROM links")
def resolve_imports(t: Tables) -> DataFrame:
    """The files that the specifiers of all modules name."""
    files = sources(t)
    return resolve_specifiers(code.imports(files).select("file", "spec").distinct(), files.select(F.col("file").alias("path")), {"@app": "src"})


@query(f"WITH {_LINKS} SELECT concat('m', from_id, '.ts') AS module, 'run' AS caller, concat('g', to_id) AS callee, 'import' AS found, concat('m', to_id, '.ts') AS target_module, concat('f', to_id) AS target FROM links")
def resolve_edges(t: Tables) -> DataFrame:
    """Calls with the symbols that they call: names are followed through imports and re-exports."""
    return edges(sources(t)).select("module", "caller", "callee", "found", "target_module", "target")


def edges(files: DataFrame) -> DataFrame:
    """files: file, language, content. Each text is read once; what one file decides, its own names and its imports by name, is decided there, and specifiers are looked up once for each path that they name."""
    of = _cut(code.modules(files))
    rows = lambda what: of.where(F.col("what") == what).drop("what").withColumnRenamed("file", "module")
    asked = of.where("base IS NOT NULL").select(F.lit("").alias("file"), F.concat(F.lit("./"), "base").alias("spec"), "base").distinct()
    paths = of.where("what = 'file'").select(F.col("file").alias("path"))
    target = resolve_specifiers(asked.select("file", "spec"), paths, {}).where("target IS NOT NULL").select(F.expr("substring(spec, 3)").alias("base"), "target")
    target = _cut(target)
    linked = rows("import").join(target.hint("merge"), "base")
    own = rows("own").select("module", "name")
    exported = resolve.exports(own, linked.where("reexport"))
    calls = rows("call").withColumnRenamed("own_root", "_own")
    root = F.split("callee", r"\.")[0]
    given = linked.where("NOT reexport").groupBy("module", F.col("local").alias("root")).agg(F.min(F.struct("target", "name")).alias("i"))
    several = calls.where("several").withColumn("root", root).join(given, ["module", "root"], "left").select("module", "caller", "callee", "_own", F.col("i.name").alias("_name"), F.col("i.target").alias("_from"))
    single = calls.where("base IS NOT NULL").join(target.hint("merge"), "base", "left").select("module", "caller", "callee", "_own", F.when(F.col("target").isNotNull(), F.col("name")).alias("_name"), F.col("target").alias("_from"))
    none = calls.where("base IS NULL AND NOT several").select("module", "caller", "callee", "_own", F.lit(None).cast("string").alias("_name"), F.lit(None).cast("string").alias("_from"))
    return resolve.settled(single.unionByName(several).unionByName(none), ["module", "caller", "callee"], own, exported)


@query(r"""WITH s AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS body FROM pages)
  SELECT page_id, regexp_extract(body, '([A-Za-z_]\w*)\(', 1) AS callee, 'call' AS kind, count(*) AS n FROM s WHERE regexp_matches(body, '[A-Za-z_]\w*\(') GROUP BY 1, 2""")
def script_calls(t: Tables) -> DataFrame:
    """What the scripts of each page call, with the kind of edge."""
    scripts = t.pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<script[^>]*>(.*?)</script>"), F.lit(1))).alias("k", "content"))
    files = scripts.select(F.concat_ws(":", "page_id", "k").alias("file"), F.lit("javascript").alias("language"), "content")
    found = code.calls(code.parsed(files, marks=False)).select(F.split("file", ":")[0].cast("long").alias("page_id"), "callee", edge_of_call(F.col("callee"), F.col("first")).alias("kind"))
    return found.groupBy("page_id", "callee", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH spans AS (SELECT o_custkey AS file, o_orderkey AS span, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS a, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) + CAST(floor(o_totalprice) AS BIGINT) % 200 AS b FROM orders)
  SELECT x.span AS id, y.span AS owner FROM spans x JOIN spans y ON x.file = y.file AND y.a < x.a AND y.b >= x.a QUALIFY row_number() OVER (PARTITION BY x.span ORDER BY y.a DESC, y.b, y.span DESC) = 1""")
def innermost_owner(t: Tables) -> DataFrame:
    """Spans (here of days, of a customer's orders) and the innermost span of the same key that holds their beginning and begins before them."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    spans = t.orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("span_id"), day.alias("a"), (day + F.floor("o_totalprice").cast("long") % 200).alias("b"))
    met = containing_first(spans)
    return met.select(F.col("span_id").alias("id"), "owner")


def containing_first(spans: DataFrame) -> DataFrame:
    """Per span the innermost other one that holds its beginning: the latest to begin, the first to end, the largest id."""
    found = owners(spans.select("file", "span_id", "a"), spans, ["file"], ["span_id"], "a", "a", "b", strictly=True, levels=longest(spans, "a", "b"), last=["span_id"])
    return found.select("span_id", F.col("span.span_id").alias("owner"))


@query("""WITH d AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderdate AS at FROM orders)
  SELECT e.event_id, max_by(d.id, struct_pack(a := d.at, b := d.id)) AS before_id FROM (SELECT event_id, user_id, ts FROM events) e LEFT JOIN d ON d.k = e.user_id AND epoch(d.at) <= epoch(e.ts) GROUP BY e.event_id""")
def nearest_preceding_def(t: Tables) -> DataFrame:
    """Each event with its user's last order at or before it; keys are split by slots of a year."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    events = t.events.select("event_id", F.col("user_id").alias("k"), seconds("ts").alias("at"))
    orders = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), seconds("o_orderdate").alias("at"))
    return nearest(events, orders, ["k"], "at", ["id"], width=365 * 86400).select("event_id", F.col("near.id").alias("before_id"))


@query()
def chunk_code(t: Tables) -> DataFrame:
    """Chunks of each module's text, which begin at its outermost declarations."""
    return chunked(sources(t))


def chunked(files: DataFrame) -> DataFrame:
    """files: file, language, content. file, nth, line_start, line_end, label, content of chunks that begin at declarations outside of any other."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, language, text in zip(b["file"], b["language"], b["content"], strict=True):
                outer = sorted(s.line - 1 for s in outline(text, language, calls=False)[0] if s.parent is None)
                rows += [(file, n, *c) for n, c in enumerate(code_chunks(text or "", outer))]
            yield pd.DataFrame(rows, columns=["file", "nth", "line_start", "line_end", "label", "content"])

    return files.select("file", "language", "content").mapInPandas(work, "file string, nth int, line_start int, line_end int, label string, content string")
