"""Text functions, chunkers and other operators that turn texts into rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomwright.functions.text import token_estimate
from loomwright.operators import chunking
from loomwright.registry import query, statement
from loomwright.sources.tables import Tables

statement("content_hash", "SELECT id, SHA_256(content) AS hash, md5(content) AS short_hash FROM chunks")
statement("path_prefix", "SELECT id, concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) AS prefix, split_part(path, '/', 1) AS package FROM definitions")
statement("query_signature", "SELECT query, min(lower(REPLACE_ALL(query, '[0-9:]+', ''))) AS signature FROM search_events GROUP BY query")


#: What a language's source shows, with the weight of each place where it does; looked for outside of comments and strings.
MARKS: dict[str, list[tuple[float, str]]] = {
    "python": [(3, r"(?m)^\s*(async\s+)?def \w+\(.*\).*:\s*$"), (3, r"(?m)^\s*class \w+.*:\s*$"), (2, r"(?m)^\s*(elif |except\b|from [\w.]+ import )"), (1, r"\bself\b"), (1, r"(?m)^\s*import [\w.]+\s*$")],
    "rust": [(3, r"\blet mut\b"), (3, r"\bpub (fn|struct|enum|mod|trait)\b"), (2, r"\bfn \w+"), (2, r"\bimpl\b"), (1, r"\) -> "), (1, r"\b[a-z_]+!\(")],
    "go": [(4, r"(?m)^package \w+\s*$"), (3, r"(?m)^func (\(\w+ \*?\w+\) )?\w+\("), (2, r":="), (2, r"\b(defer|chan|go func)\b")],
    "kotlin": [(3, r"\b(data|sealed) class\b"), (3, r"\bcompanion object\b"), (3, r"\bfun (<\w+> )?[\w.]+\("), (2, r"\bval \w+"), (1, r"\?\.|\?:")],
    "dart": [(4, r"(?m)^\s*(library|part of) [\w.]+;"), (4, r"(?m)^\s*(import|part|part of)\s+;"), (3, r"\bmixin \w+"), (3, r"\bFuture<"), (3, r"\bvoid main\("), (2, r"\bfinal \w+ \w+ ?="), (2, r"\b(late|required) \w+ \w+")],
    "javascript": [(2, r"\bfunction\b"), (2, r"(?m)^\s*(import|export)\b[^;\n]*\bfrom\b"), (2, r"[=!]=="), (1, r"\b(const|let|var) \w+ ?="), (1, r"=>"), (2, r"\brequire\(")],
}
#: Beside all that javascript shows.
MARKS["typescript"] = [(3, r"\binterface \w+|\btype \w+(<\w+>)? ?="), (3, r"\b(let|const|var) \w+: \w"), (3, r"\w\)?\??: (string|number|boolean|void|unknown|any)\b"), (3, r"\b(import|export) type\b"), (2, r"\bprivate \w+|\breadonly \w+"), *MARKS["javascript"]]
_HIDDEN = r"""(?s)/\*.*?\*/|//[^\n]*|(?<=^|\s)#(?!\[|include)[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'"""


def code_language(text: F.Column) -> F.Column:
    """The language whose marks weigh most in a text without its comments and strings; ties go to the first by name, texts without marks are unknown."""
    bare = F.regexp_replace(text, _HIDDEN, " ")
    weighed = lambda t, marks: sum((w * F.regexp_count(t, F.lit(p)) for w, p in marks), F.lit(0.0))
    sums = lambda t: F.array(*[F.struct(weighed(t, MARKS[name]).alias("w"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, name in enumerate(sorted(MARKS))])
    best = F.element_at(F.transform(F.array(bare), lambda t: F.array_max(sums(t))), 1)
    return F.when(best["w"] > 0, best["name"]).otherwise("unknown")


@query()
def detect_code_language(t: Tables) -> DataFrame:
    return t.pages.select("page_id", code_language(F.col("html")).alias("language"))


@query()
def chunk_fixed(t: Tables) -> DataFrame:
    return chunking.exploded(t.chunks, "id", "content", chunking.fixed)


statement("json_cascade", "SELECT event_id, coalesce(JSON_TEXT(props, '$.filePath'), JSON_TEXT(props, '$.file_path'), JSON_TEXT(props, '$.k')) AS path FROM events")
statement("sanitize_text", "SELECT item_id, REPLACE_ALL(text, '[<>]', '') AS text FROM benchmark")
statement("tokens_per_source", "SELECT project, count(DISTINCT tok) AS tokens FROM (SELECT project, EXPLODE(SPLIT(lower(content), ' ')) AS tok FROM chunks) x WHERE REGEXP_LIKE(tok, '^[a-z0-9_]{2,}$') GROUP BY project")


@query("SELECT id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS code_tokens, CAST(ceil(length(content) / 5.0) AS BIGINT) AS text_tokens FROM chunks")
def token_estimates(t: Tables) -> DataFrame:
    return t.chunks.select("id", token_estimate(F.col("content")).alias("code_tokens"), token_estimate(F.col("content"), code=False).alias("text_tokens"))


@query("SELECT id, array_to_string(list_slice(string_split(content, chr(10)), 1, 5), chr(10)) AS preview FROM chunks")
def preview_lines(t: Tables) -> DataFrame:
    return t.chunks.select("id", F.array_join(F.slice(F.split("content", "\n", -1), 1, 5), "\n").alias("preview"))


_LINES = "SELECT id, unnest(string_split(content, chr(10))) AS line, unnest(range(len(string_split(content, chr(10))))) AS pos FROM chunks"


@query(f"WITH l AS ({_LINES}) SELECT id, CAST(pos + 1 AS BIGINT) AS n, lpad(CAST(pos + 1 AS VARCHAR), 6, ' ') || '  ' || line AS text FROM l WHERE pos BETWEEN 1 AND 4")
def line_range(t: Tables) -> DataFrame:
    """Of every text; the lines asked for are the operator's own range."""
    return _numbered(t.chunks)


def _numbered(chunks: DataFrame) -> DataFrame:
    lines = chunks.select("id", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).where("pos BETWEEN 1 AND 4")
    return lines.select("id", (F.col("pos") + 1).cast("long").alias("n"), F.concat(F.lpad((F.col("pos") + 1).cast("string"), 6, " "), F.lit("  "), "line").alias("text"))


@query(f"""WITH l AS ({_LINES}), k AS (SELECT *, row_number() OVER (PARTITION BY id, lower(line) ORDER BY pos) AS n FROM l)
  SELECT id, string_agg(line, chr(10) ORDER BY pos) FILTER (n = 1 OR line = '') AS content FROM k GROUP BY id""")
def dedup_lines(t: Tables) -> DataFrame:
    """The first of each text's lines that differ in case alone; blank lines stay. A text is one row throughout."""
    lines = F.split("content", "\n", -1)
    low = F.transform("lines", F.lower)
    kept = F.filter("lines", lambda x, k: (x == "") | (F.array_position("low", F.lower(x)) == k + 1))
    return t.chunks.select("id", lines.alias("lines")).withColumn("low", low).select("id", F.array_join(kept, "\n").alias("content"))


@query("""WITH p AS (SELECT a.id, string_split(a.content, chr(10)) AS x, string_split(b.content, chr(10)) AS y FROM chunks a JOIN chunks b ON b.id = a.id + 1)
  SELECT id, CAST(len(list_filter(range(greatest(len(x), len(y))), lambda i: x[i + 1] IS DISTINCT FROM y[i + 1])) AS BIGINT) AS changed FROM p""")
def line_diff(t: Tables) -> DataFrame:
    """Lines that differ from the next document's at the same place."""
    a = t.chunks.select("id", F.split("content", "\n", -1).alias("x"))
    b = t.chunks.select((F.col("id") - 1).alias("id"), F.split("content", "\n", -1).alias("y"))
    differ = F.filter(F.arrays_zip("x", "y"), lambda p: ~p["x"].eqNullSafe(p["y"]))
    return a.join(b, "id").select("id", F.size(differ).cast("long").alias("changed"))


@query()
def chunk_markdown(t: Tables) -> DataFrame:
    return chunking.exploded(t.chunks, "id", "content", chunking.markdown)


@query()
def chunk_json(t: Tables) -> DataFrame:
    return chunking.exploded(t.events.select("event_id", "props"), "event_id", "props", chunking.json_keys)


@query()
def chunk_yaml(t: Tables) -> DataFrame:
    return chunking.exploded(t.chunks, "id", "content", chunking.yaml_keys)


@query("SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events")
def json_paths(t: Tables) -> DataFrame:
    @F.pandas_udf("array<struct<path:string,value:string>>")
    def leaves(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: [{"path": p, "value": v} for p, v in chunking.json_paths(x or "")])

    return t.events.select("event_id", F.explode(leaves("props")).alias("leaf")).select("event_id", "leaf.path", "leaf.value")


@F.pandas_udf(StringType())
def _as_markdown(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: chunking.html_to_markdown(x or ""))


@query()
def html_to_markdown(t: Tables) -> DataFrame:
    return t.pages.select("page_id", _as_markdown("html").alias("markdown"))


@query()
def page_chunks(t: Tables) -> DataFrame:
    return chunking.exploded(t.pages.select("page_id", _as_markdown("html").alias("markdown")), "page_id", "markdown", chunking.page_slices)


@query("""WITH logs AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE epoch(ts) END AS stamp, user_id FROM events)
  SELECT event_id, CAST(floor(last_value(stamp IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS stamp FROM logs""")
def log_parse(t: Tables) -> DataFrame:
    """Log lines are read by a pattern; those it doesn't fit inherit the time of the last one that it fits."""
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    line = F.when(F.col("event_id") % 7 == 0, F.lit("  continued")).otherwise(F.concat(F.lit("["), stamp, F.lit("] [INFO] "), F.col("event_type")))
    found = F.try_to_timestamp(F.nullif(F.regexp_extract(line, r"^\[([0-9: -]+)\] \[[A-Z]+\]", 1), F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.events.withColumn("at", F.unix_seconds(found)).select("event_id", F.last("at", ignorenulls=True).over(w).alias("stamp"))


statement("log_filter", "SELECT event_id, event_type FROM events WHERE EPOCH_S(ts) BETWEEN 1704153600 AND 1704758400 AND event_type IN ('error', 'signup') AND contains(lower(props), '3') ORDER BY event_id LIMIT 1000 OFFSET 5")


_CODE = "SELECT p_partkey AS id, concat('import ', lower(p_brand), chr(10), 'def f', CAST(p_partkey AS STRING), '(x):', chr(10), '  return ', CAST(p_size AS STRING), chr(10), 'class C:', chr(10), '  pass') AS content FROM part"


@query("SELECT p_partkey AS id, concat('import ', lower(p_brand), chr(10), 'def f', CAST(p_partkey AS STRING), '(x):', chr(10), 'class C:') AS outline FROM part")
def compress_structure(t: Tables) -> DataFrame:
    @F.pandas_udf(StringType())
    def outline(texts: pd.Series) -> pd.Series:
        return texts.map(chunking.structure)

    return t.sql(_CODE).select("id", outline("content").alias("outline"))


@query()
def chunk_post(t: Tables) -> DataFrame:
    return chunking.exploded(t.chunks, "id", "content", lambda x: chunking.merged(chunking.markdown(x)))


@query("""WITH m AS (SELECT event_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS m FROM events)
  SELECT event_id, min(60 * (m + 1 + i)) AS next_s FROM (SELECT event_id, m, unnest(range(1500)) AS i FROM m) x WHERE ((m + 1 + i) % 60) % 15 = 0 AND ((m + 1 + i) // 60) % 24 IN (3, 9) GROUP BY event_id""")
def cron_next(t: Tables) -> DataFrame:
    return _next_runs(t.events)


#: Minutes of a day at which the plan (every quarter of the hours 3 and 9) runs.
RUNS = [60 * h + m for h in (3, 9) for m in (0, 15, 30, 45)]
DAY = 1440


def _next_runs(events: DataFrame) -> DataFrame:
    """The first run after each event's minute: of the distances to all minutes of the plan, around the day, the least."""
    m = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60)
    ahead = F.least(*[F.pmod(F.lit(r - 1) - m, F.lit(DAY)) + 1 for r in RUNS])
    return events.where("ts IS NOT NULL").select("event_id", ((m + ahead) * 60).alias("next_s"))
