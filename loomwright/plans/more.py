"""Observations, jobs, leases, buffers, text helpers and sinks that no other family holds. Each has SQL of another form to agree with, or a test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import edit_limit
from loomwright.operators.graph import _cut
from loomwright.registry import query
from loomwright.sources.versions import VersionedTable, shared_folder
from loomwright.sources.tables import Tables
from loomwright.streaming import links

# --- observations
#: Names by which other hosts call the same tools.
ALIASES = {"read_file": "Read", "write_file": "Write", "edit_file": "Edit", "glob": "Glob", "shell": "Bash", "run_shell_command": "Bash"}
#: Tools by the category of an observation of their use.
TOOLS = {
    "files-read": ["Read"], "files-written": ["Write", "Edit", "MultiEdit"], "file-search": ["Glob", "list_files", "Grep", "search_files", "grep"], "tasks": ["TodoWrite"],
    "subagents-spawned": ["Task"], "web-fetch": ["WebFetch"], "searches": ["WebSearch", "search", "search_definitions", "get_references", "recall"], "memories-stored": ["store_memory"],
    "compaction-snapshots": ["compact_snapshot"],
}
#: How a prompt begins, or what it holds, by category, in the order in which they are tried.
PROMPTS = [
    ("goal", ["/goal", "goal:", "objective:"], []), ("plan-changes", ["/plan"], []),
    ("decisions", [], ["let's go with", "decide on", "decision:", "we'll use", "chosen approach"]), ("constraints", [], ["must not", "constraint:", "don't touch", "never ", "avoid "]),
    ("rejected-approaches", [], ["not that", "rejected", "don't do", "instead of"]), ("blocked-on", [], ["blocked on", "waiting on", "can't proceed", "stuck on"]),
    ("role", ["/persona", "act as", "you are a"], []),
]
#: Ends of the names of files that hold rules.
RULE_FILES = ["claude.md", "agents.md", "cursorrules", ".clinerules", "rtk.md"]


def any_of(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def observation_kind(source: Column, payload: Column) -> Column:
    """The category of an event from its source and its payload, a JSON object: the first rule that fits; null payloads are raw."""
    of = lambda *paths: F.coalesce(*[F.get_json_object(payload, f"$.{p}") for p in paths])
    called = of("tool_name", "toolName")
    tool = F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[called], called)
    command, said = F.lower(of("command", "tool_input.command")), F.lower(of("prompt", "message", "text"))
    file, out = F.lower(of("file_path", "path", "tool_input.file_path")), F.lower(of("stdout"))
    after = source == "post-tool-use"
    rules = [
        ("rules", (tool == "Read") & any_of([file.endswith(x) for x in RULE_FILES] + [file.contains("claudemd")])),
        ("errors", after & any_of([of("tool_response.is_error") == "true", F.length(of("tool_response.error")) > 0, out.contains("error:"), out.contains("failed:")])),
        ("git-changes", F.lower(of("command")).rlike("^git .*(commit|merge|rebase|checkout|reset)") | F.coalesce(F.length(of("diff", "git_diff")) > 0, F.lit(False))),
        ("skills-invoked", tool.isin("Skill", "skill")),
        *[(name, tool.isin(*tools)) for name, tools in TOOLS.items()],
        ("git-changes", (tool == "Bash") & (command.startswith("git ") | command.contains(" git "))),
        ("tool-calls", tool == "Bash"),
        ("mcp-calls", tool.startswith("mcp__")),
        *[(name, (source == "user-prompt") & any_of([said.startswith(x) for x in begins] + [said.contains(x) for x in holds])) for name, begins, holds in PROMPTS],
        ("user-prompts", source == "user-prompt"),
        ("session-settings", (source == "session-start") & of("settings", "model").isNotNull()),
        ("cwd-changes", (source == "session-start") & of("cwd", "workingDirectory").isNotNull()),
        ("env-changes", (source == "session-start") & of("env", "environment").isNotNull()),
        ("session-settings", source == "session-start"),
        ("compaction-snapshots", source == "pre-compact"),
    ]
    kind = F.lit("lifecycle-raw")
    for name, fits in reversed(rules):
        kind = F.when(F.coalesce(fits, F.lit(False)), name).otherwise(kind)
    return F.when(payload.isNull(), "lifecycle-raw").otherwise(kind)


_PAYLOADS = """SELECT event_id, CASE event_type WHEN 'view' THEN 'post-tool-use' WHEN 'click' THEN 'user-prompt' WHEN 'signup' THEN 'session-start' WHEN 'error' THEN 'post-tool-use' ELSE 'pre-compact' END AS source,
  CASE event_type WHEN 'view' THEN concat('{"tool_name":"', CASE k % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'Grep' WHEN 2 THEN 'mcp__a__b' ELSE 'Edit' END, '"}')
    WHEN 'click' THEN concat('{"prompt":"', CASE k % 3 WHEN 0 THEN '/plan b' WHEN 1 THEN 'We must not wait' ELSE 'go on' END, '"}')
    WHEN 'signup' THEN '{"cwd":"/x"}' WHEN 'error' THEN '{"tool_name":"Bash","stdout":"Error: no"}' ELSE '{}' END AS payload FROM search_events"""


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN CASE k % 4 WHEN 0 THEN 'files-read' WHEN 1 THEN 'file-search' WHEN 2 THEN 'mcp-calls' ELSE 'files-written' END
    WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'plan-changes' WHEN 1 THEN 'constraints' ELSE 'user-prompts' END WHEN 'signup' THEN 'cwd-changes' WHEN 'error' THEN 'errors' ELSE 'compaction-snapshots' END AS category FROM search_events""")
def observation_category(t: Tables) -> DataFrame:
    return t.sql(_PAYLOADS).select("event_id", observation_kind(F.col("source"), F.col("payload")).alias("category"))


@query("""SELECT a.session_id, a.event_id, CAST(count(b.event_id) AS BIGINT) AS place, max(c.n) AS total FROM search_events a
  LEFT JOIN search_events b ON b.session_id = a.session_id AND (b.ts_s > a.ts_s OR (b.ts_s = a.ts_s AND b.event_id > a.event_id))
  JOIN (SELECT session_id, count(*) AS n FROM search_events GROUP BY session_id) c ON c.session_id = a.session_id GROUP BY a.session_id, a.event_id HAVING count(b.event_id) < 20""")
def recent_observations(t: Tables) -> DataFrame:
    """The 20 newest of each session, with the session's count."""
    e = t.search_events.select("session_id", "event_id", "ts_s")
    newest = e.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts_s"), F.desc("event_id"))) - 1).where("place < 20")
    return newest.join(e.groupBy("session_id").agg(F.count(F.lit(1)).alias("total")), "session_id").select("session_id", "event_id", F.col("place").cast("long").alias("place"), "total")


# --- jobs and leases
_RUNS = "SELECT session_id AS run, project_id AS project, event_type AS kind, min(ts_s) AS started, max(ts_s) AS beat FROM search_events GROUP BY session_id, project_id, event_type"


@query(f"""WITH r AS ({_RUNS}), now AS (SELECT max(ts_s) AS now FROM search_events), live AS (SELECT r.* FROM r, now WHERE beat > now - 86400)
  SELECT x.project, x.kind, x.run, x.started FROM live x WHERE NOT EXISTS (SELECT 1 FROM live y WHERE y.project = x.project AND y.kind = x.kind AND (y.started < x.started OR (y.started = x.started AND y.run < x.run)))""")
def active_runs(t: Tables) -> DataFrame:
    """Runs whose lease (a day without a heartbeat) hasn't run out; of each project and kind only the first holds it."""
    now = t.search_events.agg(F.max("ts_s").alias("now"))
    live = t.sql(_RUNS).join(F.broadcast(now)).where(F.col("beat") > F.col("now") - 86400)  # one row
    first = live.groupBy("project", "kind").agg(F.min(F.struct("started", "run")).alias("f"))
    return first.select("project", "kind", "f.run", "f.started")


_JOBS = "SELECT event_id AS job, event_type AS kind, ts_s AS next_run, session_id AS project FROM search_events"


@query(f"""WITH j AS ({_JOBS}), now AS (SELECT CAST(avg(next_run) AS BIGINT) AS now FROM j), due AS (SELECT j.*, now, next_run < now - 3600 AS missed FROM j, now WHERE next_run <= now),
  run AS (SELECT job, kind FROM due d WHERE NOT missed AND NOT EXISTS (SELECT 1 FROM due o WHERE o.kind = d.kind AND NOT o.missed AND (o.next_run < d.next_run OR (o.next_run = d.next_run AND o.job < d.job)))),
  started AS (SELECT job FROM run ORDER BY kind LIMIT 3)
  SELECT job, CASE WHEN missed THEN 'skipped' WHEN job IN (SELECT job FROM started) THEN 'started' ELSE 'waiting' END AS state FROM due""")
def due_jobs(t: Tables) -> DataFrame:
    """A scheduler's tick: what was missed by more than a tick (an hour) is skipped and planned anew; else one run a kind, three in all."""
    jobs = t.sql(_JOBS)
    due = jobs.join(F.broadcast(jobs.agg(F.avg("next_run").cast("double").alias("now")))).withColumn("now", F.round("now").cast("long")).where("next_run <= now")  # one row
    due = due.withColumn("missed", F.col("next_run") < F.col("now") - 3600)
    first = due.where("NOT missed").groupBy("kind").agg(F.min(F.struct("next_run", "job")).getField("job").alias("job")).orderBy("kind").limit(3).select("job", F.lit(True).alias("go"))
    state = F.when(F.col("missed"), "skipped").when(F.col("go"), "started").otherwise("waiting")
    return due.join(F.broadcast(first), "job", "left").select("job", state.alias("state"))  # three rows


@query("SELECT project_id, event_id, event_type FROM search_events WHERE event_type = 'signup' AND project_id = 2 AND ts_s >= (SELECT max(ts_s) - 604800 FROM search_events)")
def job_listing(t: Tables) -> DataFrame:
    """Running jobs of one project in the last week."""
    e = t.search_events
    since = e.agg((F.max("ts_s") - 604800).alias("since"))
    return e.where("event_type = 'signup' AND project_id = 2").join(F.broadcast(since)).where("ts_s >= since").select("project_id", "event_id", "event_type")  # one row


@query("""WITH first AS (SELECT id, 'project_map' AS signal FROM chunks ORDER BY n_chars DESC, id LIMIT 3), central AS (SELECT to_id AS id, 'central' AS signal FROM imports GROUP BY to_id ORDER BY count(*) DESC, to_id LIMIT 3),
  seeds AS (SELECT * FROM first UNION ALL SELECT * FROM central)
  SELECT s.id, s.signal, concat('bootstrap:', s.signal, ':', CAST(s.id AS VARCHAR)) AS marker FROM seeds s LEFT JOIN memories m ON m.id = s.id AND m.tag = 'tag1' WHERE m.id IS NULL""")
def bootstrap_seeds(t: Tables) -> DataFrame:
    """A few seed memories from each signal, but for those that bear a marker already."""
    first = t.chunks.orderBy(F.desc("n_chars"), "id").limit(3).select("id", F.lit("project_map").alias("signal"))
    central = t.imports.groupBy(F.col("to_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(3).select("id", F.lit("central").alias("signal"))
    marked = t.memories.where("tag = 'tag1'").select("id")
    return first.unionByName(central).join(marked, "id", "left_anti").withColumn("marker", F.concat_ws(":", F.lit("bootstrap"), "signal", F.col("id").cast("string")))


@query("SELECT l_orderkey AS table_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS columns FROM lineitem GROUP BY l_orderkey")
def ordered_array_agg(t: Tables) -> DataFrame:
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    return rows.select("table_id", F.array_join(F.col("c.l_partkey").cast("array<string>"), ",").alias("columns"))


# --- the working-memory buffer of a session
@query("""WITH q AS (SELECT event_id, project_id, ts_s, list_distinct(string_split(query, ':')) AS toks FROM search_events), held AS (SELECT event_id AS item, project_id, ts_s, toks, least(1.0, duration / 100.0) AS base FROM q JOIN search_events USING (event_id, project_id, ts_s)),
  met AS (SELECT q.event_id, h.item, h.base, len(list_intersect(q.toks, h.toks)) * 1.0 / len(list_distinct(list_concat(q.toks, h.toks))) AS sim FROM q JOIN held h ON h.project_id = q.project_id AND h.item <> q.event_id AND h.ts_s BETWEEN q.ts_s - 900 AND q.ts_s)
  SELECT event_id, item, round(least(1.0, base * 1.3), 6) AS score FROM met WHERE sim >= 0.4 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY base DESC, item) <= 20""")
def buffer_hits(t: Tables) -> DataFrame:
    """Items of the last 15 minutes of a session (here: a project) that are alike to a query in .4 of their tokens; the 20 of the highest baseline stay.

    Items meet queries of their own and the next quarter of an hour, so a long session isn't compared with itself as a whole.
    """
    e = t.search_events.select("event_id", "project_id", "ts_s", F.array_distinct(F.split("query", ":")).alias("toks"), F.least(F.lit(1.0), F.col("duration") / 100.0).alias("base"))
    slot = F.floor(F.col("ts_s") / 900)
    held = e.select(F.col("event_id").alias("item"), "project_id", F.col("ts_s").alias("at"), F.col("toks").alias("own"), "base", F.explode(F.array(slot, slot + 1)).alias("slot"))
    met = e.drop("base").withColumn("slot", slot).join(held, ["project_id", "slot"]).where("item <> event_id AND at BETWEEN ts_s - 900 AND ts_s")
    like = F.size(F.array_intersect("toks", "own")) / F.size(F.array_union("toks", "own"))
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("base"), "item"))
    return met.where(like >= 0.4).withColumn("n", place).where("n <= 20").select("event_id", "item", F.round(F.least(F.lit(1.0), F.col("base") * 1.3), 6).alias("score"))


# --- text helpers
@query("SELECT n_name AS term, CASE WHEN length(n_name) < 5 THEN 1 WHEN length(n_name) < 13 THEN 2 ELSE 3 END AS edits FROM nation")
def max_edit_distance(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("term"), edit_limit(F.col("n_name")).alias("edits"))


@query("""SELECT id, CASE WHEN id % 4 = 0 THEN concat('label ', CAST(id AS VARCHAR)) WHEN id % 4 = 1 THEN lang WHEN id % 4 = 2 THEN file ELSE left(string_split(content, chr(10))[1], 80) END AS title FROM chunks""")
def title_resolution(t: Tables) -> DataFrame:
    """Of label, parent symbol, path and first line, the first that isn't empty."""
    k = F.col("id") % 4
    parts = [F.when(k == 0, F.concat(F.lit("label "), F.col("id").cast("string"))), F.when(k == 1, F.col("lang")), F.when(k < 3, F.col("file")), F.left(F.element_at(F.split("content", "\n", -1), 1), F.lit(80))]
    return t.chunks.select("id", F.coalesce(*[F.nullif(p, F.lit("")) for p in parts[:-1]], parts[-1]).alias("title"))


@query("SELECT id, CASE WHEN m IS NULL THEN '' WHEN length(m) > 150 THEN left(m, 149) || '…' ELSE m END AS preview FROM (SELECT id, list_filter(string_split(content, chr(10)), lambda x: length(trim(x)) > 3)[1] AS m FROM chunks) x")
def smart_preview(t: Tables) -> DataFrame:
    """Of prose: its first meaningful line, cut to 150."""
    first = F.get(F.filter(F.split("content", "\n", -1), lambda x: F.length(F.trim(x)) > 3), 0)
    return t.chunks.select("id", F.coalesce(shortened(first, 150), F.lit("")).alias("preview"))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


@query("SELECT item_id, CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 59) || '…' END AS text FROM benchmark")
def truncate_text(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", shortened(F.col("text"), 60).alias("text"))


@query("SELECT id, array_to_string(list_slice(ls, greatest(spot - 3, 1), spot + 3), chr(10)) AS snippet FROM (SELECT id, string_split(content, chr(10)) AS ls, 1 + id % len(string_split(content, chr(10))) AS spot FROM chunks) x")
def snippet_context(t: Tables) -> DataFrame:
    """Three lines on either side of a line that is referred to."""
    rows = t.chunks.select("id", F.split("content", "\n", -1).alias("ls"))
    at = (1 + F.col("id") % F.size("ls")).cast("int")
    low = F.greatest(at - 3, F.lit(1))
    return rows.select("id", F.array_join(F.slice("ls", low, at + 4 - low), "\n").alias("snippet"))


@query("SELECT item_id, string_agg('\"' || replace(w, '\"', '\"\"') || '\"', ' OR ' ORDER BY pos) AS expression FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM benchmark) x WHERE w <> '' GROUP BY item_id")
def fts_quoting(t: Tables) -> DataFrame:
    """Each term in quotes, joined by OR."""
    words = F.filter(F.split("text", " ", -1), lambda w: w != "")
    return t.benchmark.select("item_id", F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ").alias("expression")).where("expression <> ''")


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS url FROM pages")
def xml_escape(t: Tables) -> DataFrame:
    text = F.col("url")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return t.pages.select("page_id", text.alias("url"))


def fnv1a(text: Column) -> Column:
    """32 bits, over the text's code points; products stay within a long."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(points, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


@query("SELECT n_name, CAST(list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS BIGINT) AS hash FROM nation")
def fnv_hash(t: Tables) -> DataFrame:
    return t.nation.select("n_name", fnv1a(F.col("n_name")).alias("hash"))


#: What marks a query as one for code, and what its keyword stream's share is multiplied by.
CODE_MARKS = [r"[a-z][A-Z]", r"_\w", r"\w\(", r"::", r"->", r"=>", r"\w\.\w+\(", r"^[A-Z][A-Za-z0-9]*$", r"\.(ts|js|py|rs|go|kt)\b"]
CODE_BOOST = 2.5


@query("SELECT item_id, CASE WHEN regexp_matches(text, '[a-z][A-Z]|_[A-Za-z0-9_]|[A-Za-z0-9_][(]|::|->|=>|^[A-Z][A-Za-z0-9]*$|[.](ts|js|py|rs|go|kt)([^A-Za-z0-9_]|$)') THEN 2.5 ELSE 1.0 END::DOUBLE AS boost FROM benchmark")
def code_query(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.when(any_of([F.col("text").rlike(p) for p in CODE_MARKS]), CODE_BOOST).otherwise(1.0).alias("boost"))


# --- JSON, arrays, times
def patched(object_text: Column, key: str, value: str) -> Column:
    """A JSON object's text with a key set to a JSON value. The other values keep their types; what is no object counts as an empty one."""
    held = F.coalesce(F.try_variant_get(F.try_parse_json(object_text), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(F.lit(key), F.parse_json(F.lit(value)))))


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || ',"seen":true}' AS props FROM events""")
def json_patch(t: Tables) -> DataFrame:
    """A key set in an object, the others kept."""
    return t.events.select("event_id", patched(F.col("props"), "seen", "true").alias("props"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_unescape(t: Tables) -> DataFrame:
    """Objects that were escaped twice are read as those that were not."""
    twice = F.replace("props", F.lit('"'), F.lit('\\"'))
    plain = F.when(F.get_json_object(twice, "$.k").isNull(), F.replace(twice, F.lit('\\"'), F.lit('"'))).otherwise(twice)
    return t.events.select("event_id", F.get_json_object(plain, "$.k").alias("k"))


def array_text(elements: Column) -> Column:
    """A one-dimensional array of texts as a literal, {a,"x,y"}: quoted where an element needs it."""
    escaped = lambda x: F.concat(F.lit('"'), F.regexp_replace(x, r'([\\"])', r"\\$1"), F.lit('"'))
    plain = lambda x: x.rlike(r'^[^{},"\\\s]+$') & (F.lower(x) != "null")
    one = lambda x: F.when(x.isNull(), "NULL").when(plain(x), x).otherwise(escaped(x))
    return F.concat(F.lit("{"), F.array_join(F.transform(elements, one), ","), F.lit("}"))


def array_elements(literal: Column) -> Column:
    """The elements of an array literal: quoted ones without quotes and escapes, a bare NULL as null; null for what is no literal."""
    body = F.regexp_extract(literal, r"(?s)^\s*\{(.*)\}\s*$", 1)
    parts = F.regexp_extract_all(body, F.lit(r'(?s)\s*("(?:[^"\\]|\\.)*"|[^,"]*[^,"\s])\s*(?:,|$)'), F.lit(1))
    bare = lambda x: F.when(F.upper(F.trim(x)) == "NULL", F.lit(None)).otherwise(F.trim(x))
    quoted = lambda x: F.regexp_replace(F.substring(x, F.lit(2), F.length(x) - 2), r"(?s)\\(.)", "$1")
    return F.when(literal.rlike(r"(?s)^\s*\{.*\}\s*$"), F.transform(parts, lambda x: F.when(x.startswith('"'), quoted(x)).otherwise(bare(x))))


@query("SELECT id, array_to_string(list_slice(string_split(content, ' '), 1, 20), '|') AS words, len(list_slice(string_split(content, ' '), 1, 20)) AS n FROM chunks")
def array_literal(t: Tables) -> DataFrame:
    """The first words of each text, written as an array literal and read back."""
    words = t.chunks.select("id", array_text(F.slice(F.split("content", " ", -1), 1, 20)).alias("literal"))
    return words.withColumn("w", array_elements(F.col("literal"))).select("id", F.array_join("w", "|").alias("words"), F.size("w").cast("long").alias("n"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + CASE event_type WHEN 'view' THEN 3600 WHEN 'click' THEN 300 ELSE 86400 END AS expires FROM events")
def ttl_expiry(t: Tables) -> DataFrame:
    """A time and an interval written as number and unit."""
    life = F.when(F.col("event_type") == "view", "1h").when(F.col("event_type") == "click", "5m").otherwise("1d")
    unit = F.create_map(*[F.lit(x) for pair in (("s", 1), ("m", 60), ("h", 3600), ("d", 86400)) for x in pair])
    seconds = F.regexp_extract(life, r"^(\d+)", 1).cast("long") * unit[F.right(life, F.lit(1))]
    return t.events.select("event_id", (F.unix_seconds(F.col("ts").cast("timestamp")) + seconds).alias("expires"))


# --- sinks and lookups
@query("SELECT id FROM chunks WHERE project <> 'src3' AND id NOT IN (5, 9) AND file <> 'src1/7.en'")
def delete_rows(t: Tables) -> DataFrame:
    """What stays after deletes by project, by id and by file; files are rewritten without the rest."""
    gone = t.spark.createDataFrame([("src3", None, None), (None, 5, None), (None, 9, None), (None, None, "src1/7.en")], "project string, id long, file string")
    out = t.chunks.select("id", "project", "file")
    for by in ("project", "id", "file"):
        out = out.join(F.broadcast(gone.where(F.col(by).isNotNull()).select(by)), by, "left_anti")  # the request's few rows
    return out.select("id")


@query("SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE json_extract_string(props, '$.k')::BIGINT END AS k, event_id % 10 = 3 AS failed FROM events")
def batch_upsert(t: Tables) -> DataFrame:
    """A bad row fails alone: it goes to quarantine with its mark, the rest of its batch is written."""
    raw = F.when(F.col("event_id") % 10 == 3, F.lit("no number")).otherwise(F.get_json_object("props", "$.k"))
    k = raw.try_cast("long")
    return t.events.select("event_id", k.alias("k"), (raw.isNotNull() & k.isNull()).alias("failed"))


@query("SELECT project_id, event_id, event_type FROM search_events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY ts_s DESC, event_id DESC) <= 30")
def audit_log(t: Tables) -> DataFrame:
    """The newest operations of each project."""
    e = t.search_events.where("event_type <> 'view'")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("ts_s"), F.desc("event_id")))
    return e.withColumn("n", place).where("n <= 30").select("project_id", "event_id", "event_type")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || upper(event_type) || '] ' || props AS line FROM events WHERE event_type = 'error'")
def log_export(t: Tables) -> DataFrame:
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return t.events.where("event_type = 'error'").select("event_id", F.concat(stamp, F.lit(" ["), F.upper("event_type"), F.lit("] "), "props").alias("line"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'both' ELSE 'left' END AS found FROM part WHERE p_partkey <= (SELECT max(p_partkey) FROM part)")
def set_operations(t: Tables) -> DataFrame:
    """INTERSECT and EXCEPT of two id sets."""
    a, b = t.part.select(F.col("p_partkey").alias("id")), t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"))
    return a.intersect(b).withColumn("found", F.lit("both")).unionByName(a.exceptAll(b).withColumn("found", F.lit("left")))


@query("SELECT from_id, to_id, edge_type FROM memory_edges WHERE NOT (from_id = 's1' AND to_id IN ('p2', 'p3')) UNION ALL SELECT 's1', 's2', 'M'")
def link_unlink(t: Tables) -> DataFrame:
    """Links made and removed by hand."""
    gone = t.spark.createDataFrame([("s1", "p2"), ("s1", "p3")], "from_id string, to_id string")
    made = t.spark.createDataFrame([("s1", "s2", "M")], "from_id string, to_id string, edge_type string")
    return t.memory_edges.select("from_id", "to_id", "edge_type").join(F.broadcast(gone), ["from_id", "to_id"], "left_anti").unionByName(made)


@query("""SELECT project_id, query, n FROM (SELECT project_id, query, count(*) AS n FROM search_events GROUP BY 1, 2) x QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY n DESC, query) <= 5""")
def cache_warmup(t: Tables) -> DataFrame:
    """The queries of each project that are run again when a cache starts empty."""
    counts = t.search_events.groupBy("project_id", "query").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("n"), "query"))).where("r <= 5").drop("r")


@query("""WITH s AS (SELECT project, max(id) AS newest, count(*) AS files FROM chunks GROUP BY project), asked AS (SELECT DISTINCT source AS project FROM documents UNION SELECT 'none')
  SELECT a.project, CASE WHEN files IS NULL THEN 'not indexed' WHEN newest < (SELECT max(id) FROM chunks) - 20 THEN 'stale' ELSE 'ready' END AS state FROM asked a LEFT JOIN s ON s.project = a.project""")
def search_admission(t: Tables) -> DataFrame:
    """A project must be indexed to be searched; one indexed long ago is searched with a warning."""
    s = t.chunks.groupBy("project").agg(F.max("id").alias("newest"))
    asked = t.documents.select(F.col("source").alias("project")).union(t.spark.createDataFrame([("none",)], "project string")).distinct()
    top = t.chunks.agg(F.max("id").alias("top"))
    met = asked.join(s, asked["project"].eqNullSafe(s["project"]) & asked["project"].isNotNull(), "left").select(asked["project"], "newest").join(F.broadcast(top))  # one row
    return met.select("project", F.when(F.col("newest").isNull(), "not indexed").when(F.col("newest") < F.col("top") - 20, "stale").otherwise("ready").alias("state"))


@query("SELECT id, type FROM memories WHERE id IN (2, 40, 77) UNION ALL SELECT id, type FROM (SELECT id, type FROM memories ORDER BY age_days, id DESC LIMIT 10) x")
def collection_query(t: Tables) -> DataFrame:
    """Rows by id, and the most recent ones."""
    by_id = t.memories.where(F.col("id").isin(2, 40, 77)).select("id", "type")
    return by_id.unionByName(t.memories.orderBy("age_days", F.desc("id")).limit(10).select("id", "type"))


@query("SELECT n AS wanted, CASE WHEN filtered THEN CASE WHEN 5 * n < n + 200 THEN 5 * n ELSE n + 200 END ELSE 2 * n END AS fetched FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n, l_linestatus = 'F' AS filtered FROM lineitem) x")
def overfetch_limit(t: Tables) -> DataFrame:
    """How many rows to fetch lest filters leave too few."""
    n = F.col("n")
    asked = t.lineitem.select(F.col("l_quantity").cast("long").alias("n"), (F.col("l_linestatus") == "F").alias("filtered")).distinct()
    return asked.select(n.alias("wanted"), F.when(F.col("filtered"), F.least(5 * n, n + 200)).otherwise(2 * n).alias("fetched"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 0.0 ELSE importance END AS raw FROM memories WHERE CASE WHEN id % 3 = 0 THEN 0.0 ELSE importance END >= 0.3")
def memory_only_gate(t: Tables) -> DataFrame:
    """What only the graph found has a raw score of 0, so that the least score drops it."""
    rows = t.memories.select("id", F.when(F.col("id") % 3 != 0, F.col("importance")).alias("found"), F.lit(0.45).alias("graph"))
    raw = F.when(F.col("found").isNull() & F.col("graph").isNotNull(), 0.0).otherwise(F.col("found"))
    return rows.select("id", raw.alias("raw")).where("raw >= 0.3")


@query("""SELECT p, CASE WHEN length(p) > 0 AND NOT contains(p, '[') THEN 'include' ELSE 'bad' END AS verdict FROM (SELECT DISTINCT p_brand AS p FROM part UNION SELECT '[a' UNION SELECT '') x""")
def filter_validation(t: Tables) -> DataFrame:
    """Patterns that don't close their classes, or are empty, are refused."""
    asked = t.part.select(F.col("p_brand").alias("p")).distinct().union(t.spark.createDataFrame([("[a",), ("",)], "p string"))
    sound = (F.length("p") > 0) & (F.length(F.regexp_replace("p", r"[^\[]", "")) == F.length(F.regexp_replace("p", r"[^\]]", "")))
    return asked.select("p", F.when(sound, "include").otherwise("bad").alias("verdict"))


@query("""SELECT d.id, CASE WHEN c > p THEN 'c' WHEN p > 0 THEN 'cpp' ELSE 'c' END AS language FROM definitions d LEFT JOIN (
  SELECT to_id, count(*) FILTER (WHERE from_id % 3 = 0) AS p, count(*) FILTER (WHERE from_id % 3 <> 0) AS c FROM (SELECT DISTINCT from_id, to_id FROM imports) i GROUP BY to_id) v ON v.to_id = d.id""")
def header_language(t: Tables) -> DataFrame:
    """A header's language by the votes of the files that import it."""
    votes = t.imports.distinct().select(F.col("to_id").alias("id"), F.when(F.col("from_id") % 3 == 0, 1).otherwise(-1).alias("cpp"))
    sums = votes.groupBy("id").agg(F.sum("cpp").alias("lead"), F.max("cpp").alias("any"))
    language = F.when((F.col("any") == 1) & (F.col("lead") >= 0), "cpp").otherwise("c")
    return t.definitions.select("id").join(sums, "id", "left").select("id", language.alias("language"))


@query("SELECT DISTINCT i.from_id AS id FROM imports i JOIN (SELECT id FROM definitions WHERE id % 97 = 0) c ON c.id = i.to_id UNION SELECT id FROM definitions WHERE id % 97 = 0")
def changed_and_importers(t: Tables) -> DataFrame:
    """A diff's changed files, as a table of paths, and the files that import them."""
    changed = t.definitions.where("id % 97 = 0").select("id")
    return changed.union(t.imports.join(changed, F.col("to_id") == F.col("id"), "left_semi").select("from_id")).distinct()


# --- import specifiers
def normal_path(path: Column) -> Column:
    """A path without . and .. steps."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    return F.array_join(walked, "/")


#: What is tried after a specifier's path, in order.
ENDINGS = ["", ".ts", ".tsx", ".js", "/index.ts", "/index.js"]


def resolve_specifiers(asked: DataFrame, files: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """asked: file, spec. files: path. The file that each relative or aliased specifier names, null where there is none."""
    folder = F.regexp_replace("file", "[^/]*$", "")
    base = F.when(F.col("spec").startswith("."), F.concat(folder, "spec"))
    for name, root in sorted(aliases.items(), key=lambda x: len(x[0])):
        base = F.when(F.col("spec").startswith(name + "/") | (F.col("spec") == name), F.concat(F.lit(root), F.substring(F.col("spec"), F.lit(len(name) + 1), F.length("spec")))).otherwise(base)
    tried = asked.withColumn("base", normal_path(base)).withColumn("t", F.explode_outer(F.when(F.col("base").isNotNull(), F.array(*[F.struct(F.lit(k).alias("n"), F.concat("base", F.lit(e)).alias("path")) for k, e in enumerate(ENDINGS)]))))
    known = files.select(F.col("path").alias("target"))
    met = tried.join(known, F.col("t.path") == F.col("target"), "left")
    return met.groupBy("file", "spec").agg(F.min_by("target", F.when(F.col("target").isNotNull(), F.col("t.n"))).alias("target"))


# --- sessions and spans: peers meet in slots of the time or line axis
WINDOW = 600


def co_retrieved(t: Tables) -> DataFrame:
    """Pairs of searches of one session (here: of a project), the peer at most ten minutes before: event_id, k, peer, peer_k, at."""
    e = t.search_events.select("event_id", "project_id", "ts_s", "k")
    slot = F.floor(F.col("ts_s") / WINDOW)
    peers = e.select("project_id", F.col("event_id").alias("peer"), F.col("ts_s").alias("at"), F.col("k").alias("peer_k"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    return e.withColumn("slot", slot).join(peers, ["project_id", "slot"]).where(F.col("at").between(F.col("ts_s") - WINDOW, F.col("ts_s")) & (F.col("event_id") != F.col("peer")))


@query("""SELECT event_id, peer FROM (SELECT a.event_id, b.event_id AS peer, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts_s DESC, b.event_id DESC) AS place
  FROM search_events a JOIN search_events b ON a.project_id = b.project_id AND b.ts_s BETWEEN a.ts_s - 600 AND a.ts_s AND a.event_id <> b.event_id) x WHERE place <= 5""")
def co_retrieval_pairs(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("at"), F.desc("peer")))
    return co_retrieved(t).withColumn("n", place).where("n <= 5").select("event_id", "peer")


@query("""SELECT a, b, least(0.85, round(0.15 + 0.1 * (n - 1), 6)) AS weight FROM (SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, count(*) AS n
  FROM search_events x JOIN search_events y ON x.project_id = y.project_id AND y.ts_s BETWEEN x.ts_s - 600 AND x.ts_s AND x.event_id > y.event_id AND x.k <> y.k GROUP BY 1, 2) z""")
def co_retrieval_weights(t: Tables) -> DataFrame:
    met = co_retrieved(t).where("event_id > peer AND k <> peer_k").groupBy(F.least("k", "peer_k").alias("a"), F.greatest("k", "peer_k").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return met.select("a", "b", F.least(F.lit(0.85), F.round(0.15 + 0.1 * (F.col("n") - 1), 6)).alias("weight"))


@query("""WITH spans AS (SELECT id, package, line_start AS a, line_start + 3 AS b FROM definitions)
  SELECT x.id, count(*) AS overlaps FROM spans x JOIN spans y ON x.package = y.package AND x.id <> y.id AND x.a - 1 <= y.b AND y.a <= x.b + 1 GROUP BY x.id""")
def range_overlap_hits(t: Tables) -> DataFrame:
    """Spans of a package that overlap with a line to spare: how many there are, from counts by first line, so no pair is made."""
    spans = t.definitions.select("id", "package", F.col("line_start").alias("a"))
    counts = spans.groupBy("package", "a").agg(F.count(F.lit(1)).alias("n"))
    near = spans.withColumn("at", F.explode(F.sequence(F.col("a") - 4, F.col("a") + 4))).join(counts.withColumnRenamed("a", "at"), ["package", "at"])
    return near.groupBy("id").agg((F.sum("n") - 1).alias("overlaps")).where("overlaps > 0")


# --- files of an index: what changed since the last generation
def _stored(t: Tables) -> DataFrame:
    """The active generation (a stand-in): files with the hashes of what they held; some changed since, some are new, some are gone."""
    held = F.when(F.col("id") % 4 == 0, F.col("content")).otherwise(F.concat("content", F.lit(" ")))
    return t.chunks.where("id % 7 <> 3").select("file", F.sha2(held, 256).alias("old")).unionByName(t.spark.createDataFrame([("gone/1.ts", "00")], "file string, old string"))


@query("SELECT id, sha256(content) AS hash, id % 7 = 3 OR id % 4 <> 0 AS needs_reparse FROM chunks")
def discover_changed(t: Tables) -> DataFrame:
    """Files whose content has another hash than the stored one, or none."""
    now = t.chunks.select("id", "file", F.sha2("content", 256).alias("hash"))
    return now.join(_stored(t), "file", "left").select("id", "hash", (~F.col("hash").eqNullSafe(F.col("old"))).alias("needs_reparse"))


@query("SELECT file, CASE WHEN id % 7 = 3 OR id % 4 <> 0 THEN 'parsed' ELSE 'copied' END AS origin FROM chunks UNION ALL SELECT 'gone/1.ts', 'dropped'")
def generation_copy_forward(t: Tables) -> DataFrame:
    """A new generation: unchanged files come from the active one, changed and new ones are parsed, those that are gone drop out."""
    now = t.chunks.select(F.col("file").alias("f"), F.sha2("content", 256).alias("hash"))
    met = now.join(_stored(t), F.col("f") == F.col("file"), "full")
    return met.select(F.coalesce("f", "file").alias("file"), F.when(F.col("f").isNull(), "dropped").when(F.col("hash").eqNullSafe(F.col("old")), "copied").otherwise("parsed").alias("origin"))


# --- what a path says
#: Paths that hold secrets, tests, documents and sources. Java's patterns, case ignored.
SECRETS = [r"\.env", r"\.key$", r"\.pem$", r"\.p12$", r"\.pfx$", r"^secrets?\.", r"\.keystore$", r"^id_rsa", r"\.asc$"]
TESTS = r"(?i)(^|/)(test|tests|spec|specs|__tests__)(/|$)|(\.|_|-)(test|spec)\.(t|j)sx?$"
DOCS = r"(?i)(^|/)docs?/|\.(md|mdx|rst|adoc)$|(^|/)(readme|changelog)"
SOURCES = r"(?i)(^|/)migrations/|\.(ts|tsx|js|jsx|py|go|rs|java|cpp|c|h|hpp|cs|rb|kt|swift|dart|scala|php|lua|sh|sql)$"


def is_secret(path: Column) -> Column:
    return path.rlike("(?i)" + "|".join(SECRETS))


def kind_of_path(path: Column) -> Column:
    return F.when(path.rlike(TESTS), "code-test").when(path.rlike(DOCS), "documentation").when(path.rlike(SOURCES), "code")


def _paths(t: Tables) -> DataFrame:
    """Files of every sort (a stand-in), by id."""
    ends = ["/a.ts", "/tests/b.py", "/.env.local", "/c_spec.js", "/docs/d.txt", "/README", "/migrations/1", "/id_rsa.pub", "/key.pem", "/data.bin"]
    return t.definitions.select("id", F.concat("package", F.array(*map(F.lit, ends))[(F.col("id") % 10).cast("int")]).alias("path"))


@query("SELECT id FROM definitions WHERE id % 10 IN (2, 8)")
def secret_paths(t: Tables) -> DataFrame:
    return _paths(t).where(is_secret(F.col("path"))).select("id")


@query("SELECT id, id % 10 IN (1, 3) AS is_test FROM definitions")
def is_test_file(t: Tables) -> DataFrame:
    return _paths(t).select("id", F.col("path").rlike(TESTS).alias("is_test"))


@query("SELECT id, CASE WHEN id % 10 IN (1, 3) THEN 'code-test' WHEN id % 10 IN (4, 5) THEN 'documentation' WHEN id % 10 IN (0, 6) THEN 'code' END AS type FROM definitions")
def infer_type(t: Tables) -> DataFrame:
    return _paths(t).select("id", kind_of_path(F.col("path")).alias("type"))


# --- edges of code
#: What a call is by its last name and, where one is given, by its first; the first row that holds it counts.
LISTENS = ["on", "once", "addListener", "addEventListener", "subscribe"]
CLIENTS = ["axios", "http", "https", "client", "api", "ky", "got"]
METHODS = ["get", "post", "put", "patch", "delete", "request"]
CALLS: list[tuple[str, list[str], list[str]]] = [
    ("http_call", ["query", "mutate", "subscribe"], ["trpc"]), ("emit", ["emit"], []), ("listen", LISTENS, []), ("http_call", ["fetch", "graphql", "gql"], []), ("http_call", METHODS, CLIENTS),
]
REMOTE = r"^(https?://|/api(/|$))"


def edge_of_call(target: Column, first: Column) -> Column:
    """The kind of edge that a call is, from the dotted name it calls and its first literal. trpc listens to nothing but by its own rows."""
    steps = F.split(target, r"\.")
    last, root = F.element_at(steps, -1), F.when(F.size(steps) > 1, steps[0])
    kind = F.when(F.coalesce(first.rlike(REMOTE), F.lit(False)), "http_call").otherwise("call")
    for name, names, roots in reversed(CALLS):
        fits = last.isin(names) & (F.coalesce(root.isin(roots), F.lit(False)) if roots else F.lit(True))
        if name == "listen":
            fits = fits & ~F.coalesce(root == "trpc", F.lit(False))
        kind = F.when(fits, name).otherwise(kind)
    return kind


@query("SELECT from_id, target_id, line, file, CASE target_id % 6 WHEN 0 THEN 'emit' WHEN 1 THEN 'listen' WHEN 2 THEN 'http_call' WHEN 3 THEN 'http_call' WHEN 4 THEN 'http_call' ELSE 'call' END AS edge_kind FROM refs")
def edge_kind(t: Tables) -> DataFrame:
    k = (F.col("target_id") % 6).cast("int")
    target = F.array(*map(F.lit, ["bus.emit", "bus.on", "axios.get", "trpc.query", "load", "a.b.load"]))[k]
    return t.refs.select("from_id", "target_id", "line", "file", edge_of_call(target, F.when(k == 4, "/api/x")).alias("edge_kind"))


@query("""WITH seeds AS (SELECT id % 7 AS query_id, id FROM definitions WHERE id % 50 = 0), one AS (SELECT DISTINCT s.query_id, i.to_id AS id FROM imports i JOIN seeds s ON s.id = i.from_id),
  two AS (SELECT DISTINCT o.query_id, i.to_id AS id FROM imports i JOIN one o ON o.id = i.from_id), near AS (SELECT query_id, id, min(d) AS d FROM (SELECT *, 1 AS d FROM one UNION ALL SELECT *, 2 FROM two) x GROUP BY query_id, id)
  SELECT query_id, id, 0.45::DOUBLE AS score FROM near n WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.id = n.id AND s.query_id = n.query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 50""")
def graph_stream(t: Tables) -> DataFrame:
    """Neighbours within two steps of each query's seeds, as hybrid_search has them."""
    from loomwright.plans.retrieval import neighbour_stream

    seeds = t.definitions.where("id % 50 = 0").select((F.col("id") % 7).alias("query_id"), "id")
    return neighbour_stream(t, seeds).select("query_id", "id", "score")


# --- compression, and sections by intent
@query("""SELECT id, CASE WHEN o = 0 THEN 0 ELSE round((o - c) / o, 3) END AS ratio, (least(CASE WHEN o = 0 THEN 0 ELSE round((o - c) / o, 3) END, 0.9) + CASE WHEN c > 0 THEN 1 ELSE 0.5 END) / 2 AS quality
  FROM (SELECT id, ceil(length(content) / 4.0)::DOUBLE AS o, ceil(length(string_split(content, chr(10))[1]) / 4.0)::DOUBLE AS c FROM chunks) x""")
def compression_ratio(t: Tables) -> DataFrame:
    """Of a text cut to its first line: the share of tokens saved, to three digits, and its quality."""
    tokens = lambda x: F.ceil(F.length(x) / 4).cast("double")
    o, c = tokens(F.col("content")), tokens(F.element_at(F.split("content", "\n", -1), 1))
    ratio = F.when(o == 0, F.lit(0.0)).otherwise(F.round((o - c) / o, 3))
    return t.chunks.select("id", ratio.alias("ratio"), ((F.least(ratio, F.lit(0.9)) + F.when(c > 0, 1.0).otherwise(0.5)) / 2).alias("quality"))


#: The least bytes of a text that is searched by sections, sections returned, and what a term in a section's title adds.
SECTION_BYTES, SECTIONS, TITLE = 5000, 5, 0.5
_INTENT = ["the", "und", "que"]


@query("""WITH s AS (SELECT id, unnest(string_split(content, chr(10))) AS body, unnest(range(len(string_split(content, chr(10))))) AS pos FROM chunks WHERE octet_length(encode(content)) >= 5000),
  f AS (SELECT id, pos, (len(list_filter(string_split(lower(body), ' '), lambda w: w IN ('the', 'und', 'que'))))::DOUBLE AS tf, CASE WHEN list_contains(['the', 'und', 'que'], string_split(lower(body), ' ')[1]) THEN 0.5 ELSE 0.0 END AS title FROM s),
  r AS (SELECT id, pos, tf / max(tf) OVER (PARTITION BY id) + title AS score, tf FROM f)
  SELECT id, pos, round(score, 6) AS score FROM r WHERE tf > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) <= 5""")
def intent_search(t: Tables) -> DataFrame:
    """Of long texts, the sections (here: lines) that hold most of an intent's terms; a text's sections stay in its row until they are ranked."""
    long = t.chunks.where(F.octet_length("content") >= SECTION_BYTES).select("id", F.split("content", "\n", -1).alias("parts"))
    count = lambda x: F.size(F.filter(F.split(F.lower(x), " "), lambda w: w.isin(_INTENT))).cast("double")
    tf = long.withColumn("tf", F.transform("parts", count)).withColumn("top", F.array_max("tf"))
    bonus = lambda x: F.when(F.element_at(F.split(F.lower(x), " "), 1).isin(_INTENT), TITLE).otherwise(0.0)
    scored = F.transform("parts", lambda x, k: F.struct((-(F.get("tf", k) / F.nullif("top", F.lit(0.0)) + bonus(x))).alias("s"), k.cast("long").alias("pos"), F.get("tf", k).alias("tf")))
    best = tf.where("top > 0").select("id", F.explode(F.slice(F.array_sort(F.filter(scored, lambda x: x["tf"] > 0)), 1, SECTIONS)).alias("x"))
    return best.select("id", "x.pos", F.round(-F.col("x.s"), 6).alias("score"))


# --- versioned tables: what is read back is what was written
@query("""WITH d AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type)
  SELECT user_id, max(event_type) AS event_type, arg_max(event_id, event_type) AS event_id FROM d WHERE user_id NOT IN (SELECT n_nationkey FROM nation) GROUP BY user_id""")
def generation_upserts(t: Tables) -> DataFrame:
    """A table of users' last events, written type by type, each under a lease and as a generation of its own; then some users are deleted and parts are compacted."""
    table = VersionedTable(t.spark, shared_folder(t.spark, "users"), "user_id")
    last = t.events.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    for kind in [r[0] for r in t.events.select("event_type").distinct().orderBy("event_type").collect()]:  # the types of events: a few
        lease = table.begin("load")
        table.activate(table.stage(last.where(F.col("event_type") == kind)), table.version(), lease=lease, batch=kind)
    table.delete(t.nation.select("n_nationkey"))
    table.compact()
    return table.read().select("user_id", "event_type", "event_id")


@query("""SELECT a, b, n, least(0.85, round(0.15 + 0.1 * (n - 1), 6)) AS weight FROM (SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, count(*) AS n
  FROM search_events x JOIN search_events y ON x.project_id = y.project_id AND y.ts_s BETWEEN x.ts_s - 600 AND x.ts_s AND (y.ts_s < x.ts_s OR y.event_id < x.event_id) AND x.k <> y.k GROUP BY 1, 2) z""")
def co_retrieval_links(t: Tables) -> DataFrame:
    """The links of searches, merged into a versioned table in two batches, the second of which comes twice."""
    table = VersionedTable(t.spark, shared_folder(t.spark, "links"), "link")
    found = links.pairs(t.search_events.select("event_id", F.col("project_id").alias("session"), F.col("k").alias("item"), F.timestamp_seconds("ts_s").alias("ts")))
    found = _cut(found.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))  # both batches take from it
    for batch in (0, 1, 1):
        links.merge(table, found.where(F.pmod(F.xxhash64("a", "b"), F.lit(2)) == batch), f"links-{batch}")
    return table.read().select("a", "b", "n", "weight")
