"""The driver's tables and the domain views over them: chunks, memories, events, code graph, memory graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Domain views, in Spark SQL; `to_duckdb` gives the same for DuckDB. Each may use base tables and views above it.
VIEWS: dict[str, str] = {
    "chunks": "SELECT doc_id AS id, coalesce(text, '') AS content, source AS project, lang, concat(source, '/', CAST(doc_id AS STRING), '.', lang) AS file, n_chars FROM documents",
    "memories": """
        SELECT vec_id AS id, embedding, concat('t', CAST(label AS STRING)) AS type, (vec_id % 100) / 100.0 AS importance, vec_id % 7 AS access_count,
               CAST(vec_id % 90 AS BIGINT) AS age_days, vec_id % 5 AS user_id, vec_id % 11 AS session_id, vec_id % 3 AS project_id,
               vec_id % 13 = 0 AS pinned, vec_id % 17 = 0 AS deleted, CASE vec_id % 3 WHEN 0 THEN 'SESSION' WHEN 1 THEN 'USER' ELSE 'PROJECT' END AS level,
               concat('tag', CAST(vec_id % 6 AS STRING)) AS tag
        FROM embeddings""",
    "memory_texts": "SELECT m.*, d.text AS content FROM memories m JOIN documents d ON d.doc_id = m.id",
    "search_events": """
        SELECT event_id, EPOCH_S(ts) AS ts_s, user_id AS session_id, user_id % 5 AS project_id, event_type, concat(event_type, ':', JSON_TEXT(props, '$.k')) AS query,
               value AS duration, event_type = 'view' AS cache_hit, TRY_CAST(JSON_TEXT(props, '$.k') AS BIGINT) AS k
        FROM events""",
    "imports": """
        SELECT from_id, to_id FROM (
          SELECT l_partkey AS from_id, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS to_id FROM lineitem) x
        WHERE to_id IS NOT NULL""",
    "definitions": "SELECT p_partkey AS id, p_name AS name, concat(p_brand, '/', p_type, '/', CAST(p_partkey AS STRING)) AS path, p_brand AS package, p_type AS kind, p_size % 2 = 0 AS exported, p_size AS line_start FROM part",
    "refs": "SELECT o.o_custkey AS from_id, l.l_partkey AS target_id, l.l_returnflag AS kind, l.l_linenumber AS line, l.l_orderkey AS file FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey",
    "memory_edges": """
        SELECT from_id, to_id, edge_type, max(weight) AS weight FROM (
          SELECT concat('s', CAST(l_suppkey AS STRING)) AS from_id, concat('p', CAST(l_partkey AS STRING)) AS to_id, l_linestatus AS edge_type, round(l_discount * 10, 2) AS weight FROM lineitem) x
        GROUP BY from_id, to_id, edge_type""",
    "roots": "SELECT concat('/', r_name) AS root, r_name AS project FROM region UNION ALL SELECT concat('/', r_name, '/', n_name), n_name FROM nation JOIN region ON n_regionkey = r_regionkey",
}

_DUCK = [
    (r"\bEPOCH_S\(", "CAST(epoch("), (r"\bJSON_TEXT\(", "json_extract_string("), (r"\bEXPLODE\(", "unnest("), (r"\bSPLIT\(", "string_split("),
    (r"\bSIZE\(", "len("), (r"\bREGEXP_LIKE\(", "regexp_matches("), (r"\bSHA_256\(", "sha256("), (r"\bREPLACE_ALL\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"regexp_replace(\1, 'g')"),
    (r"\bSTARTS_WITH\(", "starts_with("), (r"\bFIND_ALL\(", "regexp_extract_all("), (r"\bARRAY_AT\(", "list_extract("), (r"\bOCTETS\(", "octet_length(encode("),
]
_SPARK = [
    (r"\bEPOCH_S\(([^()]*)\)", r"unix_seconds(CAST(\1 AS TIMESTAMP))"), (r"\bJSON_TEXT\(", "get_json_object("), (r"\bEXPLODE\(", "explode("), (r"\bSPLIT\(", "split("),
    (r"\bSIZE\(", "size("), (r"\bREGEXP_LIKE\(", "regexp_like("), (r"\bSHA_256\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"sha2(\1, 256)"), (r"\bREPLACE_ALL\(", "regexp_replace("),
    (r"\bSTARTS_WITH\(", "startswith("), (r"\bFIND_ALL\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"regexp_extract_all(\1, 0)"), (r"\bARRAY_AT\(", "element_at("),
]


def _closed(sql: str) -> str:
    """DuckDB's epoch is a double: casts it to whole seconds."""
    return re.sub(r"CAST\(epoch\(([^()]*)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", sql)


def to_duckdb(sql: str) -> str:
    for a, b in _DUCK:
        sql = re.sub(a, b, sql)
    return _closed(sql)


def to_spark(sql: str) -> str:
    for a, b in _SPARK:
        sql = re.sub(a, b, sql)
    return re.sub(r"(?<![\w'.])(\d+\.\d+)(?![\w'.])", r"\1D", sql)  # DuckDB divides decimals as doubles


def needed(sql: str) -> list[str]:
    """Views that a query uses, in order of definition, those that views use included."""
    wanted: set[str] = set()

    def walk(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                walk(body)

    walk(sql)
    return [n for n in VIEWS if n in wanted]


def oracle(sql: str) -> str:
    """A query over base tables and views as one DuckDB statement."""
    parts = [f"{n} AS ({to_duckdb(VIEWS[n])})" for n in needed(sql)]
    body = to_duckdb(sql.strip())
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {', '.join(parts)}, {body[4:]}"
    return f"WITH {', '.join(parts)} {body}"


class Tables:
    """Base tables and domain views of one folder, as DataFrames by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in BASE:
                self._known[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                self._known[name] = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._known[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Runs a query over base tables, views and the named frames, which are bound for this one statement."""
        for name in [*BASE, *needed(text)]:
            if re.search(rf"\b{name}\b", text) and name not in frames:
                frames[name] = getattr(self, name)
        for name, df in frames.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(to_spark(text))
