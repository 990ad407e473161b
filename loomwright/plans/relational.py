"""Scans, sinks, filters, joins and aggregations that are one statement each."""

from __future__ import annotations

from loomwright.registry import statement

# --- sources and scans
statement("resume_cursor", "SELECT id, file FROM chunks WHERE file > 'src3'")
statement("discover_priority", """
    SELECT c.id, c.file, coalesce(m.importance, 0.0) AS centrality FROM chunks c LEFT JOIN memories m ON m.id = c.id
    ORDER BY centrality DESC, c.n_chars DESC, c.file LIMIT 100""")
statement("path_policy", """
    SELECT id, CASE WHEN REGEXP_LIKE(file, '^src1/') THEN 'Drop' WHEN REGEXP_LIKE(file, '[.]de$') THEN 'Skip' WHEN REGEXP_LIKE(file, '^src[0-9]/') THEN 'Keep' ELSE 'Default' END AS policy
    FROM chunks""")
statement("stale_files", """
    WITH old AS (SELECT file, n_chars AS bytes, id % 10 AS mtime FROM chunks WHERE id % 7 <> 0),
    now AS (SELECT file, CASE WHEN id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS bytes, CASE WHEN id % 6 = 0 THEN 11 ELSE id % 10 END AS mtime FROM chunks WHERE id % 11 <> 0)
    SELECT coalesce(now.file, old.file) AS file,
           CASE WHEN old.file IS NULL THEN 'new' WHEN now.file IS NULL THEN 'deleted' WHEN now.mtime > old.mtime OR now.bytes <> old.bytes THEN 'modified' ELSE 'same' END AS state
    FROM now FULL OUTER JOIN old ON now.file = old.file""")
statement("files_to_reindex", """
    WITH old AS (SELECT file, n_chars AS bytes FROM chunks WHERE id % 7 <> 0),
    now AS (SELECT file, CASE WHEN id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS bytes FROM chunks)
    SELECT now.file FROM now LEFT JOIN old ON now.file = old.file WHERE old.file IS NULL OR old.bytes <> now.bytes""")
statement("active_snapshot_scan", """
    WITH active AS (SELECT p_brand AS package, max(p_size) AS generation FROM part GROUP BY p_brand)
    SELECT d.id, d.path FROM definitions d JOIN active a ON d.package = a.package AND d.line_start = a.generation""")
statement("memory_page", "SELECT id, type, age_days FROM memories WHERE NOT deleted ORDER BY age_days, id DESC LIMIT 25 OFFSET 50")
statement("memory_page_total", """
    SELECT id, total FROM (SELECT id, age_days FROM memories WHERE level = 'USER' ORDER BY age_days, id DESC LIMIT 20 OFFSET 20) x, (SELECT count(*) AS total FROM memories WHERE level = 'USER') n""")
statement("active_projects", "SELECT DISTINCT project_id FROM search_events WHERE project_id IS NOT NULL")

# --- sinks
statement("upsert_latest", """
    SELECT id, stamp FROM (
      SELECT id, stamp, row_number() OVER (PARTITION BY id ORDER BY stamp DESC) AS place FROM (
        SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS stamp FROM lineitem) a) b
    WHERE place = 1""")
statement("vocab_build", """
    WITH words AS (SELECT DISTINCT w FROM (SELECT EXPLODE(SPLIT(lower(content), ' ')) AS w FROM chunks) x WHERE REGEXP_LIKE(w, '^[a-z0-9]{3,}$'))
    SELECT w AS word, length(w) AS chars FROM words LEFT JOIN (SELECT p_name FROM part) p ON p.p_name = words.w WHERE p.p_name IS NULL""")
statement("generation_validate", """
    SELECT project, count(*) AS files, count(*) FILTER (WHERE n_chars > 20000) AS hard, count(*) FILTER (WHERE n_chars > 20000) = 0 AND count(*) >= 40 AS can_activate
    FROM chunks GROUP BY project""")
statement("memory_live", "SELECT id, pinned FROM memories WHERE NOT deleted")
statement("ttl_purge", "SELECT id FROM memories WHERE pinned OR 60 - age_days >= 0")
statement("lru_trim", """
    SELECT id FROM memories ORDER BY access_count DESC, age_days, id LIMIT 200""")
statement("project_merge", """
    WITH src AS (SELECT id, type FROM memories WHERE project_id = 1), dst AS (SELECT id + 1 AS id, type FROM memories WHERE project_id = 0)
    SELECT id, type, 0 AS project_id FROM dst
    UNION ALL SELECT src.id, src.type, 0 FROM src WHERE NOT EXISTS (SELECT 1 FROM dst WHERE dst.id = src.id AND dst.type = src.type)""")
statement("merge_preview", """
    WITH src AS (SELECT id, type FROM memories WHERE project_id = 1), dst AS (SELECT id + 1 AS id, type FROM memories WHERE project_id = 0)
    SELECT (SELECT count(*) FROM src) AS source_rows, (SELECT count(*) FROM dst) AS target_rows,
           (SELECT count(*) FROM src WHERE EXISTS (SELECT 1 FROM dst WHERE dst.id = src.id AND dst.type = src.type)) AS conflicts""")
statement("alias_resolve", """
    WITH aliases AS (SELECT n_name AS retired, r_name AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0)
    SELECT c_custkey, coalesce(a.canonical, n_name) AS project FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN aliases a ON a.retired = n_name""")
statement("group_by_prefix", """
    WITH counts AS (SELECT package AS prefix, count(*) AS n FROM definitions GROUP BY package),
    ranked AS (SELECT prefix, n, row_number() OVER (ORDER BY n DESC, prefix) AS place FROM counts)
    SELECT CASE WHEN place <= 19 THEN prefix ELSE '(other)' END AS prefix, CAST(sum(n) AS BIGINT) AS n FROM ranked GROUP BY 1""")

# --- filters
statement("glob_filter", "SELECT id, file FROM chunks WHERE NOT REGEXP_LIKE(file, '^src1[0-9]/') AND REGEXP_LIKE(file, '^[^/]*/[^/]*[.](en|fr)$')")
statement("min_score_gate", "SELECT id, score FROM (SELECT id, importance AS score, CASE WHEN id % 2 = 0 THEN access_count / 6.0 END AS raw FROM memories) x WHERE coalesce(raw, score) >= 0.5")
statement("search_definitions", "SELECT id, name FROM definitions WHERE lower(name) LIKE '%a%' AND exported AND kind LIKE '%B%' ORDER BY name, id LIMIT 50")
statement("count_definitions", "SELECT least(count(*), 100000) AS n, count(*) <= 100000 AS exact FROM definitions")
statement("find_edges", "SELECT from_id, target_id, line FROM refs WHERE kind IN ('A', 'R') AND from_id < 100 ORDER BY file, line LIMIT 200")
statement("get_references", "SELECT DISTINCT from_id, target_id, kind, line FROM refs WHERE target_id IN (1, 5, 9, 14)")
statement("resolve_fqn", """
    SELECT w.name, CASE WHEN count(d.id) = 1 THEN 'exact' WHEN count(d.id) > 1 THEN 'ambiguous' ELSE 'missing' END AS outcome, count(d.id) AS candidates
    FROM (SELECT DISTINCT name FROM definitions UNION ALL SELECT 'no such name') w LEFT JOIN definitions d ON d.name = w.name GROUP BY w.name""")
statement("memory_filter", "SELECT id, importance FROM memories WHERE importance >= 0.5 AND NOT deleted AND user_id = 2 ORDER BY importance DESC, age_days, id LIMIT 20")
statement("memory_text_search", """
    WITH superseded AS (SELECT id + 1 AS id FROM memories WHERE type = 't3')
    SELECT m.id FROM memory_texts m WHERE (lower(m.content) LIKE '%the%' OR lower(m.content) LIKE '%que%') AND NOT EXISTS (SELECT 1 FROM superseded s WHERE s.id = m.id)""")
statement("recent_by_tag", "SELECT id, age_days FROM memories WHERE tag = 'tag2' AND age_days <= 30 ORDER BY age_days, id")
statement("consolidation_candidates", "SELECT id FROM memories WHERE NOT deleted AND NOT pinned AND embedding IS NOT NULL AND age_days > 30")
statement("event_validate", """
    SELECT event_id, least(greatest(coalesce(duration / 100, 0.5), 0.0), 1.0) AS importance FROM search_events
    WHERE event_type IN ('view', 'click', 'purchase', 'error') AND project_id IS NOT NULL AND k IS NOT NULL""")
statement("active_snapshot_counts", """
    SELECT (SELECT count(*) FROM definitions) AS definitions, (SELECT count(*) FROM definitions WHERE exported) AS exported, (SELECT count(*) FROM imports) AS imports,
           (SELECT count(*) FROM refs) AS refs, (SELECT count(DISTINCT kind) FROM definitions) AS kinds""")

# --- joins
statement("import_two_hop", "SELECT DISTINCT a.from_id, b.to_id FROM imports a JOIN imports b ON a.to_id = b.from_id")
statement("defs_with_centrality", """
    SELECT d.id, coalesce(c.score, 0.0) AS centrality FROM definitions d LEFT JOIN (SELECT to_id, count(*) / 100.0 AS score FROM imports GROUP BY to_id) c ON c.to_id = d.id""")
statement("anti_superseded", "SELECT m.id FROM memories m WHERE NOT EXISTS (SELECT 1 FROM memories s WHERE s.id = m.id + 1 AND s.type = m.type)")
statement("semi_exists", "SELECT id FROM chunks WHERE contains(lower(content), 'tion') OR contains(lower(content), 'sch')")
statement("term_coverage", """
    WITH terms AS (SELECT EXPLODE(SPLIT('the tion sch que', ' ')) AS term)
    SELECT c.id, count(*) / 4.0 AS coverage FROM chunks c JOIN terms t ON contains(lower(c.content), t.term) GROUP BY c.id""")
statement("merge_max_score", """
    SELECT id, max(score) AS score FROM (SELECT id, importance AS score FROM memories UNION ALL SELECT id, access_count / 6.0 FROM memories WHERE id % 2 = 0) x GROUP BY id""")
statement("checkpoint_live_refs", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE EXISTS (SELECT 1 FROM memories m WHERE m.id = l_partkey AND NOT m.deleted)")
statement("analytics_summary", """
    SELECT query, count(*) AS n, (SELECT count(*) FROM search_events) AS total FROM search_events GROUP BY query ORDER BY n DESC, query LIMIT 10""")
statement("analytics_project", """
    SELECT project_id, count(*) AS searches, round(avg(duration), 6) AS avg_duration, round(avg(CAST(k AS DOUBLE)), 6) AS avg_results, round(avg(CASE WHEN cache_hit THEN 1.0 ELSE 0.0 END), 4) AS hit_rate
    FROM search_events GROUP BY project_id""")
statement("analytics_query", "SELECT query, count(*) AS n, round(avg(duration), 6) AS avg_duration FROM search_events WHERE project_id = 1 GROUP BY query")
statement("cache_performance", """
    SELECT round(hits / n, 6) AS hit_rate, round(hit_ms, 6) AS hit_ms, round(miss_ms, 6) AS miss_ms, round(coalesce(miss_ms, 1) / greatest(hit_ms, 1), 6) AS speedup FROM (
      SELECT count(*) AS n, count(*) FILTER (WHERE cache_hit) * 1.0 AS hits, avg(CASE WHEN cache_hit THEN duration END) AS hit_ms, avg(CASE WHEN NOT cache_hit THEN duration END) AS miss_ms FROM search_events) x""")
statement("top_queries", "SELECT query, count(*) AS n FROM search_events GROUP BY query ORDER BY n DESC, query LIMIT 20")
statement("recent_searches", "SELECT event_id, query FROM search_events ORDER BY ts_s DESC, event_id DESC LIMIT 50")
statement("store_stats", "SELECT project, count(*) AS docs, CAST(sum(length(content)) AS BIGINT) AS chars FROM chunks GROUP BY project")
statement("list_projects", "SELECT project, count(*) AS docs, max(id) AS newest, CAST(sum(n_chars) AS BIGINT) AS bytes FROM chunks WHERE project NOT LIKE 'src1%' GROUP BY project")
statement("list_projects_all_dims", """
    SELECT project, CAST(sum(n) AS BIGINT) AS n, max(newest) AS newest FROM (
      SELECT project, count(*) AS n, max(id) AS newest FROM chunks WHERE id % 2 = 0 GROUP BY project
      UNION ALL SELECT project, count(*), max(id) FROM chunks WHERE id % 2 = 1 GROUP BY project) x GROUP BY project""")
statement("project_map_aggregates", """
    SELECT 'kind' AS facet, kind AS name, count(*) AS n FROM definitions GROUP BY kind
    UNION ALL SELECT 'extension', coalesce(nullif(regexp_extract(file, '[.]([a-z]+)$', 1), ''), 'other'), count(*) FROM chunks GROUP BY 2""")
statement("edges_by_kind", "SELECT kind, count(*) AS n FROM refs GROUP BY kind")
statement("language_histogram", "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM chunks GROUP BY lang")
statement("parser_health", """
    SELECT count(*) FILTER (WHERE event_type = 'view') AS recovered, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS failed, CAST(sum(CASE WHEN event_type = 'error' THEN k ELSE 0 END) AS BIGINT) AS errors FROM search_events""")
statement("memory_graph_stats", """
    SELECT edge_type, count(*) AS edges, count(*) FILTER (WHERE weight >= 0.5) AS strong, round(avg(weight), 2) AS avg_weight FROM memory_edges GROUP BY edge_type""")
statement("hub_memories", """
    SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (
      SELECT from_id AS node, 1 AS o, 0 AS i FROM memory_edges UNION ALL SELECT to_id, 0, 1 FROM memory_edges) x
    GROUP BY node ORDER BY degree DESC, node LIMIT 25""")
statement("unambiguous_sessions", "SELECT o_custkey AS session, min(o_orderpriority) AS project FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1")
statement("session_repair", """
    WITH clear AS (SELECT o_custkey AS session, min(o_orderstatus) AS project FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1)
    SELECT o.o_orderkey, c.project FROM orders o JOIN clear c ON c.session = o.o_custkey JOIN customer k ON k.c_custkey = o.o_custkey""")
statement("impacted_modules", """
    WITH n AS (SELECT concat(split_part(path, '/', 1), '/', split_part(path, '/', 2)) AS module, count(*) AS files FROM definitions GROUP BY 1),
    r AS (SELECT module, files, row_number() OVER (ORDER BY files DESC, module) AS place FROM n)
    SELECT CASE WHEN place <= 19 THEN module ELSE '(other)' END AS module, CAST(sum(files) AS BIGINT) AS files FROM r GROUP BY 1""")
statement("cluster_profile", """
    WITH t AS (SELECT session_id AS cluster, type, count(*) AS n FROM memories GROUP BY session_id, type),
    m AS (SELECT cluster, type, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, type) AS place FROM t)
    SELECT s.session_id AS cluster, round(avg(s.importance), 2) AS importance, CAST(sum(s.access_count) AS BIGINT) AS access_count, max(m.type) AS type
    FROM memories s JOIN m ON m.cluster = s.session_id AND m.place = 1 GROUP BY s.session_id""")
statement("cluster_labels", """
    WITH w AS (SELECT DISTINCT session_id, id, word FROM (SELECT session_id, id, EXPLODE(SPLIT(lower(content), ' ')) AS word FROM memory_texts) x WHERE REGEXP_LIKE(word, '^[a-z]{4,}$')),
    c AS (SELECT session_id, word, count(*) AS n FROM w GROUP BY session_id, word)
    SELECT session_id, word, n FROM (SELECT session_id, word, n, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, word) AS place FROM c) x WHERE place <= 3""")
statement("session_snapshot", """
    SELECT session_id, event_type, n, event_id FROM (
      SELECT session_id, event_type, event_id, count(*) OVER (PARTITION BY session_id, event_type) AS n, row_number() OVER (PARTITION BY session_id, event_type ORDER BY ts_s DESC, event_id DESC) AS place FROM search_events) x
    WHERE place <= 5""")
statement("pattern_mining", """
    SELECT 'query' AS signal, query AS key, count(*) AS n FROM search_events GROUP BY query HAVING count(*) >= 25
    UNION ALL SELECT 'file', concat('k', CAST(k AS STRING)), count(*) FROM search_events GROUP BY 2 HAVING count(*) >= 110
    UNION ALL SELECT 'tool', concat(event_type, ':', CAST(project_id AS STRING)), count(*) FROM search_events GROUP BY 2 HAVING count(*) >= 300""")
statement("token_savings", """
    SELECT event_type AS source, round(sum(duration), 4) AS before_tokens, CAST(sum(k) AS BIGINT) AS after_tokens, round(1 - sum(k) / sum(duration), 6) AS ratio, round(sum(duration - k) / 1000000 * 3, 9) AS saved
    FROM search_events GROUP BY event_type""")
statement("token_savings_series", """
    SELECT event_id, running FROM (
      SELECT event_id, ts_s, CAST(sum(k) OVER (PARTITION BY project_id ORDER BY ts_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running, row_number() OVER (PARTITION BY project_id ORDER BY ts_s DESC, event_id DESC) AS place FROM search_events) x
    WHERE place <= 1000""")
statement("provider_metrics", "SELECT event_type AS provider, count(*) AS calls, round(avg(duration), 6) AS mean_ms, round(avg(CASE WHEN k > 80 THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM search_events GROUP BY event_type")
statement("latency_p95_floor", """
    SELECT event_type, max(CASE WHEN place = CAST(floor(n * 0.95) AS BIGINT) + 1 THEN duration END) AS p95, max(CASE WHEN place = CAST(floor(n * 0.99) AS BIGINT) + 1 THEN duration END) AS p99 FROM (
      SELECT event_type, duration, row_number() OVER (PARTITION BY event_type ORDER BY duration) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM search_events) x GROUP BY event_type""")
statement("latency_p95_ceil", """
    SELECT event_type, max(CASE WHEN place = greatest(CAST(ceil(n * 0.5) AS BIGINT), 1) THEN duration END) AS p50, max(CASE WHEN place = greatest(CAST(ceil(n * 0.95) AS BIGINT), 1) THEN duration END) AS p95 FROM (
      SELECT event_type, duration, row_number() OVER (PARTITION BY event_type ORDER BY duration) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM search_events) x GROUP BY event_type""")
statement("compression_report", "SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS original, CAST(sum(length(REPLACE_ALL(content, '[ \\t]+', ''))) AS BIGINT) AS compressed FROM chunks")
statement("embedding_cache_stats", "SELECT count(*) AS entries, CAST(sum(SIZE(embedding) * 4) AS BIGINT) AS bytes, round(avg(CAST(SIZE(embedding) AS DOUBLE)), 4) AS avg_dims FROM embeddings")
statement("task_end_top", "SELECT session_id, k, n FROM (SELECT session_id, k, n, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, k) AS place FROM (SELECT session_id, k, count(*) AS n FROM search_events GROUP BY session_id, k) a) b WHERE place <= 10")
statement("stale_jobs", "SELECT event_id, CASE WHEN ts_s < (SELECT max(ts_s) FROM search_events) - 86400 THEN 'failed' ELSE 'running' END AS status FROM search_events WHERE event_type = 'signup'")
statement("workspace_by_tail", """
    SELECT tail, count(*) AS matches, CASE WHEN count(*) = 1 THEN min(root) END AS root FROM (SELECT root, regexp_extract(root, '([^/]*)$', 1) AS tail FROM roots) x GROUP BY tail""")
statement("file_metadata", """
    SELECT id, lang, SIZE(SPLIT(content, chr(10))) AS lines, length(content) AS chars, contains(content, 'Licensed') AS licensed FROM chunks""")
statement("every_nth", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_s, event_id) AS place FROM search_events) x WHERE place % 10 = 0")
statement("sever_edges", "SELECT from_id, to_id, edge_type FROM memory_edges e WHERE NOT EXISTS (SELECT 1 FROM memories m WHERE m.deleted AND (concat('p', CAST(m.id AS STRING)) = e.to_id))")
statement("price_statistics", """
    WITH one AS (SELECT p_brand AS provider, p_name AS model, min(p_retailprice) AS price FROM part GROUP BY p_brand, p_name)
    SELECT count(*) AS models, count(DISTINCT provider) AS providers, round(avg(price), 4) AS mean_price, min(price) AS cheapest, max(price) AS dearest FROM one""")
statement("price_top", "SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")

# --- windows
statement("per_file_cap", "SELECT id, place FROM (SELECT id, row_number() OVER (PARTITION BY project ORDER BY n_chars DESC, id) AS place FROM chunks) x WHERE place <= 2")
statement("score_spectrum", """
    SELECT type, round(top, 6) AS top, round(second, 6) AS second, round(top - second, 6) AS spread, round(mean, 6) AS mean, round((top - second) * mean, 6) AS confidence FROM (
      SELECT type, max(CASE WHEN place = 1 THEN importance END) AS top, coalesce(max(CASE WHEN place = 2 THEN importance END), 0) AS second, avg(importance) AS mean FROM (
        SELECT type, importance, row_number() OVER (PARTITION BY type ORDER BY importance DESC, id) AS place FROM memories) x GROUP BY type) y""")
statement("adaptive_ttl", """
    SELECT session_id, CASE WHEN gap < 300 THEN 7200 WHEN gap > 3600 THEN 1800 ELSE 3600 END AS ttl_s FROM (
      SELECT session_id, avg(CAST(g AS DOUBLE)) AS gap FROM (
        SELECT session_id, ts_s - lag(ts_s) OVER (PARTITION BY session_id ORDER BY ts_s, event_id) AS g, row_number() OVER (PARTITION BY session_id ORDER BY ts_s DESC, event_id DESC) AS place FROM search_events) x
      WHERE place <= 9 GROUP BY session_id) y""")
statement("sliding_rate", """
    SELECT event_id, count(*) OVER (PARTITION BY session_id ORDER BY ts_s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS per_minute,
           CAST(sum(k) OVER (PARTITION BY session_id ORDER BY ts_s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS BIGINT) AS per_day FROM search_events""")
statement("dedup_first", "SELECT k, event_id FROM (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY ts_s, event_id) AS place FROM search_events) x WHERE place = 1")
statement("delivery_status", """
    SELECT event_id, CASE WHEN before IS NULL THEN 'new' WHEN before = k THEN 'unchanged' ELSE 'changed' END AS status FROM (
      SELECT event_id, k, lag(k) OVER (PARTITION BY session_id, event_type ORDER BY ts_s, event_id) AS before FROM search_events) x""")
statement("latest_checkpoint", "SELECT session_id, event_type, max_by(event_id, ts_s * 1000000 + event_id) AS event_id FROM search_events WHERE event_type <> 'error' GROUP BY session_id, event_type")
statement("queue_transition", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'accepted' ELSE event_type END AS status FROM search_events WHERE event_type IN ('click', 'view')")
